"""Feeds that Spark polls itself: a streaming source that keeps a position for each feed.

Every look asks each feed how far it reaches. What lies between the last
position and that one is a micro-batch, cut into parts that are read apart; a
look that finds nothing new gives no batch. Positions stand in the stream's
checkpoint, so a restart goes on where it was and reads an unfinished batch
again from the same positions.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

#: The columns of landed records; ``_block`` is a record's position in its feed.
LANDED = "value string, feed string, _file_time timestamp, _file string, _block bigint"
NAMES = ["value", "feed", "_file_time", "_file", "_block"]
#: Records of one Arrow batch, and bytes read at once.
BATCH, CHUNK = 1_000, 1 << 20

log = logging.getLogger(__name__)


class PolledFeed(Protocol):
    """Records in an order that only grows. Sent to the workers, so it has to pickle."""

    def latest(self) -> int:
        """The position behind the last complete record."""

    def ranges(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Parts of [begin, end) that may be read apart, in order."""

    def records(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        """(position, JSON text) of the records that begin in [begin, end)."""


@dataclass(frozen=True)
class LineLog:
    """A feed as JSON lines in the files below a folder, one after the other by path.

    New lines come at the end of the last file or in a file behind it; what is
    there stays. A position counts bytes over all files. The unfinished last
    line of the last file waits for its end. A line belongs to the range it
    begins in. Files whose name begins with ``.`` or ``_`` don't count; no
    folder, no lines. A range is cut into parts of ``part`` bytes.
    """

    root: str
    part: int = 64 << 20

    def _files(self) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
        system, path = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        shown = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return system, sorted((f.path, f.size) for f in shown)

    def latest(self) -> int:
        system, files = self._files()
        if not files:
            return 0
        path, size = files[-1]
        return sum(size for _, size in files[:-1]) + _complete(system, path, size)

    def ranges(self, begin: int, end: int) -> list[tuple[int, int]]:
        return [(at, min(at + self.part, end)) for at in range(begin, end, self.part)]

    def records(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        system, files = self._files()
        first = 0
        for path, size in files:
            low, high = max(begin - first, 0), min(end - first, size)
            if low < high:
                with system.open_input_file(path) as file:
                    for at, line in _lines(file, low, high, size):
                        yield first + at, line.decode(errors="replace")
            first += size


def _complete(system: fs.FileSystem, path: str, size: int) -> int:
    """Bytes of a file up to the end of its last whole line."""
    with system.open_input_file(path) as file:
        while size > 0:
            begin = max(0, size - CHUNK)
            found = file.read_at(size - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            size = begin
    return 0


def _lines(file: pa.NativeFile, low: int, high: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in [low, high) and aren't empty."""
    # The byte before the range tells whether a line begins with it.
    at, held, skip = max(low - 1, 0), b"", low > 0
    read = at
    while at < high or (skip and read < size):
        new = held.find(b"\n")
        if new < 0 and read < size:
            chunk = file.read_at(min(CHUNK, size - read), read)
            read += len(chunk)
            held += chunk
            continue
        line, held = (held[:new], held[new + 1 :]) if new >= 0 else (held, b"")
        if not skip and at < high and line.strip():
            yield at, line.removesuffix(b"\r")
        at, skip = at + len(line) + 1, False
        if new < 0:
            return


@dataclass
class Part(InputPartition):
    feed: str
    begin: int
    end: int


class _Positions:
    """What the streaming and the batch reader share."""

    def __init__(self, feeds: dict[str, PolledFeed], start: dict[str, int]) -> None:
        self.feeds, self.start = feeds, start
        self.known: dict[str, int] = {}

    def first(self) -> dict[str, int]:
        return {name: self.start.get(name, 0) for name in self.feeds}

    def now(self) -> dict[str, int]:
        """How far each feed reaches.

        A feed that can't be reached stays where it was, so the others go on;
        if it never was reached the look fails, as nothing is known of it. A
        feed that shrank fails: its positions mean something else now.
        """
        for name, feed in self.feeds.items():
            try:
                found = max(feed.latest(), self.start.get(name, 0))
            except OSError:
                if name not in self.known:
                    raise
                log.warning("feed %s can't be reached", name)
                continue
            if found < self.known.get(name, 0):
                raise ValueError(f"feed {name} went back from {self.known[name]} to {found}")
            self.known[name] = found
        return dict(self.known)

    def parts(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        """A feed that the checkpoint doesn't know yet begins at its start."""
        first = self.first()
        return [
            Part(name, *piece)
            for name, feed in self.feeds.items()
            for piece in feed.ranges(start.get(name, first[name]), end.get(name, first[name]))
        ]

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        values: list[str] = []

        def batch() -> pa.RecordBatch:
            n = len(values)
            named = pa.array([part.feed] * n, pa.string())
            time = pa.nulls(n, pa.timestamp("us", "UTC"))
            columns = [pa.array(values, pa.string()), named, time, named, pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for at, value in self.feeds[part.feed].records(part.begin, part.end):
            places.append(at)
            values.append(value)
            if len(values) == BATCH:
                yield batch()
                places, values = [], []
        if values:
            yield batch()


class _Stream(DataSourceStreamReader):
    def __init__(self, positions: _Positions) -> None:
        self.positions = positions

    def initialOffset(self) -> dict:
        return self.positions.first()

    def latestOffset(self) -> dict:
        return self.positions.now()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # After a restart the positions of the checkpoint are the ones known.
        self.positions.known = {**end, **self.positions.known}
        return self.positions.parts(start, end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.positions.rows(partition)


class _Batch(DataSourceReader):
    def __init__(self, positions: _Positions) -> None:
        self.positions = positions

    def partitions(self) -> list[Part]:
        found = self.positions.parts(self.positions.first(), self.positions.now())
        return found or [Part(next(iter(self.positions.feeds)), 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.positions.rows(partition)


def register_feeds(
    spark: SparkSession, feeds: dict[str, PolledFeed], name: str = "polled_feeds"
) -> str:
    """Make ``feeds`` a format to read, as a stream or at once; returns its name.

    Option ``start``: JSON of the position to begin at per feed, 0 if not
    given. A stream with a checkpoint goes on from there whatever it says.
    """
    if not feeds:
        raise ValueError("no feeds")

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LANDED

        def _positions(self) -> _Positions:
            return _Positions(feeds, json.loads(self.options.get("start", "{}")))

        def streamReader(self, schema) -> _Stream:
            return _Stream(self._positions())

        def reader(self, schema) -> _Batch:
            return _Batch(self._positions())

    spark.dataSource.register(Polled)
    return name


def stream_feeds(
    spark: SparkSession, feeds: dict[str, PolledFeed], start: dict[str, int] | None = None
) -> DataFrame:
    """Polled feeds as a stream of landed records, ready for ``ingest_stream``."""
    name = register_feeds(spark, feeds)
    return spark.readStream.format(name).option("start", json.dumps(start or {})).load()


def read_feeds(
    spark: SparkSession, feeds: dict[str, PolledFeed], start: dict[str, int] | None = None
) -> DataFrame:
    """All records that polled feeds hold now, from ``start`` on."""
    name = register_feeds(spark, feeds)
    return spark.read.format(name).option("start", json.dumps(start or {})).load()
