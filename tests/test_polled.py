"""Feeds polled by position: growing logs, ranges, restarts, empty looks, replays."""

import json
import random

import pytest

from tests.test_stream import AS_OF, a, b, rows
from tidewire.sources import polled
from tidewire.sources.polled import LineLog, read_feeds, stream_feeds
from tidewire.sources.store import VectorStore
from tidewire.streaming.ingest import Ingest, ingest_stream


def put(folder, name, text, mode="a"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as file:
        file.write(text)


@pytest.mark.parametrize("chunk", [3, 7, 1 << 20])
def test_every_line_belongs_to_one_range(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(polled, "CHUNK", chunk)  # read in this process
    draw = random.Random(chunk)
    expected, first = [], 0
    for k, name in enumerate(["1/a.json", "1/b.json", "2/a.json", "2/empty.json"]):
        text = ""
        for _ in range(20 if "empty" not in name else 0):
            line = draw.choice(["", "x", "é" * draw.randint(1, 9), "word " * 5, "y\r"])
            if line:
                expected.append((first + len(text.encode()), line.removesuffix("\r")))
            text += line + "\n"
        put(tmp_path, name, text)
        first += len(text.encode())
    put(tmp_path, "_SUCCESS", "no line")
    log = LineLog(str(tmp_path), part=11)
    assert log.latest() == first
    assert list(log.records(0, first)) == expected
    for part in (1, 2, 5, 11, 64, 10_000):
        ranges = LineLog(str(tmp_path), part=part).ranges(0, first)
        assert [e for r in ranges for e in log.records(*r)] == expected
    for begin in range(0, first, 7):
        assert list(log.records(begin, first)) == [e for e in expected if e[0] >= begin]


def test_an_unfinished_line_waits(tmp_path):
    log = LineLog(str(tmp_path / "log"))
    assert log.latest() == 0 and log.ranges(0, 0) == []
    put(tmp_path / "log", "1", "one\ntw")
    assert log.latest() == 4
    put(tmp_path / "log", "1", "o\n")
    assert log.latest() == 8 and list(log.records(4, 8)) == [(4, "two")]
    put(tmp_path / "log", "2", "thr")
    assert log.latest() == 8
    put(tmp_path / "log", "2", "ee\nfour\n")
    assert list(log.records(8, log.latest())) == [(8, "three"), (14, "four")]


class Broken:
    def latest(self):
        raise OSError("down")


def test_a_feed_that_is_down_stops_no_other(tmp_path):
    put(tmp_path, "1", "one\n")
    looks = polled._Positions({"a": LineLog(str(tmp_path)), "b": LineLog(str(tmp_path))}, {"b": 2})
    assert looks.first() == {"a": 0, "b": 2} and looks.now() == {"a": 4, "b": 4}
    looks.feeds["b"] = Broken()
    put(tmp_path, "1", "two\n")
    assert looks.now() == {"a": 8, "b": 4}
    with pytest.raises(OSError):
        polled._Positions({"b": Broken()}, {}).now()
    put(tmp_path, "1", "x\n", mode="w")
    with pytest.raises(ValueError, match="went back"):
        looks.now()


def test_batches_of_positions(spark, tmp_path):
    put(tmp_path, "a/1", "".join(f"a{i}\n" for i in range(3000)))
    put(tmp_path, "b/1", "b0\n\nb1\n")
    feeds = {name: LineLog(str(tmp_path / name), part=1000) for name in "ab"}
    found = read_feeds(spark, feeds).collect()
    assert [r["value"] for r in found if r["feed"] == "a"] == [f"a{i}" for i in range(3000)]
    assert [(r["value"], r["_block"]) for r in found if r["feed"] == "b"] == [("b0", 0), ("b1", 4)]
    later = read_feeds(spark, feeds, {"a": 10**9, "b": 3}).collect()
    assert [(r["feed"], r["value"]) for r in later] == [("b", "b1")]
    nothing = {"a": LineLog(str(tmp_path / "nothing"))}
    assert read_feeds(spark, nothing).collect() == []


def test_polling_resumes_and_equals_the_batch(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), url_buckets=4)
    job = Ingest(store, AS_OF, max_tokens=30, embed_tasks=2)
    feeds = {name: LineLog(str(tmp_path / name), part=2000) for name in "ab"}

    def poll():
        writer = ingest_stream(stream_feeds(spark, feeds), job, str(tmp_path / "at"), True)
        query = writer.start()
        query.awaitTermination()
        offsets = sorted((tmp_path / "at" / "commits").glob("[0-9]*"))
        return len(offsets)

    put(tmp_path, "a/1", "".join(a(i) + "\n" for i in range(8)))
    put(tmp_path, "b/1", b(1) + "\n{cut\n" + b(2)[:20])
    done = poll()
    assert len({r[0] for r in rows(store)}) == 9
    assert poll() == done  # an empty look gives no batch
    put(tmp_path, "b/1", b(2)[20:] + "\n")
    put(tmp_path, "a/2", a(3, title="changed") + "\n" + a(8) + "\n")
    poll()
    streamed = rows(store)
    assert len({r[0] for r in streamed}) == 11
    offsets = sorted((tmp_path / "at" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))
    reached = json.loads(offsets[-1].read_text().splitlines()[-1])
    assert reached == {name: feeds[name].latest() for name in "ab"}

    once = VectorStore(spark, str(tmp_path / "once"), url_buckets=4)
    Ingest(once, AS_OF, max_tokens=30, embed_tasks=2).run(read_feeds(spark, feeds), 0)
    assert rows(once) == streamed
    # Replay from a position, into a store of its own.
    part = VectorStore(spark, str(tmp_path / "part"), url_buckets=4)
    start = {"a": len(a(0) + "\n") * 8, "b": feeds["b"].latest()}
    again = Ingest(part, AS_OF, max_tokens=30, embed_tasks=2)
    writer = ingest_stream(stream_feeds(spark, feeds, start), again, str(tmp_path / "from"), True)
    writer.start().awaitTermination()
    assert {r[4] for r in rows(part)} == {"changed", "headline 8"}
