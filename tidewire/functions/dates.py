"""Publication dates: flexible parsing that keeps the written wall-clock time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
# Optional weekday, day, month name, year, optional time, optional zone.
DAY_MONTH_YEAR = (
    r"^(?:[A-Za-z]+,? +)?(\d{1,2}) +([A-Za-z]{3,9})\.? +(\d{4})"
    r"(?: +(\d{1,2}:\d{2}(?::\d{2})?))?(?: *(?:[A-Za-z]{1,5}|[+-]\d{2}:?\d{2}))?$"
)
MONTH_DAY_YEAR = r"^([A-Za-z]{3,9})\.? +(\d{1,2}), *(\d{4})$"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: +(\d{1,2}:\d{2}(?::\d{2})?))?$"
# ---------------------------------------------------------------------------


def _stamp(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _month_number(name: Column) -> Column:
    at = F.position(F.lower(F.substring(name, 1, 3)), F.lit(MONTHS))
    return F.when((at > 0) & (at % 3 == 1), F.floor((at + 2) / 3).cast("string"))


def _assemble(year: Column, month: Column, day: Column, time: Column | None = None) -> Column:
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    clock = F.lit("00:00:00") if time is None else F.when(time == "", "00:00:00").otherwise(time)
    return F.when(month.isNotNull(), _stamp(F.concat_ws(" ", date, clock)))


def parse_timestamp(value: Column) -> Column:
    """First match wins: ISO, RFC-822, MM/dd/yyyy, "MMMM d, yyyy"; else null.

    Offsets and zone names are dropped, not applied: 12:00+02:00 is 12:00. All
    steps stay in ``timestamp_ntz``, so the session zone has no influence.
    """
    text = F.trim(value)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    return F.coalesce(
        F.when(text.rlike(ISO_DATE), _stamp(text)),
        F.when(
            text.rlike(DAY_MONTH_YEAR),
            _assemble(
                part(DAY_MONTH_YEAR, 3),
                _month_number(part(DAY_MONTH_YEAR, 2)),
                part(DAY_MONTH_YEAR, 1),
                part(DAY_MONTH_YEAR, 4),
            ),
        ),
        F.when(
            text.rlike(SLASHED),
            _assemble(part(SLASHED, 3), part(SLASHED, 1), part(SLASHED, 2), part(SLASHED, 4)),
        ),
        F.when(
            text.rlike(MONTH_DAY_YEAR),
            _assemble(
                part(MONTH_DAY_YEAR, 3),
                _month_number(part(MONTH_DAY_YEAR, 1)),
                part(MONTH_DAY_YEAR, 2),
            ),
        ),
    )


def ntz_literal(moment: datetime | str) -> Column:
    text = moment if isinstance(moment, str) else moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def published_timestamp(value: Column, as_of: datetime | str) -> Column:
    """Parsed time, or ``as_of`` where the value cannot be read."""
    return F.coalesce(parse_timestamp(value), ntz_literal(as_of))


def format_timestamp(stamp: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without passing through a zoned timestamp."""
    return F.substring(stamp.cast("string"), 1, 19)


def within_hours(stamp: Column, as_of: datetime | str, hours: int = 24) -> Column:
    """``as_of - hours <= stamp <= as_of``; both bounds fold to literals."""
    end = ntz_literal(as_of)
    return stamp.between(end - F.make_dt_interval(hours=F.lit(hours)), end)
