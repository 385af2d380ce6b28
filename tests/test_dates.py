import pytest
from pyspark.sql import functions as F

from tidewire.functions.dates import (
    format_timestamp,
    parse_timestamp,
    published_timestamp,
    within_hours,
)

AS_OF = "2024-02-01 08:30:00"
CASES = [
    ("2024-09-01T12:00:00+02:00", "2024-09-01 12:00:00"),
    ("2024-09-01T12:00:00Z", "2024-09-01 12:00:00"),
    ("2024-09-01 12:00:00.123456", "2024-09-01 12:00:00"),
    ("2024-09-01", "2024-09-01 00:00:00"),
    ("Sun, 01 Sep 2024 12:00:00 GMT", "2024-09-01 12:00:00"),
    ("Sun, 1 Sep 2024 12:00:00 +0530", "2024-09-01 12:00:00"),
    ("01 September 2024", "2024-09-01 00:00:00"),
    ("09/01/2024 23:59:58", "2024-09-01 23:59:58"),
    ("9/1/2024", "2024-09-01 00:00:00"),
    ("September 1, 2024", "2024-09-01 00:00:00"),
    # the hour that New York skips
    ("Sun, 10 Mar 2024 02:30:00 GMT", "2024-03-10 02:30:00"),
    ("2024-03-10T02:30:00Z", "2024-03-10 02:30:00"),
    ("03/10/2024 02:30:00", "2024-03-10 02:30:00"),
    ("garbage", None),
    ("", None),
    (None, None),
    ("2024-02-31", None),
    ("31 Foo 2024", None),
    ("12 Anf 2024", None),
    ("13/45/2024", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_keeps_the_wall_clock(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(
            [(i, c[0]) for i, c in enumerate(CASES)], "i int, v string"
        ).orderBy("i")
        shown = rows.select(
            format_timestamp(parse_timestamp(F.col("v"))).alias("parsed"),
            format_timestamp(published_timestamp(F.col("v"), AS_OF)).alias("published"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [row["parsed"] for row in shown] == [c[1] for c in CASES]
    assert [row["published"] for row in shown] == [c[1] or AS_OF for c in CASES]


def test_recency_window_bounds(spark):
    stamps = ["2024-01-31 08:29:59", "2024-01-31 08:30:00", AS_OF, "2024-02-01 08:30:01"]
    rows = spark.createDataFrame([(s,) for s in stamps], "s string")
    kept = rows.where(within_hours(F.col("s").cast("timestamp_ntz"), AS_OF, 24)).collect()
    assert [row["s"] for row in kept] == stamps[1:3]
