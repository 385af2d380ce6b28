"""Top-n rows per group, safe when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Up to this setting's n the optimizer limits every group inside each map task,
# before the shuffle, so a hot group arrives as n rows per task.
MAP_SIDE_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n(
    rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each group in ``order``, numbered from 1 in ``rank``.

    ``order`` has to be total within a group for the result to be repeatable.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if n > int(rows.sparkSession.conf.get(MAP_SIDE_LIMIT, "1000")):
        # Cut each group in as many splits as a shuffle has partitions first;
        # the top n are among the splits' top n.
        splits = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        split = F.pmod(F.monotonically_increasing_id(), F.lit(splits))
        pre = Window.partitionBy(*group, "_split").orderBy(*order)
        rows = (
            rows.withColumn("_split", split)
            .withColumn("_pre", F.row_number().over(pre))
            .where(F.col("_pre") <= n)
            .drop("_split", "_pre")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
