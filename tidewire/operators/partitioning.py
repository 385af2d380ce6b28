"""Where and how often work that is heavy per row is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Inputs from this size on are left as they are split.
SMALL_BYTES = 1 << 30


def spread(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Use every core for the per-row work that follows.

    A small input, such as one file with one row group, is read by a single
    task and would be cleaned and embedded by that task alone. What is small
    is told by the bytes the plan reads, not by the cluster's size, so no
    large table is ever shuffled for this. Select the needed columns first.
    """
    wanted = tasks or rows.sparkSession.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= SMALL_BYTES or rows.rdd.getNumPartitions() >= wanted:
        return rows
    return rows.repartition(wanted)


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name``, evaluated once per row whatever filters follow.

    A filter on a plain computed column is pushed below the projection that
    computes it, and the expression then runs in both places. A filter on
    generated rows is not. The outer form also spares the filter the optimizer
    derives from an inner explode.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))
