"""Consecutive numbers in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Add ``name`` = 1, 2, 3.. by ``order``, restarting in each ``group``.

    Rows are range-partitioned by (group, order), so even one huge group spreads over many
    tasks. Each task knows its own row positions; only one count per (group, task) is summed
    up. The range shuffle is stored first: its bounds are sampled and may move on a retry.
    """
    group = group or []
    placed = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    placed = materialize(placed)
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    if not group:
        offsets = F.broadcast(offsets)  # one row per partition
    return (
        placed.join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first") + 1)
        .drop("_part", "_seq", "_first", "_before")
    )
