"""Running sums that need no single partition.

A window over one big group, or over no group, sends all rows to one task. Here rows are first
summed up by key, the keys are range-partitioned and written, partitions' totals are summed on
their own, and each row gets its partition's offset. Few distinct rows a partition remain for
the window, and equal keys are one row, so that a frequent key is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suffloom.operators.shared import written


def prefix_sums(rows: DataFrame, by: Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows before, in the order of the columns `by`,
    which must tell rows apart."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The partition's number is written with its rows: a later read may deal files out otherwise.
    parted = written(rows.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = parted.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select("__part", before.alias("__offset")))  # as many rows as partitions
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("__inside", inside).join(offsets, "__part").withColumn(out, (F.col("__offset") + F.col("__inside")).cast("long")).drop("__part", "__offset", "__inside")


def competition_ranks(rows: DataFrame, by: Sequence[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """(by, count, out): for each key, how often it occurs and how many rows have a lower one."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("count"))
    return prefix_sums(counts, by, "count", out, partitions)
