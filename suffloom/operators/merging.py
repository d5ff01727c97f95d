"""Order-preserving merges of partial suffix arrays by gaps: no suffix is looked at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffloom.operators.blocks import gap, zone, zone_array
from suffloom.operators.bwt import running
from suffloom.operators.shared import joined, once


def merge_two(left: DataFrame, right: DataFrame, gaps: DataFrame, large: bool = False) -> DataFrame:
    """Both arrays' rows with their rank in the merged array. left, right: (text_id, k, ...) with the same
    columns; gaps: how many of the right come in front of each of the left.

    The left's number k gets k plus the gaps up to k. The right's number r gets r plus its slot,
    and which slot that is follows from the gaps: a slot's rows are consecutive.
    """
    columns = [c for c in left.columns if c not in ("text_id", "k")]
    marks = gaps.select("text_id", F.struct(F.col("slot").alias("k"), F.lit(0).alias("kind")).alias("at"), F.col("cnt").alias("add"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns))
    rows = left.select("text_id", F.struct("k", F.lit(1).alias("kind")).alias("at"), F.lit(0).cast("long").alias("add"), *columns)
    summed = running(marks.unionByName(rows), ["text_id"], "at", F.col("add"), "before", large, inclusive=True)
    lefts = summed.where("at.kind = 1").select("text_id", (F.col("at.k") + F.col("before")).alias("rank"), *columns)
    slot = running(gaps, ["text_id"], "slot", F.col("cnt"), "before", large)
    slot = slot.where("cnt > 0").select("text_id", "slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("cnt") - 1)).alias("k"))
    rights = joined(right, slot, ["text_id", "k"]).select("text_id", (F.col("k") + F.col("slot")).alias("rank"), *columns)
    return lefts.unionByName(rights)


def merge_halves(suf: DataFrame, large: bool = False) -> DataFrame:
    """(text_id, rank, pos): the array of a text from its halves' and their gap."""
    suf = once(suf, "suffixes")
    left, right = zone(2, 0), zone(2, 1)
    return merge_two(zone_array(suf, left, large), zone_array(suf, right, large), gap(suf, left, right, large), large).select("text_id", "rank", "pos")


def merge_parts(suf: DataFrame, parts: int, large: bool = False) -> DataFrame:
    """(text_id, rank, pos): the array of a text from those of its parts, merged from the last to the first;
    each part's gap is that of all that follows."""
    suf = once(suf, "suffixes")
    merged = zone_array(suf, zone(parts, parts - 1), large)
    for k in range(parts - 2, -1, -1):
        gaps = gap(suf, zone(parts, k), zone(parts, k + 1, parts), large)
        merged = merge_two(zone_array(suf, zone(parts, k), large), merged, gaps, large).withColumnRenamed("rank", "k")
    return merged.select("text_id", F.col("k").alias("rank"), "pos")


def merge_transforms(suf: DataFrame, large: bool = False) -> DataFrame:
    """(text_id, rank, sym): the BWT of a text from those of its halves. The right one's slot of its first
    position gets the left one's last byte; the merged primary index is where position 0 comes to lie."""

    suf = once(suf, "suffixes")
    half = F.floor(F.col("n") / 2)
    left, right = zone(2, 0), zone(2, 1)
    own = suf.select("text_id", "pos", "n")
    begins = own.where(F.col("pos") == half).select("text_id", F.col("pos").alias("begin"))
    rights = joined(zone_array(suf, right, large), begins, "text_id").withColumn("prev", F.when(F.col("pos") == F.col("begin"), 0).otherwise(F.col("prev")))
    lasts = suf.where(F.col("pos") == half - 1).select("text_id", F.col("sym").alias("last"))
    columns = ["text_id", "k", "prev", "first"]
    a = zone_array(suf, left, large).withColumn("first", F.lit(False)).select(*columns)
    b = rights.withColumn("first", F.col("pos") == F.col("begin")).select(*columns)
    merged = joined(merge_two(a, b, gap(suf, left, right, large), large), lasts, "text_id", "left")
    return merged.select("text_id", "rank", F.when(F.col("first"), F.coalesce("last", F.lit(0))).otherwise(F.col("prev")).alias("sym"))


def union_ordered(*arrays: DataFrame) -> DataFrame:
    """Disjoint (text_id, rank, pos) rows as one table; their ranks already say the order."""
    return reduce(DataFrame.unionByName, arrays)
