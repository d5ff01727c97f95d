"""Connected components of a graph of longs, in Spark, and their joining back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffloom.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it reaches.

    Alternating large and small stars: each round links a node's larger neighbours, then its
    smaller ones, to the smallest of all; a path of n nodes needs about log n rounds. Minima are
    summed up before they are shuffled, and are joined back rather than gathered with a node's
    neighbours, so that AQE can split a hub's rows. Each round is written to the shared folder.
    No edges give no rows; loops and repeated edges do no harm.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        e = written(small, "edges")
        new = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def attach_components(rows: DataFrame, classes: DataFrame, by: str, value: str, count: str = "n") -> DataFrame:
    """rows with the column `value` of classes, null where `by` isn't among them.

    classes: by, value and the number of rows that have it. A class of over a 4096th of all
    rows (and over 64) is joined by broadcast: of those there can't be more than 4096. The
    others are small, so that a shuffle on `by` spreads them evenly.
    """
    total = classes.agg(F.sum(count)).first()[0] or 0
    limit = max(64, total // 4096)
    heavy = F.broadcast(classes.where(F.col(count) > limit).select(by, value))
    light = classes.where(F.col(count) <= limit).select(by, value)
    return rows.join(heavy, by).unionByName(rows.join(heavy.select(by), by, "left_anti").join(light, by, "left"))
