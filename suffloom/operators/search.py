"""Patterns in texts by their suffix arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffloom.functions.kernel import interval, sort_suffixes
from suffloom.operators.shared import joined
from suffloom.operators.suffix_array import spread, text_runs
from suffloom.shipping import ship

MOST_PATTERN_BYTES = 8 << 20


def collected(patterns: DataFrame) -> list[tuple[int, bytes]]:
    """Patterns go to all tasks, so their size is checked."""
    size = patterns.agg(F.sum(F.octet_length("pat"))).first()[0] or 0
    if size > MOST_PATTERN_BYTES:
        raise ValueError(f"patterns have {size} bytes; search in parts of at most {MOST_PATTERN_BYTES}")
    return [(r["pat_id"], bytes(r["pat"])) for r in patterns.select("pat_id", "pat").where(F.col("pat").isNotNull()).collect()]


def pattern_ranges(texts: DataFrame, patterns: DataFrame, found_only: bool = False) -> DataFrame:
    """(text_id, pat_id, lo, hi): the half-open run of slots whose suffixes begin with the pattern. An empty
    run lies at the first greater suffix; found_only leaves such out. Binary search in each text."""
    ship(texts.sparkSession)
    pats = collected(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in text_runs(batches, 1 << 20):
            starts, order = sort_suffixes(some)
            rows = []
            for i, t in enumerate(some):
                sa = order[starts[i] : starts[i + 1]]
                for pat_id, pat in pats:
                    if found_only and pat not in t:
                        continue
                    rows.append((ids[i], pat_id, *interval(t, sa, pat)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["text_id", "pat_id", "lo", "hi"])

    return spread(texts).select("text_id", "bytes").mapInArrow(run, "text_id bigint, pat_id int, lo bigint, hi bigint")


def pattern_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pat_id, cnt): occurrences in all texts, overlapping ones too; patterns that don't occur have 0."""
    counts = pattern_ranges(texts, patterns, found_only=True).groupBy("pat_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("cnt"))
    return patterns.select(F.col("pat_id").cast("int").alias("pat_id")).join(counts, "pat_id", "left").fillna(0, ["cnt"])


def pattern_positions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pat_id, pos)"""
    ship(texts.sparkSession)
    pats = collected(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in text_runs(batches, 1 << 20):
            starts, order = sort_suffixes(some)
            for i, t in enumerate(some):
                sa = order[starts[i] : starts[i + 1]]
                for pat_id, pat in pats:
                    if pat in t:
                        lo, hi = interval(t, sa, pat)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, ids[i], np.int64)), pa.array(np.full(hi - lo, pat_id, np.int32)), pa.array(sa[lo:hi])], names=["text_id", "pat_id", "pos"])

    return spread(texts).select("text_id", "bytes").mapInArrow(run, "text_id bigint, pat_id int, pos bigint")


def pattern_range_of_rows(suf: DataFrame, texts: DataFrame, pattern: bytes) -> DataFrame:
    """(text_id, lo, hi) of one pattern by one aggregate over a table of suffixes: for texts too long for a task.
    A suffix' head comes from a join with the text's row."""
    head = F.substring("bytes", (F.col("pos") + 1).cast("int"), F.lit(len(pattern)))
    heads = joined(suf.select("text_id", "pos"), texts, "text_id").select("text_id", head.alias("head"))
    return heads.groupBy("text_id").agg(F.sum((F.col("head") < F.lit(pattern)).cast("long")).alias("lo"), F.sum((F.col("head") <= F.lit(pattern)).cast("long")).alias("hi"))
