"""A stored index of suffixes, searched by its keys: texts are neither sorted again nor read.

A row of the index holds a suffix' rank, its position and its first seven symbols as one number.
Rows are written in order of text and rank, in which these numbers ascend, so that a scan for a run of them reads
the row groups that hold it. A longer pattern is cut into pieces of seven: it stands where its first
piece does and each further piece stands as many symbols on. So texts longer than a row or a task
can be searched, too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffloom.functions.kernel import FIRST_SYMBOLS
from suffloom.operators.search import collected
from suffloom.operators.suffix_array import of_chunks, suffixes

COLUMNS = ["text_id", "rank", "pos", "key"]
#: More runs of keys than these are not pushed down one by one, but as one.
_PUSHED = 64


def index_of(texts: DataFrame, strategy: str = "auto") -> DataFrame:
    """(text_id, rank, pos, key) of texts that fit a row each."""
    return suffixes(texts, strategy, columns=COLUMNS)


def index_of_chunks(chunks: DataFrame) -> DataFrame:
    """The same for texts that come as chunks (see sources.chunks)."""
    return of_chunks(chunks, columns=COLUMNS)


def write_index(index: DataFrame, path: str, rows_per_file: int = 50_000_000) -> DataFrame:
    """Writes an index in order and returns it as it is read."""
    spark = index.sparkSession
    files = max(1, -(-index.count() // rows_per_file), spark.sparkContext.defaultParallelism)
    index.repartitionByRange(files, "text_id", "rank").sortWithinPartitions("text_id", "rank").write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def key_run(piece: bytes) -> tuple[int, int]:
    """The least and the greatest key of suffixes that begin with up to seven bytes."""
    low = high = 0
    for k in range(FIRST_SYMBOLS):
        low = low * 257 + (piece[k] + 1 if k < len(piece) else 0)
        high = high * 257 + (piece[k] + 1 if k < len(piece) else 256)
    return low, high


def occurrences(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pat_id, pos, rank): each place at which a pattern (pat_id, pat) stands. An empty pattern stands everywhere; a null one nowhere."""
    pieces = [(pat_id, k, *key_run(pat[k : k + FIRST_SYMBOLS])) for pat_id, pat in collected(patterns) for k in range(0, max(1, len(pat)), FIRST_SYMBOLS)]
    schema = "text_id bigint, pat_id int, offset int, pos bigint, rank bigint"
    if not pieces:
        return index.sparkSession.createDataFrame([], schema).drop("offset")
    if len(pieces) <= _PUSHED:
        wanted = reduce(lambda a, b: a | b, (F.col("key").between(lo, hi) for _, _, lo, hi in pieces))
    else:
        wanted = F.col("key").between(min(p[2] for p in pieces), max(p[3] for p in pieces))
    low, high = np.array([p[2] for p in pieces], np.int64), np.array([p[3] for p in pieces], np.int64)
    pat, offset = np.array([p[0] for p in pieces], np.int32), np.array([p[1] for p in pieces], np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, rank, pos, key = (b.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS)
            order = np.argsort(key, kind="stable")
            begin, end = np.searchsorted(key[order], low), np.searchsorted(key[order], high, side="right")
            n = end - begin
            which = np.repeat(np.arange(len(low)), n)
            at = order[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]
            start = pos[at] - offset[which]
            ok = start >= 0
            at, which, start = at[ok], which[ok], start[ok]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (text[at], pat[which], offset[which], start, rank[at])], names=["text_id", "pat_id", "offset", "pos", "rank"])

    found = index.select(*COLUMNS).where(wanted).mapInArrow(run, schema)
    parts = {p: sum(x[0] == p for x in pieces) for p in {x[0] for x in pieces}}
    long = [p for p, n in parts.items() if n > 1]
    if not long:
        return found.drop("offset")
    short = found.where(~F.col("pat_id").isin(long)).drop("offset")
    size = F.create_map(*(F.lit(x) for p in long for x in (p, parts[p])))
    whole = found.where(F.col("pat_id").isin(long)).groupBy("text_id", "pat_id", "pos").agg(F.count("*").alias("n"), F.max(F.when(F.col("offset") == 0, F.col("rank"))).alias("rank"))
    return short.unionByName(whole.where(F.col("n") == size[F.col("pat_id")]).select("text_id", "pat_id", "pos", "rank"))


def runs(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pat_id, lo, hi): the half-open run of slots of each pattern in each text that holds it."""
    return occurrences(index, patterns).groupBy("text_id", "pat_id").agg(F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"))


def counts(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pat_id, cnt) over all texts; patterns that don't occur have 0."""
    found = occurrences(index, patterns).groupBy("pat_id").agg(F.count("*").alias("cnt"))
    return patterns.select(F.col("pat_id").cast("int").alias("pat_id")).join(found, "pat_id", "left").fillna(0, ["cnt"])
