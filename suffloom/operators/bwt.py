"""Burrows-Wheeler transform, symbol counts, rank and the LF step, from the table of suffixes.

`large` takes distributed running sums instead of a window over a text, for texts that one task
shouldn't hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suffloom.functions.kernel import invert_bwts
from suffloom.operators.ranking import prefix_sums
from suffloom.operators.shared import joined, once, written
from suffloom.operators.suffix_array import text_runs
from suffloom.shipping import ship


def bwt(suf: DataFrame) -> DataFrame:
    """(text_id, rank, sym): the byte before each suffix; 0 in the slot of position 0."""
    return suf.select("text_id", "rank", F.col("prev").alias("sym"))


def primary_index(suf: DataFrame) -> DataFrame:
    """(text_id, i0): the slot of position 0."""
    return suf.where("pos = 0").select("text_id", F.col("rank").alias("i0"))


def symbol_counts(suf: DataFrame) -> DataFrame:
    """(text_id, sym, cnt) over the text's bytes."""
    return suf.groupBy("text_id", "sym").agg(F.count("*").alias("cnt"))


def byte_histogram(texts: DataFrame) -> DataFrame:
    """(sym, cnt) over all texts, without exploding their bytes: a partial histogram a task, then a sum."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for _, some in text_runs(batches):
            total += np.bincount(np.frombuffer(b"".join(some), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["sym", "cnt"])

    return texts.select("text_id", "bytes").mapInArrow(run, "sym int, cnt bigint").groupBy("sym").agg(F.sum("cnt").alias("cnt"))


def c_array(suf: DataFrame) -> DataFrame:
    """(text_id, sym, cnt, c): c counts the bytes of the text that are less. At most 256 rows a text."""
    before = Window.partitionBy("text_id").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return symbol_counts(suf).withColumn("c", F.coalesce(F.sum("cnt").over(before), F.lit(0)).cast("long"))


def running(rows: DataFrame, group: list[str], order: str, value: Column, out: str, large: bool = False, inclusive: bool = False) -> DataFrame:
    """rows with the sum of `value` over the rows before (and itself, if inclusive) in its group."""
    rows = rows.withColumn("__value", value.cast("long"))
    if large:
        rows = prefix_sums(rows, [*group, order], "__value", "__before")
        rows = written(rows, "running")
        base = rows.groupBy(*group).agg(F.min(F.struct(order, "__before"))["__before"].alias("__base"))
        rows = joined(rows, base, group).withColumn(out, F.col("__before") - F.col("__base")).drop("__before", "__base")
        if inclusive:
            rows = rows.withColumn(out, F.col(out) + F.col("__value"))
    else:
        end = 0 if inclusive else -1
        window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        rows = rows.withColumn(out, F.coalesce(F.sum("__value").over(window), F.lit(0)).cast("long"))
    return rows.drop("__value")


def occurrences(suf: DataFrame, large: bool = False) -> DataFrame:
    """(text_id, rank, sym, occ): how often the slot's symbol occurs in the BWT before it."""
    return running(bwt(suf), ["text_id", "sym"], "rank", F.lit(1), "occ", large)


def rank_queries(suf: DataFrame, queries: DataFrame, large: bool = False) -> DataFrame:
    """queries (text_id, i, sym) with occ: how often sym occurs in BWT[0, i)."""
    marks = queries.select("text_id", "sym", F.col("i").alias("at"), F.lit(0).alias("mark"), F.monotonically_increasing_id().alias("__q"))
    rows = bwt(suf).select("text_id", "sym", F.col("rank").alias("at"), F.lit(1).alias("mark"), F.lit(None).cast("long").alias("__q"))
    both = rows.unionByName(marks).withColumn("__order", F.struct("at", "mark", F.coalesce("__q", F.lit(-1).cast("long")).alias("q")))
    return running(both, ["text_id", "sym"], "__order", F.col("mark"), "occ", large).where("mark = 0").select("text_id", F.col("at").alias("i"), "sym", "occ")


def approximate_occurrences(suf: DataFrame, log: int, large: bool = False) -> DataFrame:
    """(text_id, rank, sym, occ): as occurrences(), from each 2**log-th occurrence only, so at most 2**log - 1 too low."""
    step = 1 << log
    return occurrences(suf, large).withColumn("occ", (F.floor(F.col("occ") / step) * step).cast("long"))


def rank_samples(suf: DataFrame, log: int, large: bool = False) -> DataFrame:
    """(text_id, sym, rank): the slots of each 2**log-th occurrence of a symbol in the BWT; a table to keep, smaller by that factor."""
    step = 1 << log
    return occurrences(suf, large).where((F.col("occ") + 1) % step == 0).select("text_id", "sym", "rank")


def approximate_rank(samples: DataFrame, queries: DataFrame, log: int, large: bool = False) -> DataFrame:
    """queries (text_id, i, sym) with occ: how often sym occurs in BWT[0, i), at most 2**log - 1 too low, from rank_samples() alone."""
    marks = queries.select("text_id", "sym", F.struct(F.col("i").alias("at"), F.lit(0).alias("mark"), F.monotonically_increasing_id().alias("q")).alias("__order"), F.lit(0).alias("mark"))
    rows = samples.select("text_id", "sym", F.struct(F.col("rank").alias("at"), F.lit(1).alias("mark"), F.lit(-1).cast("long").alias("q")).alias("__order"), F.lit(1).alias("mark"))
    counted = running(rows.unionByName(marks), ["text_id", "sym"], "__order", F.col("mark"), "occ", large)
    return counted.where("mark = 0").select("text_id", F.col("__order.at").alias("i"), "sym", (F.col("occ") * (1 << log)).alias("occ"))


def lf_mapping(suf: DataFrame, large: bool = False) -> DataFrame:
    """(text_id, rank, lf): the slot of the suffix one longer, for all but the whole text's."""
    suf = once(suf, "suffixes")
    last = suf.where(F.col("pos") == F.col("n") - 1).select("text_id", F.col("sym").alias("last"))
    rows = running(suf.where("pos > 0").select("text_id", "rank", F.col("prev").alias("sym")), ["text_id", "sym"], "rank", F.lit(1), "occ", large)
    rows = joined(joined(rows, c_array(suf).select("text_id", "sym", "c"), ["text_id", "sym"]), last, "text_id")
    return rows.select("text_id", "rank", (F.col("c") + F.col("occ") + (F.col("sym") == F.col("last")).cast("long")).alias("lf"))


#: Rows that are rebuilt at once, if they are whole texts.
_RUN = 1 << 20


def _inverted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of rows (text_id, rank, value) in order; rank -2 has the slot of position 0, rank -1 the last byte."""
    for ids, rank, value in _whole_texts(batches):
        begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows = np.diff(np.append(begins, len(ids)))
        full = (rows > 2) & (rank[begins] == -2) & (rank[np.minimum(begins + 1, len(ids) - 1)] == -1)
        begins, sizes = begins[full], rows[full] - 2
        if not len(begins):
            continue
        slots = np.repeat(full, rows) & (rank >= 0)
        ends = np.cumsum(sizes)
        out = invert_bwts(value[slots], sizes, value[begins], value[begins + 1])
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        texts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([pa.array(ids[begins]), texts], names=["text_id", "bytes"])


def _whole_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows in order of text_id, about _RUN at a time; a text's rows stay together."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if count >= _RUN and new[0][-1] != held[0][0][0]:
            held.append(new)
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield [x[:cut] for x in rows]
            held, count = [[x[cut:] for x in rows]], len(rows[0]) - cut
        else:
            held.append(new)
            count += b.num_rows
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def inverse_bwt(transform: DataFrame, primary: DataFrame, last: DataFrame) -> DataFrame:
    """(text_id, bytes) from (text_id, rank, sym), (text_id, i0) and (text_id, last). A text is rebuilt by one task, many at a time.
    What is known of a text comes as rows before its own, so that there is one shuffle and no join."""
    ship(transform.sparkSession)
    marks = primary.select("text_id", F.lit(-2).cast("long").alias("rank"), F.col("i0").cast("long").alias("value"))
    marks = marks.unionByName(last.select("text_id", F.lit(-1).cast("long").alias("rank"), F.col("last").cast("long").alias("value")))
    rows = transform.select("text_id", "rank", F.col("sym").cast("long").alias("value")).unionByName(marks).where("text_id IS NOT NULL")
    return rows.repartition("text_id").sortWithinPartitions("text_id", "rank").mapInArrow(_inverted, "text_id bigint, bytes binary")
