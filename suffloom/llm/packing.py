"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents are cut into full sequences and a rest. Rests are binned by length; a pattern
says how many rests of each bin share a sequence of the full length or of a power of two,
which needs no padding. A linear program over patterns covers the histogram, a knapsack by
dynamic programming prices new patterns, and the rounded patterns are dealt to the rests
by their rank within a bin. What then is missing to a sequence's length is cut from a few
of the full pieces, laid end to end. The program's size depends on the number of bins only;
ranks come from counts for each part of the input, so no bin's rests ever meet in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suffloom.llm.common import release_memory, table, text_batches, vocabulary_path, written
from suffloom.llm.token_counts import unit_table
from suffloom.operators.ranking import prefix_sums

#: A worker's table of units and their ids while a task runs; fewer than for counts, as ids take memory, too.
MOST_UNITS = 300_000


def _price(value: np.ndarray, sizes: np.ndarray, ends: dict[int, float]) -> tuple[float, Counter, float]:
    """The pattern most valuable for its cost, as (value over cost, pattern, cost): an unbounded knapsack by
    dynamic programming, read at each length in `ends` that a sequence may have, with its cost."""
    capacity = max(ends)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            got = best[c - sizes[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], choice[c] = got[i], i
    c = max(ends, key=lambda e: (best[e] / ends[e], e))
    worth, cost = float(best[c] / ends[c]), ends[c]
    pattern: Counter = Counter()
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[int(choice[c])] += 1
            c -= int(sizes[choice[c]])
    return worth, pattern, cost


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. The matrix is small, and a threaded LAPACK in the driver can stall beside the JVM."""
    m = len(matrix)
    a = np.hstack([matrix, np.eye(m)])
    for j in range(m):
        k = j + int(np.abs(a[j:, j]).argmax())
        if k != j:
            a[[j, k]] = a[[k, j]]
        a[j] /= a[j, j]
        factor = a[:, j].copy()
        factor[j] = 0
        a -= np.outer(factor, a[j])
    return a[:, m:]


def cutting_stock(demand: dict[int, int], capacity: int, short: dict[int, float] | None = None, gap: float = 5e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> items) with how often each is used; together they hold exactly `demand`.

    short: further lengths of sequences with their costs, where one of `capacity` costs 1.
    Column generation: simplex over the restricted master with one row per size in demand,
    starting from patterns of one size each. The best price bounds the program's optimum from
    below (its value so far over that price); it ends when the value is proven to be within the
    share `gap` of the optimum. Fractions are rounded down, and what is left, less than one
    sequence for each pattern, is dealt by best fit, the largest first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), int)
    m = len(sizes)
    if not m:
        return []
    ends = {**(short or {}), capacity: 1.0}
    need = np.array([demand[int(s)] for s in sizes], float)
    # Demands that differ by a trifle keep the simplex from standing still at ties.
    x = (need * (1 + 1e-9 * np.arange(m))) / (capacity // sizes)
    right = x * (capacity // sizes)
    basis = [Counter({i: int(capacity // s)}) for i, s in enumerate(sizes)]
    costs = np.ones(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    since = 0
    while True:
        duals = np.einsum("i,ij", costs, inverse)
        worth, column, cost = _price(np.maximum(duals, 0), sizes, ends)
        if worth * (1 - gap) <= 1:
            break
        entering = np.zeros(m)
        for i, n in column.items():
            entering[i] = n
        d = np.einsum("ij,j", inverse, entering)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        x = x - ratio[r] * d
        x[r] = ratio[r]
        x = np.maximum(x, 0)
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
        basis[r], costs[r] = column, cost
        since += 1
        if since == 200:  # the inverse gathers rounding errors
            since = 0
            matrix = np.zeros((m, m))
            for j, p in enumerate(basis):
                for i, n in p.items():
                    matrix[i, j] = n
            inverse = _inverse(matrix)
            x = np.maximum(np.einsum("ij,j", inverse, right), 0)
    left = need.astype(np.int64)
    used: list[tuple[dict[int, int], int]] = []
    for p, n in zip(basis, np.floor(x + 1e-6).astype(np.int64), strict=True):
        n = int(min([n, *(left[i] // k for i, k in p.items())]))
        if n > 0:
            for i, k in p.items():
                left[i] -= n * k
            used.append(({int(sizes[i]): k for i, k in p.items()}, n))
    # The rest: the largest item that still fits, again and again. Equal sequences are made together.
    while left.any():
        p, room = Counter(), capacity
        for i in range(m - 1, -1, -1):
            k = int(min(left[i], room // sizes[i]))
            if k:
                p[i] += k
                room -= k * int(sizes[i])
        n = int(min(left[i] // k for i, k in p.items()))
        for i, k in p.items():
            left[i] -= n * k
        used.append(({int(sizes[i]): k for i, k in p.items()}, n))
    return used


@dataclass(frozen=True)
class Deal:
    """Where the items of one bin go: pattern by pattern, from rank `begin`, `each` to a sequence."""

    begin: np.ndarray
    first: np.ndarray
    each: np.ndarray


def deals(patterns: list[tuple[dict[int, int], int]]) -> dict[int, Deal]:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    dealt: Counter = Counter()
    sequence = 0
    for p, n in patterns:
        for size, k in p.items():
            runs.setdefault(size, []).append((dealt[size], sequence, k))
            dealt[size] += n * k
        sequence += n
    return {s: Deal(*(np.array(x, np.int64) for x in zip(*r, strict=True))) for s, r in runs.items()}


def _closed_length(fill: Column, capacity: int) -> Column:
    """The shortest length of at least `fill` that needs no padding: a power of two or the capacity."""
    out = F.lit(capacity)
    size = 1 << (capacity.bit_length() - 1)
    while size:
        out = F.when(fill <= size, size).otherwise(out)
        size >>= 1
    return out.cast("long")


def pack(documents: DataFrame, path: str, key: str = "doc_id", capacity: int = 2048, grain: int = 16, end_id: int = 1, spare: int = 16) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's token ids and then `end_id`; a null or empty text is `end_id`
    alone. Documents are cut after each `capacity` ids; the rest is binned by its length over
    `grain`, rounded up. Sequences hold at most `capacity` ids; one whose length is a power of two
    needs no padding, so patterns may end there. Every `spare`-th full piece keeps its ids: as many
    of these as it takes are cut further, to close the other sequences' gaps. If there are too few,
    the sequences that come last keep their gaps. Each id lies in exactly one piece, and offsets in
    a sequence have no gaps. Repeated rows are packed each for itself. Ties: rests of a bin are
    ranked by part of the input and place in it. An empty table gives an empty result. Other
    columns are ignored. Pieces (no texts, of one full piece in `spare` the ids) are written.
    """
    bins = -(-capacity // grain)
    full, kept_full = bins + 1, bins + 2

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unit_table(path, "ids", most=MOST_UNITS)
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        whole = 0
        end = np.array([end_id], "<u4")
        for b in text_batches(batches, 1 << 20):
            row, out, raws = [], [], []
            for i, (n, found) in enumerate(known.texts(b.column("text"))):
                ids = memoryview(np.concatenate([found, end]).astype("<u4", copy=False).view(np.uint8))
                total = n + 1
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    raw = ids[4 * start : 4 * (start + length)]
                    if length == capacity:
                        size = full if whole % spare else kept_full
                        whole += 1
                    else:
                        size = -(-length // grain)
                    row.append(i)
                    out.append((start, length, zlib.crc32(raw), total, size, seen[size]))
                    raws.append(bytes(raw) if size == kept_full else None)
                    seen[size] += 1
            cols = np.array(out, np.int64).reshape(-1, 6)
            names = ["start", "length", "ids_crc32", "doc_tokens", "size", "place"]
            arrays = [b.column(key).take(pa.array(row, pa.int64())), *(pa.array(cols[:, i]) for i in range(6)), pa.array(np.full(len(out), part, np.int64)), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *names, "part", "ids"])
        # Workers outlive the task: a full table in each would add up beside the executor's heap.
        known.shrink()
        release_memory()

    kind = documents.schema[key].dataType.simpleString()
    pieces = documents.select(key, documents["text"].cast("string").alias("text")).mapInArrow(
        cut, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, size bigint, place bigint, part bigint, ids binary"
    )
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("part", "size").agg(F.count("*").alias("n"))
    total = {int(r["size"]): int(r["n"]) for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most bins + 2 rows
    n_full, n_kept = total.pop(full, 0), total.pop(kept_full, 0)
    # Shorter sequences must pay: each costs a little more than its share of a long one.
    short = {(1 << e) // grain: (1 << e) / capacity + 0.002 for e in range(capacity.bit_length()) if (1 << e) % grain == 0 and 1 << e < capacity}
    patterns = cutting_stock(total, bins, short)
    n_packed = sum(n for _, n in patterns)
    to = deals([*patterns, ({full: 1}, n_full)] if n_full else patterns)
    before = counts.select("part", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                d = to[int(s)]
                k = np.searchsorted(d.begin, rank[at], side="right") - 1
                inner = rank[at] - d.begin[k]
                sequence[at] = d.first[k] + inner // d.each[k]
                slot[at] = (full - s) * (capacity + 1) + inner % d.each[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(sequence), pa.array(slot)], names=[*kept, "sequence_id", "slot"])

    kept = [key, "start", "length", "ids_crc32", "doc_tokens"]
    result = [*kept, "sequence_id", "offset"]
    ranked = pieces.join(before, ["part", "size"]).withColumn("rank", F.col("before") + F.col("place"))
    dealt = ranked.where(F.col("size") <= full).select(*kept, "size", "rank").mapInArrow(assign, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    within = Window.partitionBy("sequence_id")
    dealt = dealt.withColumns({"offset": F.sum("length").over(within.orderBy("slot")) - F.col("length"), "fill": F.sum("length").over(within)})
    if not n_kept:
        return dealt.select(*result)
    dealt = written(dealt.select(*result, "fill"), "dealt")
    gaps = dealt.where((F.col("offset") == 0) & (F.col("sequence_id") < n_packed)).select("sequence_id", "fill", (_closed_length(F.col("fill"), capacity) - F.col("fill")).alias("gap")).where("gap > 0")
    missing = gaps.agg(F.sum("gap")).first()[0] or 0
    used = min(n_kept, -(-missing // capacity))
    line = used * capacity
    lying = prefix_sums(gaps, ["sequence_id"], "gap", "before").select("sequence_id", "fill", "gap", "before")
    # What is left of the last piece makes sequences of powers of two.
    at, sequence, ends = missing, n_packed + n_full + n_kept - used, []
    while at < line:
        size = 1 << ((line - at).bit_length() - 1)
        ends.append((sequence, 0, size, at))
        at, sequence = at + size, sequence + 1
    if ends:
        # Literals, as rows from the driver's Python would start further workers in each executor.
        rows = F.array(*(F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(e, lying.columns, strict=True))) for e in ends))
        lying = lying.unionByName(documents.sparkSession.range(0, 1, 1, 1).select(F.inline(rows)))
    last = F.least(F.col("before") + F.col("gap"), F.lit(line)) - 1
    wanted = lying.where(F.col("before") < line).withColumn("rank", F.explode(F.sequence(F.floor(F.col("before") / capacity), F.floor(last / capacity))))
    spares = ranked.where(F.col("size") == kept_full).select(*kept, "rank", "ids")
    begin, stop = F.greatest("before", F.col("rank") * capacity), F.least(F.col("before") + F.col("gap"), (F.col("rank") + 1) * capacity)
    inner = begin - F.col("rank") * capacity
    closing = spares.where(F.col("rank") < used).join(wanted, "rank").select(
        key,
        (F.col("start") + inner).alias("start"),
        (stop - begin).alias("length"),
        F.crc32(F.substring("ids", (4 * inner + 1).cast("int"), (4 * (stop - begin)).cast("int"))).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        (F.col("fill") + begin - F.col("before")).alias("offset"),
    )
    whole = spares.where(F.col("rank") >= used).select(*kept, (F.col("rank") - used + n_packed + n_full).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.select(*result).unionByName(closing).unionByName(whole)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
