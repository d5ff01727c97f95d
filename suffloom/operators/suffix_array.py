"""Suffix arrays of texts in a DataFrame, in unsigned byte order, end of text least.

Texts are rows (text_id, bytes). Results have one row for each byte of each text:
text_id, pos (0-based), rank (the suffix' slot), n (the text's length), sym (the byte at pos)
and prev (the byte before, 0 at pos 0). All other operators follow from these. On demand, key
holds a suffix' first seven symbols as a number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suffloom.functions.kernel import FIRST_SYMBOLS, first_keys, sort_suffixes
from suffloom.operators.ranking import prefix_sums
from suffloom.operators.shared import fresh_path, joined, recorded, remove, written
from suffloom.shipping import ship
from suffloom.sources.arrays import ArrayStore

#: Longer texts aren't sorted by one task.
KERNEL_LIMIT = 8 << 20
SCHEMA = "text_id bigint, pos bigint, rank bigint, n bigint, sym int, prev int"
_BATCH, _ROWS = 2 << 20, 1 << 18
_SPREAD = 16 << 20


def spread(texts: DataFrame, total: int | None = None) -> DataFrame:
    """texts over all cores, and at most some _SPREAD bytes to a task: however large, a row group is read by one task, and
    suffix sorting costs far more than moving it."""
    if total is None:
        total = texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = max(min(2 * cores, total // (256 << 10)), -(-total // _SPREAD))
    return texts.repartition(parts, "text_id") if parts > 1 else texts


def texts_of(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(text_id, bytes) of a table; null texts have no suffixes and are left out."""
    return df.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("text_id"), F.col(text_column).cast("binary").alias("bytes"))


def corpus_of(df: DataFrame, id_column: str, text_column: str, separator: str = "\n") -> DataFrame:
    """All of a small table's texts as one text, in the order of their ids, with a separator between."""
    joined = F.concat_ws(separator, F.transform(F.sort_array(F.collect_list(F.struct(id_column, text_column))), lambda x: x[text_column]))
    return df.where(F.col(text_column).isNotNull()).agg(joined.alias("t")).select(F.lit(0).cast("long").alias("text_id"), F.col("t").cast("binary").alias("bytes"))


def text_runs(batches: Iterable[pa.RecordBatch], limit: int = _BATCH) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts, about `limit` bytes at a time."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column("text_id").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sorted_rows(columns: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_runs(batches):
            starts, order = sort_suffixes(texts)
            n, sizes = len(order), np.diff(starts)
            text = np.repeat(np.arange(len(texts)), sizes)
            made = {"pos": lambda: order, "rank": lambda: np.arange(n) - starts[text], "text_id": lambda: np.array(ids, np.int64)[text], "n": lambda: sizes[text]}
            if "key" in columns:
                left = np.repeat(starts[1:], sizes) - np.arange(n)
                keys = first_keys(np.frombuffer(b"".join(texts), np.uint8), left)
                made["key"] = lambda: keys[starts[text] + order]
            if "sym" in columns or "prev" in columns:
                symbols = np.frombuffer(b"".join(texts), np.uint8)
                at = starts[text] + order
                made |= {"sym": lambda: symbols[at].astype(np.int32), "prev": lambda: np.where(order > 0, symbols[at - 1], 0).astype(np.int32)}
            whole = pa.RecordBatch.from_arrays([pa.array(made[c]()) for c in columns], names=columns)
            for k in range(0, n, _ROWS):
                yield whole.slice(k, _ROWS)

    return run


def by_kernel(texts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each text is sorted by one task. No shuffle. Only the columns asked for are made and sent."""
    ship(texts.sparkSession)
    columns = columns or [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kinds = dict(x.split(" ") for x in f"{SCHEMA}, key bigint".split(", "))
    return texts.select("text_id", "bytes").mapInArrow(_sorted_rows(columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def by_windows(texts: DataFrame) -> DataFrame:
    """Catalyst only: each suffix as a value, sorted in a window over its text. Quadratic in a text's bytes."""
    byte = lambda at: F.conv(F.hex(F.substring("bytes", at, F.lit(1))), 16, 10).cast("int")
    n = F.octet_length("bytes")
    each = texts.where(n > 0).select("text_id", "bytes", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("p"))
    rank = F.expr("row_number() over (partition by text_id order by substring(bytes, p + 1)) - 1").cast("long")
    prev = F.when(F.col("p") == 0, 0).otherwise(byte(F.col("p")))
    return each.select("text_id", F.col("p").cast("long").alias("pos"), rank.alias("rank"), "n", byte(F.col("p") + 1).alias("sym"), prev.alias("prev"))


def _keyed(text_id: int, begin: int, n: int, body: bytes, before: int, after: bytes) -> Iterator[pa.RecordBatch]:
    """Each suffix' first symbols as a number, for the suffixes that begin in a text's bytes from `begin` on."""
    whole = np.frombuffer(body + after[:FIRST_SYMBOLS], np.uint8)
    size = len(body)
    for k in range(0, size, _ROWS):
        end = min(size, k + _ROWS)
        part = whole[k : end + FIRST_SYMBOLS]
        pos = begin + np.arange(k, end)
        key = first_keys(part, n - begin - k - np.arange(len(part)))[: end - k]
        prev = np.empty(end - k, np.int32)
        prev[0] = whole[k - 1] if k else before
        prev[1:] = whole[k : end - 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(end - k, text_id, np.int64)), pa.array(pos), pa.array(key), pa.array(np.full(end - k, n, np.int64)), pa.array(whole[k:end].astype(np.int32)), pa.array(prev)], names=["text_id", "pos", "key", "n", "sym", "prev"])


def _keys_of_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, t in zip(b.column("text_id").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            yield from _keyed(i, 0, len(t), t, 0, b"")


def _keys_of_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield from _keyed(r["text_id"], r["begin"], r["n"], r["bytes"], r["before"], r["after"])


def _ranked_by_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _keys_of_texts, of texts that a task can hold, with each suffix' rank by its first symbols in its text, whether no
    other shares it (done), and whether that holds for all of its text (settled)."""
    for ids, texts in text_runs(batches):
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(starts[-1])
        if not n:
            continue
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        text = np.repeat(np.arange(len(texts)), sizes)
        key = first_keys(symbols, starts[1:][text] - np.arange(n))
        order = np.lexsort((key, text))
        k, pos = key[order], order - starts[text]  # a text's slots are where its bytes are
        begins = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (text[1:] != text[:-1])]))
        shared = np.diff(np.append(begins, n))
        rank = np.repeat(begins, shared) - starts[text]
        done = np.repeat(shared == 1, shared)
        settled = np.bincount(text[~done], minlength=len(texts)) == 0
        prev = np.where(pos > 0, symbols[order - 1], 0).astype(np.int32)
        made = [np.array(ids, np.int64)[text], pos, k, sizes[text], symbols[order].astype(np.int32), prev, rank, done, settled[text]]
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["text_id", "pos", "key", "n", "sym", "prev", "rank", "done", "settled"])
        for at in range(0, n, _ROWS):
            yield whole.slice(at, _ROWS)


_KEYED = "text_id bigint, pos bigint, key bigint, n bigint, sym int, prev int"


def by_doubling(texts: DataFrame, partitions: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Distributed prefix doubling of texts that fit a row. Texts that a task can hold get their first ranks there, without a
    shuffle; those in which no two suffixes share their first symbols need no more. The others' rounds are distributed."""
    ship(texts.sparkSession)
    columns = columns or [x.split(" ")[0] for x in SCHEMA.split(", ")]
    texts = texts.select("text_id", "bytes")
    size = F.octet_length("bytes")
    first = written(texts.where(size <= KERNEL_LIMIT).mapInArrow(_ranked_by_keys, f"{_KEYED}, rank bigint, done boolean, settled boolean"), "symbols")
    out, rest, long = first.where("settled").select(*columns), first.where("NOT settled").drop("settled"), texts.where(size > KERNEL_LIMIT)
    if not rest.isEmpty():
        out = out.unionByName(_doubled(rest, partitions).select(*columns))
    if not long.isEmpty():
        out = out.unionByName(_doubled(written(long.mapInArrow(_keys_of_texts, _KEYED), "symbols"), partitions).select(*columns))
    return out


def of_chunks(chunks: DataFrame, partitions: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The table of suffixes of texts that come as chunks (see sources.chunks): a text may be longer than a row or a task can be."""
    ship(chunks.sparkSession)
    return _doubled(written(chunks.mapInArrow(_keys_of_chunks, _KEYED), "symbols"), partitions).select(*(columns or [x.split(" ")[0] for x in SCHEMA.split(", ")]))


#: Ranks to a file.
_BLOCK = 1 << 22


def _with_ranks(rows: DataFrame, ranks: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the columns of ranks (on, count, ...). Keys that many rows share, of which there are few, are broadcast;
    a shuffle spreads the others evenly."""
    limit = max(64, total // 4096)
    heavy = F.broadcast(ranks.where(F.col("count") > limit))  # fewer than 4096 rows
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").hint("merge").join(ranks.where(F.col("count") <= limit), on))


class _Ranks:
    """Ranks by position, in files of the shared folder that tasks map: one for each run of _BLOCK positions."""

    def __init__(self, store: ArrayStore, size: int):
        self.store, self.size = store, size

    def put(self, rows: DataFrame) -> DataFrame:
        """Enters the ranks of rows (at, end, rank, done). Returns those that aren't done, block by block. A task run twice enters the same."""
        store, size = self.store, self.size

        def run(key: tuple, part: pa.Table) -> pa.Table:
            k = key[0].as_py()
            at = part.column("at").to_numpy() - k * _BLOCK
            n = min(_BLOCK, size - k * _BLOCK)
            ranks = np.zeros(n, "<i8") if len(at) == n else np.array(store.get(str(k), "<i8"))
            ranks[at] = part.column("rank").to_numpy()
            store.put(str(k), ranks)
            left = part.filter(pc.invert(part.column("done")))
            return left.select(["at", "end", "rank"])

        block = F.floor(F.col("at") / _BLOCK).alias("block")
        return written(rows.select("at", "end", "rank", "done", block).groupBy("block").applyInArrow(run, "at bigint, end bigint, rank bigint"), "open")

    def at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        block = places // _BLOCK
        for k in np.unique(block):
            here = block == k
            out[here] = self.store.get(str(k), "<i8")[places[here] - k * _BLOCK]
        return out


def _doubled(rows: DataFrame, partitions: int | None) -> DataFrame:
    """No task holds a text, however long its repeats. rows are files; they may hold their texts' first ranks.

    Ranks are counts of lesser keys, so that a key that many suffixes share is one row. Texts lie end to
    end, and ranks by place in files. Each round takes only suffixes that still share their rank: it looks up
    the rank h further on in the files, ranks them anew by both and enters their new ranks. What is
    settled is neither read again nor shuffled. Rounds: about log2 of the longest repeat over seven.
    """
    spark = rows.sparkSession
    if partitions is None:  # as many as hold 64 MiB of the written rows each
        conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(conf, int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >> 26)
    sizes = rows.where("pos = 0").select("text_id", "n")
    bases = written(prefix_sums(sizes, ["text_id"], "n", "base", partitions).select("text_id", "base"), "bases")
    total = rows.count()
    ranks = _Ranks(ArrayStore(fresh_path(spark, "ranks")), total)
    few = bases.count() <= 100_000
    based = rows.join(F.broadcast(bases), "text_id") if few else joined(rows, bases, "text_id")
    place = [(F.col("base") + F.col("pos")).alias("at"), (F.col("base") + F.col("n")).alias("end")]
    with recorded() as made:
        if "rank" in rows.columns:
            open_ = ranks.put(based.select(*place, (F.col("base") + F.col("rank")).alias("rank"), "done"))
        else:
            counts = rows.groupBy("text_id", "key").agg(F.count("*").alias("count"))
            first = written(prefix_sums(counts, ["text_id", "key"], "count", "rank", partitions), "sums")
            placed = _with_ranks(based.select("text_id", "key", *place), first, ["text_id", "key"], total)
            open_ = ranks.put(placed.select("at", "end", "rank", (F.col("count") == 1).alias("done")))
    h = FIRST_SYMBOLS
    while not open_.isEmpty():

        def ahead(batches: Iterable[pa.RecordBatch], h: int = h) -> Iterator[pa.RecordBatch]:
            for b in batches:
                after = b.column("at").to_numpy() + h
                second = np.zeros(len(after), np.int64)
                inside = after < b.column("end").to_numpy()
                second[inside] = ranks.at(after[inside]) + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(second)], names=["at", "end", "rank", "second"])

        *over, last = made
        for path in over:  # the open rows were written last; what they came from has served
            remove(spark, path)
        with recorded() as made:
            open_ = _round(open_, ahead, ranks, total, partitions)
        made.insert(0, last)
        h *= 2

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = b.column("base").to_numpy()
            rank = ranks.at(base + b.column("pos").to_numpy()) - base
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(rank)], names=[*kept, "rank"])

    kept = ["text_id", "pos", "n", "sym", "prev", "key"]
    out = based.select(*kept, "base").mapInArrow(ranked, "text_id bigint, pos bigint, n bigint, sym int, prev int, key bigint, rank bigint")
    return out.select("text_id", "pos", "rank", "n", "sym", "prev", "key")


def _round(open_: DataFrame, ahead: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], ranks: _Ranks, total: int, partitions: int) -> DataFrame:
    """Ranks the open suffixes by their rank and the one further on; returns those that are still open."""
    seconds = written(open_.select("at", "end", "rank").mapInArrow(ahead, "at bigint, end bigint, rank bigint, second bigint"), "seconds")
    sums = written(prefix_sums(seconds.groupBy("rank", "second").agg(F.count("*").alias("count")), ["rank", "second"], "count", "before", partitions), "sums")
    base = sums.groupBy("rank").agg(F.min("before").alias("base"))
    new = written(joined(sums, base, "rank").select("rank", "second", "count", (F.col("rank") + F.col("before") - F.col("base")).alias("new")), "new")
    moved = _with_ranks(seconds, new, ["rank", "second"], total)
    return ranks.put(moved.select("at", "end", F.col("new").alias("rank"), (F.col("count") == 1).alias("done")))


def suffixes(texts: DataFrame, strategy: str = "auto", partitions: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The table that all operators start from, or those of its columns that are asked for. strategy: kernel, windows, doubling, or auto, which takes
    the kernel unless a text is longer than KERNEL_LIMIT bytes; then that text is doubled and the
    others still go to the kernel. Empty texts have no rows."""
    columns = columns or [x.split(" ")[0] for x in SCHEMA.split(", ")]
    if strategy == "kernel":
        return by_kernel(texts, columns)
    if strategy == "windows":
        return by_windows(texts).select(*columns)
    if strategy == "doubling":
        return by_doubling(spread(texts), partitions, columns)
    if strategy != "auto":
        raise ValueError(f"no such strategy: {strategy}")
    size = F.octet_length("bytes")
    longest, total = texts.agg(F.max(size), F.sum(size)).first()
    texts = spread(texts, total or 0)
    if (longest or 0) <= KERNEL_LIMIT:
        return by_kernel(texts, columns)
    return by_kernel(texts.where(size <= KERNEL_LIMIT), columns).unionByName(by_doubling(texts.where(size > KERNEL_LIMIT), partitions, columns))


def suffix_array(texts: DataFrame, strategy: str = "auto") -> DataFrame:
    """(text_id, rank, pos)"""
    return suffixes(texts, strategy, columns=["text_id", "rank", "pos"])


def inverse_suffix_array(texts: DataFrame, strategy: str = "auto") -> DataFrame:
    """(text_id, pos, rank)"""
    return suffixes(texts, strategy, columns=["text_id", "pos", "rank"])


def sampled(suf: DataFrame, every: int) -> DataFrame:
    """The inverse at each `every`-th position and at the last one."""
    return suf.where((F.col("pos") % every == 0) | (F.col("pos") == F.col("n") - 1)).select("text_id", "pos", "rank")


def order_faults(suf: DataFrame) -> DataFrame:
    """(text_id, n, positions, faults) of a table of suffixes (text_id, pos, rank, sym): a proof of its order without
    comparing suffixes. A suffix array is right if each slot's first byte and, where these are equal, the rank
    of the suffix behind it ascend. positions: the sum of them; faults: slots out of order or that don't follow each other."""
    by_pos = Window.partitionBy("text_id").orderBy("pos")
    by_rank = Window.partitionBy("text_id").orderBy("rank")
    rows = suf.select("text_id", "pos", "rank", "sym", F.coalesce(F.lead("rank").over(by_pos), F.lit(-1).cast("long")).alias("following"))
    here, before = F.struct("sym", "following"), F.struct(F.lag("sym").over(by_rank).alias("sym"), F.lag("following").over(by_rank).alias("following"))
    gap = F.col("rank") != F.coalesce(F.lag("rank").over(by_rank) + 1, F.lit(0))
    rows = rows.withColumn("fault", (gap | (F.col("rank") > 0) & (before >= here)).cast("long"))
    return rows.groupBy("text_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"), F.sum("fault").alias("faults"))


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_runs(batches):
        starts, order = sort_suffixes(texts)
        n, sizes = len(order), np.diff(starts)
        if not n:
            continue
        yield order_checked(np.array(ids, np.int64), np.frombuffer(b"".join(texts), np.uint8), sizes, order)


def order_checked(ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> pa.RecordBatch:
    """order_faults() of texts end to end and their arrays: a row for each text that isn't empty. A slot whose position isn't its own is a fault, too."""
    starts, n = np.cumsum(sizes) - sizes, len(order)
    text, slot = np.repeat(np.arange(len(sizes)), sizes), np.arange(n)
    at = starts[text] + order
    rank = np.full(n, -1, np.int64)
    rank[at] = slot
    following = np.full(n, -1, np.int64)
    inner = order + 1 < sizes[text]
    following[inner] = rank[at[inner] + 1]
    sym = symbols[at]
    fault = rank[at] != slot
    later = slot[1:] != starts[text[1:]]
    fault[1:] |= later & ((sym[:-1] > sym[1:]) | (sym[:-1] == sym[1:]) & (following[:-1] >= following[1:]))
    some = np.flatnonzero(sizes)
    sums = (np.add.reduceat(x.astype(np.int64), starts[some]) for x in (order, fault))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], sizes[some], *sums)], names=["text_id", "n", "positions", "faults"])


def order_faults_of_texts(texts: DataFrame) -> DataFrame:
    """order_faults() of all texts' arrays. Texts that one task sorts are checked by it, so that no suffix is a row; longer ones'
    tables are checked by windows."""
    ship(texts.sparkSession)
    size = F.octet_length("bytes")
    longest, total = texts.agg(F.max(size), F.sum(size)).first()
    texts = spread(texts, total or 0)
    schema = "text_id bigint, n bigint, positions bigint, faults bigint"
    if (longest or 0) <= KERNEL_LIMIT:
        return texts.select("text_id", "bytes").mapInArrow(_checked, schema)
    long = order_faults(by_doubling(texts.where(size > KERNEL_LIMIT), columns=["text_id", "pos", "rank", "sym"]))
    return texts.where(size <= KERNEL_LIMIT).select("text_id", "bytes").mapInArrow(_checked, schema).unionByName(long)


def byte_of(sym: Column) -> Column:
    return F.unhex(F.lpad(F.hex(sym), 2, "0"))
