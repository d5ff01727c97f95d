"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Spark counts; reducers write each bucket as sorted arrays to the shared folder; workers map
these files and look n-grams up by binary search. Three files tell of words (64-bit hashes in
order, counts, continuation counts), four of contexts, two of pairs (both words' numbers in 64
bits, in order, and their counts). A word's number is its place in the sorted hashes of all
buckets. The number of buckets grows with the input, so that a bucket's size doesn't.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.llm.common import fresh_path, kept_in_worker, lower_words_of, release_memory, table, text_batches, written
from suffloom.llm.language_id import held_out_share
from suffloom.llm.store import ArrayStore

#: No word holds a newline or space: these stand for a text's end and begin.
END, BEGIN = b"\n", b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, with their counts; planes of bytes compress well."""
    gaps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(8, "little") + zstandard.compress(planes, 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = zstandard.decompress(blob[8:], max_output_size=16 * n + 1)
    gaps = np.frombuffer(planes, np.uint8, 8 * n).reshape(8, n).T.copy().view(np.uint64).reshape(n)
    counts = np.frombuffer(planes, np.uint8, 8 * n, 8 * n).reshape(8, n).T.copy().view("<u8").reshape(n)
    return np.cumsum(gaps, dtype=np.uint64), counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _merged(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpacked(b) for b in blobs]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _out(rows: list[tuple[int, bytes]], names: tuple[str, str] = ("bucket", "blob")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=list(names))


def _split(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    """Blobs by bucket of ascending keys."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    ends = [*cuts[1:], len(bucket)]
    return [(int(bucket[a]), _packed(keys[order[a:b]], counts[order[a:b]])) for a, b in zip(cuts, ends, strict=True)]


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney's discounts of counts 0, 1, 2 and 3 or more, from how many n-grams occur
    once to four times. Where those are too few for the formula, (0, 0.5, 1, 1.5)."""
    n1, n2, n3, n4 = n
    if min(n) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


@dataclass
class Model:
    """What scoring needs besides the files. starts: the first word number of each bucket."""

    store: ArrayStore
    starts: np.ndarray
    tokens: int
    pairs: np.ndarray
    words: np.ndarray
    continuations: int
    distinct_continued: tuple[int, int, int]
    hot: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)

    @property
    def buckets(self) -> int:
        return len(self.starts) - 1

    @property
    def vocabulary(self) -> int:
        return int(self.starts[-1])


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that word numbers ascend with it."""
    return (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


def number_words(store: ArrayStore, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Words' numbers; -1 for those not counted."""
    out = np.full(len(hashes), -1, np.int64)
    buckets = len(starts) - 1
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    bucket = word_bucket(sorted_, buckets)
    for k in np.unique(bucket):
        a, b = np.searchsorted(bucket, [k, k + 1])
        keys = store.get(f"{k}.words", "<u8")
        at = np.searchsorted(keys, sorted_[a:b])
        found = at < len(keys)
        found[found] = keys[at[found]] == sorted_[a:b][found]
        out[order[a:b][found]] = starts[k] + at[found]
    return out


def pair_bucket(pairs: np.ndarray, starts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The bucket of the pair's first word; pairs of hot first words are dealt over all buckets."""
    first = (pairs >> _32).astype(np.int64)
    buckets = len(starts) - 1
    out = np.minimum(np.searchsorted(starts, first, side="right") - 1, buckets - 1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        spread = hot[at] == first
        out[spread] = ((pairs[spread] * _MIX) >> _32).astype(np.int64) % buckets
    return out


class Numbers:
    """Words' numbers, kept in a bounded table. The begin's number is the vocabulary's size."""

    def __init__(self, store: ArrayStore, starts: np.ndarray, most: int = 150_000):
        self.store, self.starts, self.most = store, starts, most
        self.known: dict[bytes, int] = {BEGIN: int(starts[-1])}

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        new = list(set().union(*texts).difference(self.known))
        if new:
            self.known.update(zip(new, number_words(self.store, self.starts, _hashes(new)).tolist(), strict=True))
        out = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
        if len(self.known) > self.most:
            self.known = dict(islice(self.known.items(), self.most // 2))
        return out


def count_words(train: DataFrame, store: ArrayStore, buckets: int, hot_count: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Writes each bucket's words and counts. Returns the buckets' first numbers, the tokens in all, and
    the numbers of words that occur `hot_count` times or more."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(found)
            keys, counts = _summed(_hashes(words), np.fromiter(found.values(), np.int64, len(words)))
            found.clear()
            return _out(_split(keys, counts, word_bucket(keys, buckets)))

        for b in text_batches(batches):
            for text in b.column("text").to_pylist():
                found.update(lower_words_of(text))
            found[END] += b.num_rows
            if len(found) > 250_000:
                yield flush()
                release_memory()
        if found:
            yield flush()
        release_memory()

    def reduce(key: tuple, part: pa.Table) -> pa.Table:
        k = key[0].as_py()
        words, counts = _merged(part.column("blob").to_pylist())
        store.put(f"{k}.words", words.astype("<u8"))
        store.put(f"{k}.counts", counts.astype("<u4") if counts.max(initial=0) < 1 << 32 else counts.astype("<u8"))
        hot = np.flatnonzero(counts >= hot_count)
        return pa.table({"bucket": pa.array([k], pa.int32()), "n": [len(words)], "total": [int(counts.sum())], "hot": pa.array([hot.astype("<i8").tobytes()], pa.binary())})

    blobs = train.mapInArrow(count, "bucket int, blob binary")
    rows = blobs.groupBy("bucket").applyInArrow(reduce, "bucket int, n bigint, total bigint, hot binary").collect()
    sizes = np.zeros(buckets, np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["n"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for k in set(range(buckets)) - {r["bucket"] for r in rows}:
        for name in ("words", "counts"):
            store.put(f"{k}.{name}", np.zeros(0, "<u8"))
    hot = [starts[r["bucket"]] + np.frombuffer(r["hot"], "<i8") for r in rows]
    return starts, sum(r["total"] for r in rows), np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.int64)


def count_pairs(train: DataFrame, store: ArrayStore, starts: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Writes each bucket's pairs and its words' context sums. Returns rows (bucket, kind, blob): of kind 0
    the counts of counts, of kind 1 the distinct first words of second words by their bucket, of
    kind 2 the hot words' partial context sums."""
    buckets, begin = len(starts) - 1, int(starts[-1])
    # The begin stands before each text: it is hot, too, and numbered behind all words.
    hot = np.append(hot, begin)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(store, starts)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _out(_split(pairs, counts, pair_bucket(pairs, starts, hot)))

        for b in text_batches(batches, 2 << 20):
            texts = [[BEGIN, *lower_words_of(x), END] for x in b.column("text").to_pylist()]
            ids = numbers.of(texts).astype(np.uint64)
            pairs = (ids[:-1] << _32) | ids[1:]
            ends = np.cumsum([len(t) for t in texts]) - 1
            keep = np.ones(len(pairs), bool)
            keep[ends[:-1]] = False  # from one text's end to the next one's begin
            held.append(pairs[keep])
            if sum(map(len, held)) > 2_000_000:
                yield flush()
                release_memory()
        if held:
            yield flush()
        del numbers
        release_memory()

    def reduce(key: tuple, part: pa.Table) -> pa.Table:
        k = key[0].as_py()
        pairs, counts = _merged(part.column("blob").to_pylist())
        store.put(f"{k}.pairs", pairs.astype("<u8"))
        store.put(f"{k}.paircounts", counts.astype("<u4") if counts.max(initial=0) < 1 << 32 else counts.astype("<u8"))
        first, second = (pairs >> _32).astype(np.int64), pairs & _LOW
        spread = np.isin(first, hot)
        sums = np.zeros((4, int(starts[k + 1] - starts[k])), np.int64)
        at = first[~spread] - starts[k]
        level = np.minimum(counts, 3)
        np.add.at(sums[0], at, counts[~spread])
        for i in (1, 2, 3):
            np.add.at(sums[i], at, (level[~spread] == i).astype(np.int64))
        store.put(f"{k}.contexts", sums.astype("<i8"))
        out: list[tuple[int, int, bytes]] = [(k, 0, np.array([(counts == i).sum() for i in (1, 2, 3, 4)], "<i8").tobytes())]
        ids, n = np.unique(second, return_counts=True)
        where = np.minimum(np.searchsorted(starts, ids.astype(np.int64), side="right") - 1, buckets - 1)
        out += [(dest, 1, blob) for dest, blob in _split(ids, n, where)]
        if spread.any():
            ids, back = np.unique(first[spread], return_inverse=True)
            rows = np.stack([ids, np.bincount(back, counts[spread]), *(np.bincount(back, level[spread] == i) for i in (1, 2, 3))], 1).astype("<i8")
            out.append((k, 2, rows.tobytes()))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int32()), "blob": pa.array([x[2] for x in out], pa.binary())})

    return train.mapInArrow(count, "bucket int, blob binary").groupBy("bucket").applyInArrow(reduce, "bucket int, kind int, blob binary")


def count_continuations(rows: DataFrame, store: ArrayStore, starts: np.ndarray) -> tuple[np.ndarray, int, tuple[int, int, int]]:
    """Writes how many distinct words precede each word; returns the counts of these counts (1 to 4), their
    sum, and how many words have one, two, three or more."""

    def reduce(key: tuple, part: pa.Table) -> pa.Table:
        k = key[0].as_py()
        ids, counts = _merged(part.column("blob").to_pylist())
        dense = np.zeros(int(starts[k + 1] - starts[k]), np.int64)
        dense[ids.astype(np.int64) - starts[k]] = counts
        store.put(f"{k}.continued", dense.astype("<i8"))
        return pa.table({f"c{i}": [int((dense == i).sum())] for i in (1, 2, 3, 4)} | {"more": [int((dense >= 3).sum())], "total": [int(dense.sum())], "bucket": pa.array([k], pa.int32())})

    found = rows.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(reduce, "c1 bigint, c2 bigint, c3 bigint, c4 bigint, more bigint, total bigint, bucket int").collect()
    for k in set(range(len(starts) - 1)) - {r["bucket"] for r in found}:
        store.put(f"{k}.continued", np.zeros(int(starts[k + 1] - starts[k]), "<i8"))
    n = [sum(r[f"c{i}"] for r in found) for i in (1, 2, 3, 4)]
    return discounts(n), sum(r["total"] for r in found), (n[0], n[1], sum(r["more"] for r in found))


def _hot_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.frombuffer(x, "<i8").reshape(-1, 5) for x in b.column("blob").to_pylist()]
        if rows:
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=["word", "s0", "s1", "s2", "s3"])


def fit(train: DataFrame, buckets: int | None = None, tokens_per_bucket: int = 4_000_000) -> Model:
    """Counts the model from the column `text` of train (null: empty).

    buckets: a power of two; by default the estimated tokens over `tokens_per_bucket`, 16 at least.
    """
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    estimate = (size[0] or 0) // 6 + size[1]
    if buckets is None:
        buckets = 16
        while buckets * tokens_per_bucket < estimate:
            buckets *= 2
    store = ArrayStore(fresh_path(spark, "ngrams"))
    starts, tokens, hot = count_words(train, store, buckets, max(1000, estimate // (2 * buckets)))
    if starts[-1] >= (1 << 32) - 1:
        raise ValueError("more than 2**32 - 2 different words")
    rows = written(count_pairs(train, store, starts, hot), "ngram-sums")
    got = {r["bucket"]: np.frombuffer(r["blob"], "<i8") for r in rows.where("kind = 0").collect()}
    for k in set(range(buckets)) - set(got):
        store.put(f"{k}.pairs", np.zeros(0, "<u8"))
        store.put(f"{k}.paircounts", np.zeros(0, "<u4"))
        store.put(f"{k}.contexts", np.zeros((4, int(starts[k + 1] - starts[k])), "<i8"))
    sums = rows.where("kind = 2").select("blob").mapInArrow(_hot_rows, "word bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    sums = sums.groupBy("word").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(4))).collect()  # fewer than 2 x buckets words are hot
    words, total, distinct = count_continuations(rows, store, starts)
    pairs = discounts([int(x) for x in sum(got.values(), np.zeros(4, np.int64))])
    return Model(store, starts, tokens, pairs, words, total, distinct, {r["word"]: tuple(r[f"s{i}"] for i in range(4)) for r in sums})


class Scorer:
    """Scores texts by the mapped files. Per word, what it needs is kept in a bounded table."""

    COLUMNS = 5  # number, count, unigram probability, the context's sum, its weight for the unigram

    def __init__(self, model: Model, most: int = 150_000):
        self.m, self.most = model, most
        self.hot = np.array(sorted(model.hot), np.int64)
        w, d = model.words, model.distinct_continued
        self.rest = (w[1] * d[0] + w[2] * d[1] + w[3] * d[2]) / max(model.continuations, 1) if model.continuations else 1.0
        self.uniform = 1.0 / (model.vocabulary + 1)
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.COLUMNS))
        self._learn([BEGIN])

    def _learn(self, new: list[bytes]) -> None:
        m = self.m
        ids = number_words(m.store, m.starts, _hashes(new))
        ids[[i for i, w in enumerate(new) if w == BEGIN]] = m.vocabulary
        out = np.zeros((len(new), self.COLUMNS))
        out[:, 0], out[:, 2], out[:, 4] = ids, self.rest * self.uniform, 1.0
        bucket = np.searchsorted(m.starts, ids, side="right") - 1
        for k in np.unique(bucket[(ids >= 0) & (ids < m.vocabulary)]):
            at = np.flatnonzero((bucket == k) & (ids >= 0) & (ids < m.vocabulary))
            local = ids[at] - m.starts[k]
            n = int(m.starts[k + 1] - m.starts[k])
            counts = m.store.get(f"{k}.counts", "u1")
            out[at, 1] = counts.view("<u4" if len(counts) == 4 * n else "<u8")[local]
            continued = m.store.get(f"{k}.continued", "<i8")[local]
            out[at, 2] += np.maximum(continued - m.words[np.minimum(continued, 3)], 0) / max(m.continuations, 1)
            sums = m.store.get(f"{k}.contexts", "<i8").reshape(4, n)[:, local].astype(float)
            self._context(out, at, sums)
        for w, x in m.hot.items():
            at = np.flatnonzero(ids == w)
            if len(at):
                self._context(out, at, np.array(x, float)[:, None].repeat(len(at), 1))
        self.row.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.vstack([self.rows, out])

    def _context(self, out: np.ndarray, at: np.ndarray, sums: np.ndarray) -> None:
        d = self.m.pairs
        seen = sums[0] > 0
        out[at, 3] = sums[0]
        out[at[seen], 4] = ((d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3])[seen]) / sums[0][seen]

    def _pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        keys, back = np.unique(pairs, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        bucket = pair_bucket(keys, self.m.starts, self.hot)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.m.buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[k] : cuts[k + 1]]
            table_ = self.m.store.get(f"{k}.pairs", "<u8")
            i = np.searchsorted(table_, keys[at])
            found = i < len(table_)
            found[found] = table_[i[found]] == keys[at][found]
            raw = self.m.store.get(f"{k}.paircounts", "u1")
            counts[at[found]] = raw.view("<u4" if len(raw) == 4 * len(table_) else "<u8")[i[found]]
        return counts[back]

    def score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        words = [[BEGIN, *lower_words_of(x), END] for x in texts]
        new = list(set().union(*words).difference(self.row)) if words else []
        if new:
            self._learn(new)
        n = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.row.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        starts = np.cumsum(n) - n
        token = np.ones(len(at), bool)
        token[starts] = False
        token = np.flatnonzero(token)
        before, now = self.rows[at[token - 1]], self.rows[at[token]]
        known = (before[:, 0] >= 0) & (now[:, 0] >= 0)
        count = np.zeros(len(token), np.int64)
        count[known] = self._pair_counts((before[known, 0].astype(np.uint64) << _32) | now[known, 0].astype(np.uint64))
        own = np.maximum(count - self.m.pairs[np.minimum(count, 3)], 0) / np.maximum(before[:, 3], 1)
        prob = np.log10(own + before[:, 4] * now[:, 2])
        base = np.log10((now[:, 1] + 1) / (self.m.tokens + self.m.vocabulary + 1))
        ends = starts - np.arange(len(n))
        if len(self.row) > self.most:
            self.row = dict(islice(self.row.items(), self.most // 2))
            self.rows = self.rows[: self.most // 2].copy()
        add = (lambda x: np.add.reduceat(x, ends)) if len(n) else (lambda x: x)
        return {"n_tokens": n - 1, "n_known": add((now[:, 1] > 0).astype(np.int64)), "base_score": add(base), "score": add(prob)}


def score_documents(documents: DataFrame, key: str = "doc_id", folds: int = 7, fold: int = 2, buckets: int | None = None) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the documents whose fold (CRC-32 of the key as text, modulo `folds`; a null key
    counts as empty) isn't `fold`, and scores all. Tokens are the lower-cased (A-Z) words and one
    end. base_score is that of unigrams with one added to each count; score is the model's log10
    probability; both read whole texts. A null or empty text has its end as only token. With no
    documents to learn from, all probabilities are uniform over one unknown word. Repeated rows
    are counted and scored each. An empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    source = documents.select(key, (held_out_share(key, folds) == fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(source.where(~F.col("held_out")).select("text"), buckets))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(name, lambda: Scorer(model.value))
        for b in text_batches(batches, 1 << 20):
            if not b.num_rows:
                continue
            got = scorer.score(b.column("text").to_pylist())
            total = np.full(b.num_rows, scorer.m.tokens, np.int64)
            cols = [got["n_tokens"], got["n_known"], total, got["base_score"], got["score"], 10 ** (-got["score"] / got["n_tokens"])]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("held_out"), *map(pa.array, cols)], names=names)

    name = model.value.store.uri
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kind = documents.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
