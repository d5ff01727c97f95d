"""Benchmark decontamination by latent semantic retrieval.

All documents' passages are TF-IDF vectors over the benchmark's terms. A randomised singular
value decomposition, whose products run over all passages in Spark, gives a latent space of
fixed rank; overlapping windows of each document are compared there with the benchmark's
passages, and pairs over a cosine are verified on the words themselves: by the weight of the
longest common subsequence, and for paraphrases by that of the answer, an item's last words.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from suffloom.llm.common import kept_in_worker, table, text_batches, written

WINDOW, STRIDE = 64, 32
#: Lower-cases A-Z and turns all other ASCII signs but digits and letters into spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Passage:
    """A benchmark item, or a window of a long one. answer: where its last words begin."""

    item: int
    words: list[bytes]
    answer: int


def benchmark_passages(items: list[tuple[int, str | None]], window: int = WINDOW, stride: int = STRIDE) -> list[Passage]:
    """Windows of the items' words; the last quarter of a window, three words at least, counts as its answer."""
    out = []
    for item, text in items:
        words = plain_words(text)
        begin = 0
        while words:
            part = words[begin : begin + window]
            out.append(Passage(item, part, max(0, len(part) - max(3, len(part) // 4))))
            if begin + window >= len(words):
                break
            begin += stride
    return out


def choose_terms(passages: list[Passage], share: float = 0.04, least: int = 8) -> dict[bytes, int]:
    """Numbers of the terms to retrieve by: those in at most `share` of the benchmark's passages (or
    two), and in any case the `least` rarest of each passage, so that none is left without terms."""
    df = Counter(w for p in passages for w in set(p.words))
    limit = max(2, share * len(passages))
    kept = {w for w, n in df.items() if n <= limit}
    for p in passages:
        kept.update(sorted(set(p.words), key=lambda w: (df[w], w))[:least])
    return {w: i for i, w in enumerate(sorted(kept))}


def _hits(texts: list[str | None], terms: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text's place, its words, positions of terms, their numbers)"""
    for i, text in enumerate(texts):
        words = plain_words(text)
        ids = np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(ids >= 0)
        yield i, len(words), at, ids[at]


def passage_terms(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The terms of all documents' passages, cut without overlap: rows (n, blob), each with many
    passages; n counts passages, those without terms included. No document's name is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            blocks, found, n = [], [], 0
            for _, size, at, ids in _hits(b.column("text").to_pylist(), terms):
                blocks.append(n + at // WINDOW)
                found.append(ids)
                n += -(-size // WINDOW)
            key = np.sort(np.concatenate(blocks).astype(np.int64) * len(terms) + np.concatenate(found)) if blocks else np.zeros(0, np.int64)
            gaps = np.diff(key, prepend=0).astype("<u4")  # a batch has few enough passages
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)], pa.binary())], names=["n", "blob"])

    return documents.select("text").mapInArrow(run, "n bigint, blob binary")


def _passages(blob: bytes, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, occurrences), ordered by both."""
    raw = np.frombuffer(zstandard.decompress(blob, max_output_size=1 << 30), np.uint8)
    gaps = raw.reshape(4, -1).T.copy().view("<u4").reshape(-1)
    key = np.cumsum(gaps, dtype=np.int64)
    if not len(key):
        return key, key, key
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return key // n_terms, key % n_terms, count


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


#: Rows that are added up one after the other in _sums(); longer runs are cut.
_LONG = 64


def _sums(rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of rows[at] over the runs of `at` that begin at `first`: the runs' first rows, then their
    second ones and so on, each step for all runs that are as long. reduceat takes several times as long."""
    size = np.diff(np.append(first, len(at)))
    if len(size) and size.max() > _LONG:  # in pieces, or steps for a few long runs would be many
        pieces = -(-size // _LONG)
        begin = np.cumsum(pieces) - pieces
        cut = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(begin, pieces)) * _LONG
        return _sums(_sums(rows, at, cut), np.arange(len(cut)), begin)
    order = np.argsort(-size, kind="stable")
    start = first[order]
    total = rows[at[start]]
    as_long = len(size) - np.cumsum(np.bincount(size))
    for j, k in enumerate(as_long[1:-1].tolist(), 1):
        total[:k] += rows[at[start[:k] + j]]
    out = np.empty_like(total)
    out[order] = total
    return out


def _sum_over(blobs: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, bytes], None], rows: int = 1024) -> np.ndarray:
    """The sum over all tasks of an array that each fills from its blobs. Arrays are cut into
    runs of rows and added in two steps, so that no task holds more than the square root of them."""
    spread = 16

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float64)
        seen = False
        for b in batches:
            for blob in b.column("blob").to_pylist():
                add(total, blob)
                seen = True
        part = TaskContext.get().partitionId() % spread
        if seen:
            for k in range(0, len(total), rows):
                if total[k : k + rows].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([total[k : k + rows].astype(np.float32).tobytes()], pa.binary())], names=["k", "part", "blob"])

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        total = None
        for x in part.column("blob"):
            values = np.frombuffer(x.as_py(), np.float32)
            total = values.astype(np.float64) if total is None else total + values
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "blob": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "k int, part int, blob binary"
    sums = blobs.select("blob").mapInArrow(run, schema).groupBy("k", "part").applyInArrow(merge, schema).groupBy("k").applyInArrow(lambda key, part: merge(key, part), schema)
    out = np.zeros(shape, np.float64)
    for r in sums.select("k", "blob").collect():
        out[r["k"] : r["k"] + rows] = np.frombuffer(r["blob"], np.float32).reshape(-1, *shape[1:])
    return out


def _on_worker(spark: SparkSession, work: Callable[[], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Runs dense algebra in a worker: threaded LAPACK can stall in the driver's Python, beside the JVM."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(work(), np.float64).tobytes()], pa.binary())], names=["blob"])

    return np.frombuffer(spark.range(0, 1, 1, 1).mapInArrow(run, "blob binary").first()["blob"], np.float64).reshape(shape)


@dataclass
class Space:
    """Term vectors in the latent space, weighted by IDF; the benchmark's passages in it, of length one."""

    terms: dict[bytes, int]
    idf: np.ndarray
    vectors: np.ndarray
    passages: list[Passage]
    points: np.ndarray


def _weighted(passages: list[Passage], terms: dict[bytes, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, weight) of the benchmark's passages as TF-IDF rows of length one. Each has a term."""
    rows, cols, weights = [], [], []
    for i, p in enumerate(passages):
        n = Counter(terms[w] for w in p.words if w in terms)
        x = np.array([c * idf[t] for t, c in n.items()])
        rows += [i] * len(n)
        cols += n
        weights.append(x / np.sqrt((x * x).sum()))
    return np.array(rows), np.array(cols), np.concatenate(weights)


def fit_space(documents: DataFrame, passages: list[Passage], rank: int = 192, seed: int = 1, most_fitted: int | None = None) -> Space:
    """The latent space. rank: at most so many dimensions, or as many as there are passages.

    IDF counts all documents' passages. M = A'A + w B'B, with A all of them, too, and B the benchmark's
    passages, weighed to the same energy. The range finder starts from random mixtures of B's rows,
    goes once through M, and the eigenvectors of M within that range are the right singular vectors.
    All passages are searched. most_fitted: if given, A has about so many passages, chosen by a hash.
    """
    spark = documents.sparkSession
    terms = choose_terms(passages)
    n_terms = len(terms)
    rank = max(1, min(rank, n_terms, len(passages) + 8))
    blobs = written(passage_terms(documents, terms), "passages")
    n = blobs.agg(F.sum("n")).first()[0] or 0

    def count(total: np.ndarray, blob: bytes) -> None:
        total += np.bincount(_passages(blob, n_terms)[1], minlength=n_terms)[:, None]

    df = _sum_over(blobs, (n_terms, 1), count)[:, 0]
    idf = np.log((2.0 + n) / (1.0 + df))
    rows, term_, weight_ = _weighted(passages, terms, idf)
    first_ = _runs(rows)
    rng = np.random.default_rng(seed)
    start = np.zeros((n_terms, rank))
    np.add.at(start, term_, weight_[:, None] * rng.standard_normal((len(passages), rank))[rows])
    every = 1 if most_fitted is None else max(1, -(-n // most_fitted))

    def through(basis: np.ndarray, back: bool) -> Callable[[np.ndarray, bytes], None]:
        basis = (idf[:, None] * basis).astype(np.float32)

        def add(total: np.ndarray, blob: bytes) -> None:
            where, term, count_ = _passages(blob, n_terms)
            if every > 1:
                mixed = (where.astype(np.uint64) + np.uint64(zlib.crc32(blob))) * np.uint64(0x9E3779B97F4A7C15)
                chosen = (mixed >> np.uint64(32)) % np.uint64(every) == 0
                where, term, count_ = where[chosen], term[chosen], count_[chosen]
            if not len(where):
                return
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] // 512 != where[:-1] // 512, [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # a few passages at a time: their rows are wide
                some(total, where[a:b], term[a:b], count_[a:b])

        def some(total: np.ndarray, where: np.ndarray, term: np.ndarray, count_: np.ndarray) -> None:
            weight = (count_ * idf[term]).astype(np.float32)
            first = _runs(where)
            norm = np.sqrt(np.add.reduceat(weight * weight, first))
            passage, term = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(where)))), count_), np.repeat(term, count_)
            low = _sums(basis, term, _runs(passage))
            if back:
                low /= (norm * norm)[:, None]
                order = np.argsort(term, kind="stable")
                term = term[order]
                start_ = _runs(term)
                met = term[start_]
                total[met] += idf[met, None] * _sums(low, passage[order], start_)
            else:
                low /= norm[:, None]
                total += low.T @ low

        return add

    y = _sum_over(blobs, (n_terms, rank), through(start / np.sqrt((start * start).sum(0)), True))
    bulk = float(n) / every / max(len(passages), 1)

    def orthonormal() -> np.ndarray:
        whole = y / max(np.abs(y).max(), 1e-12) + start / max(np.abs(start).max(), 1e-12)
        return np.linalg.qr(whole)[0]

    q = _on_worker(spark, orthonormal, (n_terms, rank))
    gram = _sum_over(blobs, (rank, rank), through(q, False), rows=rank)

    def rotate() -> np.ndarray:
        bq = np.add.reduceat(weight_[:, None] * q[term_], first_, axis=0)
        _, u = np.linalg.eigh(gram + bulk * (bq.T @ bq))
        return q @ u[:, ::-1]

    v = _on_worker(spark, rotate, (n_terms, rank))
    points = np.add.reduceat(weight_[:, None] * v[term_], first_, axis=0)
    points /= np.maximum(np.sqrt((points * points).sum(1, keepdims=True)), 1e-12)
    return Space(terms, idf, (idf[:, None] * v).astype(np.float32), passages, points.astype(np.float32))


def common_weight(a: list[bytes], b: list[bytes], weight: np.ndarray) -> float:
    """The weight of the heaviest common subsequence of a and b; weight has one value for each word of a."""
    where = defaultdict(list)
    for j, w in enumerate(b):
        where[w].append(j)
    best = np.zeros(len(b) + 1)
    for w, x in zip(a, weight, strict=True):
        at = where.get(w)
        if at:
            at = np.array(at)
            new = best.copy()
            new[at + 1] = np.maximum(best[at + 1], best[at] + x)
            best = np.maximum.accumulate(new)
    return float(best[-1])


class Searcher:
    def __init__(self, space: Space, cosine: float, share: float, paraphrase: float, answer: float):
        self.s, self.cosine, self.share, self.paraphrase, self.answer = space, cosine, share, paraphrase, answer
        self.weights = [np.array([space.idf[space.terms[w]] if w in space.terms else 1.0 for w in p.words]) for p in space.passages]
        # What a passage can have in common with words that hold certain terms: the terms' weights and all common words.
        self.bags: list[dict[int, float]] = []
        self.common = np.zeros(len(space.passages))
        for i, p in enumerate(space.passages):
            bag: dict[int, float] = defaultdict(float)
            for w, x in zip(p.words, self.weights[i].tolist(), strict=True):
                if w in space.terms:
                    bag[space.terms[w]] += x
                else:
                    self.common[i] += x
            self.bags.append(dict(bag))
        self.total = np.array([w.sum() for w in self.weights])
        self.needed = ((paraphrase - 1e-6) * self.total - self.common).tolist()  # of a bag
        self.least = min((len({w for w in p.words if w in space.terms}) for p in space.passages), default=1)
        self.points = np.ascontiguousarray(space.points.T)
        n = max(1, len(space.passages))
        self.rows = max(1, (1 << 18) // n, min(64, (1 << 21) // n))  # windows compared at once
        self.blocks = (1 << 22) // n  # of the texts that go together, so that their pairs are bounded

    def candidates(self, size: int, at: np.ndarray, ids: np.ndarray, texts: tuple[int, ...] | np.ndarray = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, passage, cosine) of a text's windows; window w begins at word w * STRIDE. at may go on
        over several texts, if they lie some blocks apart: `texts` are the blocks at which they begin."""
        none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
        if not len(at):
            return none
        block = at // STRIDE  # a window is two blocks: each block's terms are summed up once
        first = _runs(block)
        blocks, n = block[first], np.append(np.diff(np.append(first, len(at))), 0)
        window = np.unique(np.concatenate([blocks, blocks - 1]))
        window = window[~np.isin(window + 1, texts)]  # that would begin before its text
        left, right = (np.minimum(np.searchsorted(blocks, w), len(blocks) - 1) for w in (window, window + 1))
        left[blocks[left] != window] = len(blocks)
        right[blocks[right] != window + 1] = len(blocks)
        enough = n[left] + n[right] >= min(2, self.least)
        if not enough.any():
            return none
        window, left, right = window[enough], left[enough], right[enough]
        sums = np.concatenate([_sums(self.s.vectors, ids, first), np.zeros((1, self.s.vectors.shape[1]), np.float32)])
        found = []
        for k in range(0, len(window), self.rows):
            points = sums[left[k : k + self.rows]]
            points += sums[right[k : k + self.rows]]
            points /= np.maximum(np.sqrt(np.einsum("ij,ij->i", points, points)), 1e-9)[:, None]
            near = points @ self.points
            i, j = np.divmod(np.flatnonzero(near >= self.cosine), near.shape[1])
            found.append((window[k + i], j, near[i, j]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def possible(self, at: np.ndarray, ids: np.ndarray, window: int, passage: int) -> bool:
        """Whether the words around the window can hold enough of the passage in any order: no subsequence weighs more."""
        return any(self.all_possible(at, ids, np.array([window]), np.array([passage]), np.zeros(1)))

    def all_possible(self, at: np.ndarray, ids: np.ndarray, windows: np.ndarray, passages: np.ndarray, cosines: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """The pairs of candidates() that are possible()."""
        listed = ids.tolist()
        begin = np.searchsorted(at, windows * STRIDE - STRIDE).tolist()
        end = np.searchsorted(at, windows * STRIDE + WINDOW + STRIDE).tolist()
        last, terms = -1, set()
        for a, b, w, p, c in zip(begin, end, windows.tolist(), passages.tolist(), cosines.tolist(), strict=True):
            if w != last:
                last, terms = w, set(listed[a:b])
            bag = self.bags[p]
            if sum(map(bag.__getitem__, terms.intersection(bag))) >= self.needed[p]:
                yield w, p, c

    def verify(self, words: list[bytes], window: int, passage: int) -> tuple[float, float]:
        """Shares of the weight of the passage, and of its answer, that the words around the window hold in order."""
        p, weight = self.s.passages[passage], self.weights[passage]
        near = words[max(0, window * STRIDE - STRIDE) : window * STRIDE + WINDOW + STRIDE]
        whole = common_weight(p.words, near, weight) / weight.sum()
        if whole < self.paraphrase or whole >= self.share:
            return whole, 0.0
        return whole, common_weight(p.words[p.answer :], near, weight[p.answer :]) / weight[p.answer :].sum()

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text's place, item, cosine, share, answer's share, first word of the window): the best pair for each item."""
        found, block = [], 0
        for i, size, at, ids in _hits(texts, self.s.terms):
            size = -(-size // STRIDE) + 2  # far enough for the words around a window, too
            if found and block + size > self.blocks:
                yield from self._leaks_of(texts, found)
                found, block = [], 0
            found.append((i, block, at + block * STRIDE, ids))
            block += size
        if found:
            yield from self._leaks_of(texts, found)

    def _leaks_of(self, texts: list[str | None], found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """The leaks of some texts: (place, the block at which it begins among them, positions of terms, their numbers)."""
        starts = np.array([x[1] for x in found])
        at, ids = np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
        pairs = self.all_possible(at, ids, *self.candidates(at[-1] + 1 if len(at) else 0, at, ids, starts))
        for k, some in groupby(pairs, lambda pair: int(np.searchsorted(starts, pair[0], "right")) - 1):
            i, begin, words = found[k][0], found[k][1], plain_words(texts[found[k][0]])
            best: dict[int, tuple[float, float, float, int]] = {}
            for w, p, c in some:
                w -= begin
                whole, end = self.verify(words, w, p)
                if whole >= self.share or (whole >= self.paraphrase and end >= self.answer):
                    item = self.s.passages[p].item
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0, 0)), (whole, end, c, w * STRIDE))
            for item, (whole, end, c, w) in sorted(best.items()):
                yield i, item, c, whole, end, w


def _parts(benchmark: DataFrame, item: str, most_bytes: int) -> Iterator[list[Passage]]:
    """The passages of the benchmark; of a large one, items by their hash in parts of about `most_bytes` of text at most."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if size <= most_bytes else 2 * -(-size // most_bytes)
    there = benchmark.where(F.col("text").isNotNull() & F.col(item).isNotNull()).select(item, "text").distinct()
    for k in range(n):
        rows = (there if n == 1 else there.where(F.pmod(F.xxhash64(item), F.lit(n)) == k)).collect()
        passages = benchmark_passages(sorted((r[0], r[1]) for r in rows))
        if passages:
            yield passages


def find_leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", cosine: float = 0.4, share: float = 0.6, paraphrase: float = 0.45, answer: float = 0.8, rank: int = 192, most_benchmark_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and benchmark item that it holds: key, item, cosine, share, answer_share, at_word.

    A pair is retrieved if a window of the document and a passage of the item have `cosine` in the
    latent space, and holds if their common subsequence weighs `share` of the passage, or, for
    paraphrases, `paraphrase` and that with the answer `answer` of the answer. Weights are IDF
    over all documents' passages for the terms retrieved by, and 1 for common words.

    Items without words, and null or empty texts, hold nothing. Repeated rows of a document give
    a row each. Ties between windows go to the later one. An empty documents or benchmark table
    gives an empty result. Other columns are ignored. The benchmark is searched for in parts of about
    `most_benchmark_bytes` of text, each in a pass of its own, so that what is collected and
    broadcast at once is bounded. No text is shuffled.
    """
    spark = documents.sparkSession
    source = documents.select(key, F.col("text").cast("string").alias("text"))
    kind, item_kind = documents.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"`{key}` {kind}, `{item}` {item_kind.simpleString()}, cosine double, share double, answer_share double, at_word bigint"
    item_arrow = to_arrow_type(item_kind)
    out = spark.createDataFrame([], schema)
    for passages in _parts(benchmark, item, most_benchmark_bytes):
        out = _leaks_of(source, fit_space(source, passages, rank), key, item, item_arrow, schema, (cosine, share, paraphrase, answer)).unionByName(out)
    return out


def _leaks_of(source: DataFrame, fitted: Space, key: str, item: str, item_arrow: pa.DataType, schema: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    space = source.sparkSession.sparkContext.broadcast(fitted)
    name = ("benchmark", uuid.uuid4().hex)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = kept_in_worker(name, lambda: Searcher(space.value, *bounds))
        for b in text_batches(batches):
            rows = list(searcher.leaks(b.column("text").to_pylist()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), None, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_arrow), *(pa.array(c, k) for c, k in zip(cols[2:], kinds[2:], strict=True))], names=[key, item, "cosine", "share", "answer_share", "at_word"])

    return source.mapInArrow(run, schema)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, item: str = "item_id", cosine: float = 0.4, share: float = 0.6, paraphrase: float = 0.45, answer: float = 0.8, rank: int = 192, most_benchmark_bytes: int = 8 << 20) -> DataFrame:
    """documents without the rows in which find_leaks() finds an item. The verdict falls where a text
    is read, so that no join is needed; columns are those of documents."""
    texts = documents.select(F.col("text").cast("string").alias("text"))
    for passages in _parts(benchmark, item, most_benchmark_bytes):
        documents = _dropped(documents, fit_space(texts, passages, rank), (cosine, share, paraphrase, answer))
    return documents


def _dropped(documents: DataFrame, fitted: Space, bounds: tuple[float, float, float, float]) -> DataFrame:
    space = documents.sparkSession.sparkContext.broadcast(fitted)
    name = ("benchmark", uuid.uuid4().hex)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = kept_in_worker(name, lambda: Searcher(space.value, *bounds))
        for b in text_batches(batches):
            keep = np.ones(b.num_rows, bool)
            for i, *_ in searcher.leaks(b.column("text").to_pylist()):
                keep[i] = False
            yield b.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
