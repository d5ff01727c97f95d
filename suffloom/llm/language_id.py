"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by the forward algorithm; a
text's is the product over its words. Pieces' probabilities are learned by expectation-
maximisation from word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.llm.common import kept_in_worker, table, text_batches, vocabulary_path, written

_RUN = re.compile(r"[^\W\d_]+")
_MARK = "▁"
#: Sums are scaled after each so many signs, so that they stay above the smallest double however long a word is.
_SCALED = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The probability of a sign that is no piece, in all languages alike.
_FLOOR = 1e-8


@cache
def _word() -> re.Pattern:
    """Runs of letters, of the categories L: word signs without digits, underscores and other numerals."""
    numerals = "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
    return re.compile(f"[^\\W\\d_{numerals}]+")


def letters_only(text: str) -> list[str]:
    """Lower-case runs of letters."""
    runs = _RUN.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    return [w for r in runs for w in ([r] if r.isalpha() else _word().findall(r))]  # numerals among the letters


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that hold letters only, after an optional word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({x for x in found if (x == _MARK or _word().fullmatch(x.removeprefix(_MARK))) and x == x.lower()})


def _hash(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


class Lattice:
    """Finds the pieces at all places of many words at once."""

    def __init__(self, pieces: list[str]):
        h = _hash(pieces)
        order = np.argsort(h)
        self.sorted, self.number = h[order], order.astype(np.int64)
        self.longest = max(map(len, pieces), default=1)
        self.none = len(pieces)

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, numbers of pieces, `none` where there is none) for words of one length, begins ascending."""
        n, size = len(words), len(words[0])
        signs = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(size, i + self.longest)):
                h = h * _BASE + signs[:, j]
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                yield i, j + 1, np.where(self.sorted[at] == h, self.number[at], self.none)


def _by_length(words: Iterable[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _sums(arcs: Iterable[tuple[int, int, np.ndarray]], size: int, shape: tuple[int, ...], longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The forward algorithm: for each place, the sum over all ways to cut what is before it, as a number and the
    logarithm of its scale. arcs: (begin, end, probability), begins ascending."""
    sums, scales = [np.zeros(shape) for _ in range(size + 1)], [np.zeros(shape)] * (size + 1)
    sums[0][:] = 1
    scale, done = np.zeros(shape), 0
    for i, j, p in arcs:
        if i >= done + _SCALED:  # what ends at i is whole; rest reaches up to `longest` further
            top = sums[i].copy()
            scale = scale + np.log(top)
            for k in range(i, min(size, i + longest) + 1):
                sums[k] /= top
            done = i
        scales[i] = scale
        sums[j] += sums[i] * p
    scales[size] = scale
    return sums, scales


def _lengthened(words: Iterable[str]) -> dict[int, list[str]]:
    return _by_length(_MARK + w for w in words)


def word_log_probs(lattice: Lattice, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the sum over all segmentations, words x languages. probs: pieces x languages."""
    probs = np.vstack([probs, np.zeros((1, probs.shape[1]))])
    out = np.zeros((len(words), probs.shape[1]))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w) + 1, []).append(i)
    for size, ids in groups.items():
        step = max(1, 600_000 // size)
        for begin in range(0, len(ids), step):
            some = ids[begin : begin + step]
            arcs = ((i, j, np.maximum(probs[piece], _FLOOR) if j == i + 1 else probs[piece]) for i, j, piece in lattice.arcs([_MARK + words[x] for x in some]))
            sums, scales = _sums(arcs, size, (len(some), probs.shape[1]), lattice.longest)
            out[some] = np.log(sums[size]) + scales[size]
    return out


def learn(lattice: Lattice, counts: Counter, n_pieces: int, rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities of one language from its words' counts, by expectation-maximisation.

    It starts from how often each piece occurs as a substring. `smooth` is added to each piece's count.
    """
    probs = np.full(n_pieces + 1, 1.0)
    for turn in range(rounds + 1):
        total = np.zeros(n_pieces + 1)
        for size, all_words in _lengthened(counts).items():
            step = max(1, 600_000 // size)
            for begin in range(0, len(all_words), step):
                words = all_words[begin : begin + step]
                weight = np.array([counts[w[1:]] for w in words], float)
                arcs = list(lattice.arcs(words))
                if turn == 0:
                    for _, _, piece in arcs:
                        total += np.bincount(piece, weight, n_pieces + 1)
                    continue
                p = [np.maximum(probs[piece], _FLOOR) if j == i + 1 else probs[piece] for i, j, piece in arcs]
                shape = (len(words),)
                before, scale = _sums(((i, j, x) for (i, j, _), x in zip(arcs, p, strict=True)), size, shape, lattice.longest)
                # From the end, places count from there.
                turned = sorted(((size - j, size - i, x) for (i, j, _), x in zip(arcs, p, strict=True)), key=lambda a: a[0])
                after, scale_after = _sums(turned, size, shape, lattice.longest)
                for (i, j, piece), x in zip(arcs, p, strict=True):
                    share = before[i] * x * after[size - j] * np.exp(scale[i] + scale_after[size - j] - scale[size]) / before[size]
                    total += np.bincount(piece, weight * share, n_pieces + 1)
        total[n_pieces] = 0
        probs = (total + smooth) / (total.sum() + smooth * n_pieces)
        probs[n_pieces] = 0
    return probs[:n_pieces]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray


class Scorer:
    """Sums words' log probabilities over texts; known words are kept in a bounded table."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.lattice, self.most = model, Lattice(model.pieces), most
        self.row: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, log probabilities: texts x languages)"""
        words = [letters_only(x) if x else [] for x in texts]
        n = np.array([len(w) for w in words], np.int64)
        new = list(set().union(*words).difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.vstack([self.rows, word_log_probs(self.lattice, self.model.probs, new)])
        ids = np.fromiter(map(self.row.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        out = np.zeros((len(texts), len(self.model.languages)))
        full = np.flatnonzero(n)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            out[full] = np.add.reduceat(self.rows[ids], starts, axis=0)
        if len(self.row) > self.most:  # what was met first holds the frequent words
            self.row = dict(islice(self.row.items(), self.most // 2))
            self.rows = self.rows[: self.most // 2].copy()
        return n, out


def learn_model(documents: DataFrame, path: str, sample_bytes: int = 1 << 20) -> Model:
    """Learns from rows of (doc_key, text, lang): of each language about `sample_bytes` of text, in whole rows chosen
    by a hash. This bound on the labelled rows makes the fit's size independent of the input's."""
    sizes = documents.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    pieces = vocabulary(path)
    lattice = Lattice(pieces)
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(min(1.0, sample_bytes / max(r["n"], 1)))) for r in sizes))
    chosen = F.pmod(F.xxhash64("doc_key", "text"), F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            found: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in letters_only(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = documents.where(chosen).select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "language-words")
    languages, probs = [], []
    for lang, found in groupby(words.sort("lang").toLocalIterator(), key=lambda x: x["lang"]):
        languages.append(lang)
        probs.append(learn(lattice, Counter({x["word"]: x["n"] for x in found}), len(pieces)))
    return Model(languages, pieces, np.stack(probs, 1) if probs else np.zeros((len(pieces), 0)))


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def held_out_share(key: str, folds: int) -> Column:
    """CRC-32 of the key as text, modulo `folds`; a null key counts as empty."""
    return F.crc32(key_text(key).cast("binary")) % folds


def identify(documents: DataFrame, path: str, key: str = "doc_id", folds: int = 5, fold: int = 0, evidence: int = 20, also: tuple[str, ...] = (), **bounds: int) -> DataFrame:
    """One row per document: key, the columns `also`, held_out, lang_pred and score.

    Learns from rows with text and lang whose fold isn't `fold`; predicts for all by text only.
    lang_pred is `und`, with score 0, if the text is null or has no letter, or nothing could be
    learned. score is the predicted language's posterior with equal priors, over the whole text's
    words but weighing as `evidence` words where there are more, so that it stays informative.
    Ties go to the first language in order. Rows may repeat; an empty table gives an empty
    result. Further columns are ignored. Scoring needs no shuffle.
    """
    spark = documents.sparkSession
    known = documents.select(key, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (held_out_share(key, folds) != fold))
    model = spark.sparkContext.broadcast(learn_model(known.select(key_text(key).alias("doc_key"), "text", "lang"), path, **bounds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(name, lambda: Scorer(model.value))
        names = np.array([*scorer.model.languages, "und"], object)
        for b in text_batches(batches, 2 << 20):
            n, logs = scorer.texts(b.column(read).to_pylist())
            pred, score = np.full(len(n), len(names) - 1), np.zeros(len(n))
            if len(names) > 1:
                full = n > 0
                pred[full] = logs[full].argmax(1)
                x = logs[full] * np.minimum(1, evidence / n[full])[:, None]
                score[full] = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names[pred], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    name = ("language", uuid.uuid4().hex)
    kept, read = [key, *also, "held_out"], "text" if "text" in also else "__text"
    source = documents.select(key, *also, (held_out_share(key, folds) == fold).alias("held_out"), *([] if read == "text" else [F.col("text").cast("string").alias(read)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in kept)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
