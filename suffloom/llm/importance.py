"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (rows labelled good) and one of
all raw text, give each document an importance weight, the ratio of its probabilities; documents
are then sampled without replacement in proportion to it, by Gumbel top-k.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.llm.common import table, text_batches, written

WORD_BITS, SIGN_BITS = 13, 16
BUCKETS = (1 << WORD_BITS) + (1 << SIGN_BITS)
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_REPEAT = np.uint64(0x5851F42D4C957F2D)
_PART = 1 << 20


def _features(raw: bytes) -> np.ndarray:
    words = raw.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pair = ((h[:-1] * _MIX) ^ h[1:]) * _MIX2
    pair[h[1:] == h[:-1]] = _REPEAT  # a word after itself is one and the same bigram, whatever the word
    signs = np.frombuffer(b" " + raw, np.uint8).astype(np.uint64)
    three = ((signs[:-2] << np.uint64(16)) | (signs[1:-1] << np.uint64(8)) | signs[2:]) * _MIX
    shift = np.uint64(64 - WORD_BITS)
    return np.concatenate([h >> shift, pair >> shift, (three >> np.uint64(64 - SIGN_BITS)) + np.uint64(1 << WORD_BITS)]).astype(np.int64)


def hashed_ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's words, word pairs and byte triples. Texts over a mebibyte come in parts
    cut behind white space, which n-grams don't cross."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    begin = 0
    while begin < len(raw):
        end = begin + _PART
        if end < len(raw):
            space = max(raw.rfind(b" ", begin, end), raw.rfind(b"\n", begin, end))
            end = space + 1 if space > begin else end
        yield _features(raw[begin:end])
        begin = end


def _schema(df: DataFrame, columns: Iterable[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def count_ngrams(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all rows' texts and of those with `target`. Each task sends a row for each
    bucket that it has seen; the result has BUCKETS rows at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in text_batches(batches):
            for text, good in zip(b.column("text").to_pylist(), b.column("target").to_pylist(), strict=True):
                for f in hashed_ngrams(text):
                    n = np.bincount(f, minlength=BUCKETS)
                    raw += n
                    if good:
                        target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counted = documents.select("text", "target").mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counted["bucket"]], target[counted["bucket"]] = counted["raw"], counted["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw). The target model is smoothed towards the raw one,
    with `smooth` pseudo-counts a bucket, so that what the target lacks by its size weighs little."""
    p = (raw + 1e-3) / (raw + 1e-3).sum()
    q = (target + smooth * BUCKETS * p) / (target.sum() + smooth * BUCKETS)
    return np.log(q / p)


def _gumbel(key: Column, seed: int) -> Column:
    """A standard Gumbel variate that depends on the key alone, so that a task run again gives the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / (1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, rounds: int = 8) -> float:
    """The k-th largest value, by histograms over ever smaller ranges: no sort, `bins` rows a round to the driver."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return float("inf")
    above = 0
    for _ in range(rounds):
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            break
        inside = df.where(F.col(column).between(lo, hi))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / step)).cast("int")
        rows = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def best_cut(good: np.ndarray, bad: np.ndarray, most_lost: float = 0.01) -> float:
    """Where the share of good values kept plus that of bad values dropped is largest, the middle of
    the widest such gap; but no higher than loses `most_lost` of the good ones."""
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    kept = 1 - np.searchsorted(good, values, side="left") / len(good)
    dropped = np.searchsorted(bad, values, side="left") / len(bad)
    total = kept + dropped
    best = np.flatnonzero(total >= total.max() - 1e-12)
    below = np.where(best > 0, values[best - 1], values[best])
    i = int((values[best] - below).argmax())
    return float(min((values[best][i] + below[i]) / 2, np.quantile(good, most_lost, method="lower")))


def resample(documents: DataFrame, labels: DataFrame, key: str = "doc_id", evidence: int = 200, most_labels: int = 40_000, seed: int = 7, k: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, the columns `also`, n_features, log_weight, sample_key and kept.

    labels: key and quality (1 good, 0 bad; of several, the lowest; null: none). Up to
    `most_labels` of them are used, chosen by a hash; half of the good ones make the target
    model, the other half and the bad ones calibrate. The raw model counts all documents.
    log_weight is the sum of the n-grams' log ratios, times evidence / (n + evidence): a long
    text weighs as `evidence` n-grams, a short one as it is. A document is kept if log_weight
    plus a Gumbel variate is among the k largest. k: by default, the number of documents whose
    log_weight reaches the cut that best parts the calibrating labels (see best_cut). Ties with the k-th are
    kept, so that repeated rows share one fate. With `also`, those columns are written along to the
    shared folder and come back beside the verdict, without a join.

    Null and empty texts have no n-grams and weight 0. Without good or without bad labels all
    are kept. An empty table gives an empty result. Other columns are ignored. No text is
    shuffled: labels are bounded and broadcast.
    """
    spark = documents.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64(key), key).limit(most_labels).withColumn("fit", (F.xxhash64(F.lit(seed), key).bitwiseAND(1) == 0) & (F.col("quality") > 0))
    flagged = documents.select(key, F.col("text").cast("string").alias("text"), *(c for c in also if c != "text"))
    flagged = flagged.join(F.broadcast(known.withColumnsRenamed({"quality": "__quality", "fit": "__fit"})), key, "left")
    carried = (key, *also, "__quality", "__fit")
    ratios = spark.sparkContext.broadcast(log_ratios(*count_ngrams(flagged.select("text", F.coalesce("__fit", F.lit(False)).alias("target")))))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = ratios.value
        for b in text_batches(batches):
            out = np.zeros((b.num_rows, 2))
            for i, text in enumerate(b.column("text").to_pylist()):
                for f in hashed_ngrams(text):
                    out[i] += len(f), weight[f].sum()
            log_weight = out[:, 1] * evidence / (out[:, 0] + evidence)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(out[:, 0].astype(np.int64)), pa.array(log_weight)], names=[*carried, "n_features", "log_weight"])

    scored = flagged.mapInArrow(score, f"{_schema(flagged, carried)}, n_features bigint, log_weight double")
    scored = written(scored.withColumn("sample_key", F.col("log_weight") + _gumbel(F.col(key), seed)), "importance")
    if k is None:
        marks = scored.where(F.col("__quality").isNotNull() & ~F.col("__fit")).select(key, F.col("__quality").alias("quality"), "log_weight").dropDuplicates([key]).toPandas()  # at most most_labels rows
        cut = best_cut(marks["log_weight"][marks["quality"] > 0].to_numpy(float), marks["log_weight"][marks["quality"] <= 0].to_numpy(float))
        k = scored.where(F.col("log_weight") >= cut).count()
    return scored.select(key, *also, "n_features", "log_weight", "sample_key", (F.col("sample_key") >= kth_largest(scored, "sample_key", k)).alias("kept"))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
