"""Quality rules under weak supervision.

Each rule votes good, bad or abstains. How far a rule can be trusted isn't given but
estimated: expectation-maximisation over the histogram of all documents' votes finds
P(vote | good) and P(vote | bad) of each rule, and a document is kept by its posterior
probability of being good. The histogram has at most 3**rules rows, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.llm.common import table, text_batches, written
from suffloom.llm.html_text import STOP_WORDS

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stop", "n_upper", "n_letters")
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER_BYTES, _LETTER_BYTES = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words that the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    code = ids[: n - width + 1]
    for k in range(1, width):
        if code.size and (int(code.max()) + 1) * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[k : n - width + 1 + k]
    order = np.argsort(code, kind="stable")
    run = code[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(run), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[at + k] = True
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """FEATURES of a whole text; all zero for null."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = len(raw) - len(raw.translate(None, _UPPER_BYTES))
    letters = len(raw) - len(raw.translate(None, _LETTER_BYTES))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(map(_STOP.__contains__, raw.lower().split())),
        upper,
        letters,
    )


def features(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and FEATURES of every document; one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            rows = np.array([text_features(x) for x in b.column("text").to_pylist()], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=[key, *FEATURES])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, documents["text"].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{x} bigint" for x in FEATURES))


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, good where `good` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def default_rules() -> list[Rule]:
    enough = F.col("n_words") >= 50
    return [
        Rule("symbols", _share("n_symbols", "n_words") > 0.2, enough & (_share("n_symbols", "n_words") < 0.05)),
        Rule("dup_lines", _share("n_dup_lines", "n_lines") > 0.3, enough & (_share("n_dup_lines", "n_lines") <= 0.1)),
        Rule("repeats", _share("n_repeat_words", "n_words") > 0.3, enough & (_share("n_repeat_words", "n_words") < 0.15)),
        Rule("stop_words", enough & (_share("n_stop", "n_words") < 0.04), enough & (_share("n_stop", "n_words") > 0.1)),
        Rule("upper_case", _share("n_upper", "n_letters") > 0.5, enough & (_share("n_upper", "n_letters") < 0.2)),
        Rule("word_length", enough & ((_share("word_chars", "n_words") < 2.5) | (_share("word_chars", "n_words") > 14)), enough & _share("word_chars", "n_words").between(3, 10)),
        Rule("vocabulary", enough & (_share("n_distinct", "n_words") < 0.1) & (F.col("n_words") < 2000), enough & (_share("n_distinct", "n_words") > 0.3)),
    ]


def fit(votes: np.ndarray, count: np.ndarray, rounds: int = 100, smooth: float = 1.0, prior: float = 0.9) -> tuple[float, np.ndarray]:
    """P(good) and P(vote | class) as an array [class bad, good][rule][bad, abstain, good], by expectation-maximisation.

    votes: rows of -1, 0, 1; count: documents with that row. It starts from the majority of the
    votes, with `prior` where they tie. `smooth` pseudo-documents are given to each right vote
    and to abstaining, half as many to each wrong one, so that a rule never counts as infallible.
    """
    k = votes.shape[1]
    hot = np.stack([votes == v for v in (-1, 0, 1)], -1).astype(float)
    total = votes.sum(1)
    good = np.where(total > 0, 0.95, np.where(total < 0, 0.05, prior))
    # One rule's bad vote outweighs silence and some good votes at the start: rules fire on faults only.
    good = np.where((votes == -1).sum(1) >= 2, np.minimum(good, 0.1), good)
    lean = np.array([[1.0, 1.0, 0.5], [0.5, 1.0, 1.0]]) * smooth
    share, table_ = prior, np.full((2, k, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * count, good * count])
        table_ = np.einsum("cn,nkv->ckv", weight, hot) + lean[:, None, :]
        table_ /= table_.sum(-1, keepdims=True)
        share = (weight[1].sum() + prior) / (count.sum() + 1)
        odds = np.log(share) - np.log1p(-share) + np.einsum("nkv,kv->n", hot, np.log(table_[1]) - np.log(table_[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return float(share), table_


def judge(documents: DataFrame, key: str = "doc_id", rules: list[Rule] | None = None, min_words: int = 50, max_repeat: int = 50, threshold: float = 0.5) -> DataFrame:
    """One row per document with FEATURES, base_failed, each rule's vote, p_good and kept.

    base_failed: fewer than `min_words` words, or over `max_repeat` per cent of them repeated.
    Such documents are never kept and have no say in the estimates. A null or empty text has
    no words and so fails. Repeated rows each count; ties of votes are left to the posterior,
    and p_good = threshold is kept. An empty table gives an empty result. Other columns are
    ignored. The features (no texts) are written once to the shared folder.
    """
    rules = default_rules() if rules is None else rules
    df = features(documents, key)
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    names = [f"vote_{r.name}" for r in rules]
    df = df.withColumns({n: F.when(r.bad, -1).when(r.good, 1).otherwise(0).cast("byte") for n, r in zip(names, rules, strict=True)})
    df = written(df, "rules")
    seen = df.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).toPandas()
    share, table_ = fit(seen[names].to_numpy(int).reshape(-1, len(names)), seen["n"].to_numpy(float))
    weight = np.log(table_[1]) - np.log(table_[0])
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for n, w in zip(names, weight, strict=True):
        odds = odds + F.when(F.col(n) == -1, float(w[0])).when(F.col(n) == 1, float(w[2])).otherwise(float(w[1]))
    df = df.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
