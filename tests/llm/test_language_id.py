import math
import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from suffloom.llm.common import vocabulary_path
from suffloom.llm.language_id import Lattice, identify, key_text, learn, learn_model, letters_only, vocabulary, word_log_probs
from tests.llm.conftest import plain

PATH = vocabulary_path("piece_bpe_32k.model")


def brute(word, probs):
    text = "▁" + word

    def ways(i):
        if i == len(text):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(text) + 1):
            p = probs.get(text[i:j], 0.0)
            if j == i + 1:
                p = max(p, 1e-8)
            if p:
                total += p * ways(j)
        return total

    return math.log(ways(0))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c"]
    probs = np.array([[0.1, 0.2], [0.1, 0.1], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.1, 0.05], [0.1, 0.1], [0.1, 0.1], [0.1, 0.05]])
    words = ["a", "ab", "abab", "bab", "c", "zz", "abazaba", "aaaa"]
    got = word_log_probs(Lattice(pieces), probs, words)
    for i, w in enumerate(words):
        for k in range(2):
            assert abs(got[i, k] - brute(w, dict(zip(pieces, probs[:, k])))) < 1e-9


def test_long_words_have_finite_scores():
    pieces = vocabulary(PATH)
    assert np.isfinite(word_log_probs(Lattice(pieces), np.full((len(pieces), 2), 1e-5), ["x" * 5000, "日" * 300])).all()


def test_learning_raises_the_likelihood():
    from collections import Counter

    pieces = ["▁", "a", "b", "ab", "▁ab", "ba"]
    counts = Counter({"ab": 50, "abab": 20, "ba": 5, "a": 2})
    lattice = Lattice(pieces)

    def total(p):
        return sum(n * word_log_probs(lattice, p[:, None], [w])[0, 0] for w, n in counts.items())

    values = [total(learn(lattice, counts, len(pieces), rounds=r, smooth=1e-6)) for r in range(1, 5)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_held_out_accuracy(documents, rows):
    got = {r["doc_id"]: r for r in identify(documents, PATH).collect()}
    texts = {i: (t, lang) for i, t, lang in rows}
    prose = [i for i in range(78) if got[i]["held_out"]]
    assert prose and all(got[i]["lang_pred"] == texts[i][1] for i in prose)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in texts[i][0] or "")
        assert (r["lang_pred"] == "und") == (not letters)


def test_prediction_reads_the_text_only(spark, documents, rows):
    from pyspark.sql import functions as F

    before = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(documents, PATH).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = documents.withColumn("lang", F.when(held, F.lit("qq")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert before == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(changed, PATH).collect()}


def test_edges(documents, empty, clashing):
    from pyspark.sql import functions as F

    assert identify(empty, PATH).count() == 0
    cols = ("doc_id", "lang_pred", "score")
    assert plain(identify(clashing, PATH), *cols) == plain(identify(documents, PATH), *cols)
    none = identify(documents.withColumn("lang", F.lit(None).cast("string")), PATH)
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert identify(documents, PATH, also=("text", "source")).columns == ["doc_id", "text", "source", "held_out", "lang_pred", "score"]


def test_long_words_by_brute_force():
    """All segmentations, in exact fractions, of words far too long for plain doubles."""
    from fractions import Fraction

    rnd = random.Random(4)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "abbabaabbaababba", "c"]
    probs = np.array([[rnd.random() / 50, rnd.random() / 900] for _ in pieces])
    words = ["".join(rnd.choice("abcz") for _ in range(n)) for n in (1, 7, 8, 9, 15, 16, 17, 31, 100, 100, 400)]
    got = word_log_probs(Lattice(pieces), probs, words)
    for i, w in enumerate(words):
        for k in range(2):
            table = {x: Fraction(p) for x, p in zip(pieces, probs[:, k])}
            text = "▁" + w
            sums = [Fraction(1), *([Fraction(0)] * len(text))]
            for a in range(len(text)):
                for b in range(a + 1, min(len(text), a + 16) + 1):
                    p = table.get(text[a:b], Fraction(0))
                    sums[b] += sums[a] * (max(p, Fraction(1e-8)) if b == a + 1 else p)
            z = sums[-1]
            want = math.log(z.numerator) - math.log(z.denominator)
            assert abs(got[i, k] - want) < 1e-9 * max(1, abs(want))


def test_long_words_are_learned_from():
    from collections import Counter

    pieces = ["▁", "a", "b", "c", "d"]
    for n in (1, 20, 400):
        probs = dict(zip(pieces, learn(Lattice(pieces), Counter({"ab" * n + "cd" * n: 5}), len(pieces), smooth=1e-9), strict=True))
        assert np.allclose([probs[x] for x in "abcd"], n / (4 * n + 1)) and np.isclose(probs["▁"], 1 / (4 * n + 1))


def test_learning_is_exact_expectation():
    """One round against expected counts over all listed segmentations."""
    from collections import Counter

    pieces = ["▁", "a", "b", "ab", "▁ab", "ba", "aab"]
    counts = Counter({"abab": 3, "aabbaab": 2, "ba": 1})

    def ways(text):
        if not text:
            yield []
        for x in pieces:
            if text.startswith(x):
                for rest in ways(text[len(x) :]):
                    yield [x, *rest]

    probs = dict(zip(pieces, learn(Lattice(pieces), counts, len(pieces), rounds=0, smooth=1e-9), strict=True))
    want = Counter()
    for w, n in counts.items():
        found = [(x, math.prod(probs[y] for y in x)) for x in ways("▁" + w)]
        total = sum(p for _, p in found)
        for x, p in found:
            for y in x:
                want[y] += n * p / total
    got = learn(Lattice(pieces), counts, len(pieces), rounds=1, smooth=1e-9)
    assert np.allclose(got, [want[x] / want.total() for x in pieces], atol=1e-8)


def test_numerals_are_no_letters(spark):
    texts = ["½ ² ①", "Ⅷ", "12 ³x", "٣", "ªº", "日本", "x²y", "__", None, "a" * 100, "日" * 3000]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100 + i, "das ist der Text und die Worte", "de") for i in range(9)] + [(200 + i, "this is the text of the words", "en") for i in range(9)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in identify(df, PATH).collect()}
    for i, t in enumerate(texts):
        letters = any(unicodedata.category(c)[0] == "L" for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters), t
        assert (got[i]["score"] == 0) == (not letters)
    assert letters_only("x²y Ⅷa ½") == ["x", "y", "a"]


def test_query_by_brute_force(documents, rows):
    """Predictions and posteriors from the learned model, word by word."""
    known = documents.where("text IS NOT NULL AND lang IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = learn_model(known.select(key_text("doc_id").alias("doc_key"), "text", "lang"), PATH)
    lattice = Lattice(model.pieces)
    got = {r["doc_id"]: r for r in identify(documents, PATH).collect()}
    for i, t, _ in rows:
        words = letters_only(t or "")
        if words and len(words) < 500:
            logs = sum(word_log_probs(lattice, model.probs, [w])[0] for w in words)
            x = logs * min(1, 20 / len(words))
            score = 1 / sum(math.exp(v - max(x)) for v in x)
            assert got[i]["lang_pred"] == model.languages[int(np.argmax(logs))] and abs(got[i]["score"] - score) < 1e-6


def test_no_language_is_left_out(spark):
    words = [x[1:] for x in vocabulary(PATH) if x[0] == "▁" and len(x) == 6][:210]
    df = spark.createDataFrame([(i, f"{words[i % 210]} " * 8, f"l{i % 210}") for i in range(420)], "doc_id bigint, text string, lang string")
    got = identify(df, PATH, fold=9).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 210}" for r in got)
