import numpy as np
import pytest
from pyspark.sql import functions as F

from suffloom.llm.importance import BUCKETS, best_cut, hashed_ngrams, kth_largest, log_ratios, resample
from tests.llm.conftest import plain


@pytest.fixture(scope="module")
def labels(spark, rows):
    given = [(i, 0 if t and "&&&" in t else 1) for i, t, _ in rows if t and i < 78 and i % 4 != 3]
    return spark.createDataFrame([*given, (1, 1), (70, 0), (70, 1), (None, 1), (2, None)], "doc_id bigint, quality int")


def test_junk_goes_and_prose_stays(documents, labels, rows):
    got = {r["doc_id"]: r for r in resample(documents, labels).collect()}
    assert len(got) == len({i for i, _, _ in rows})
    junk = {i for i, t, _ in rows if t and "&&&" in t}
    assert not any(got[i]["kept"] for i in junk)
    assert sum(got[i]["kept"] for i in range(70)) >= 69
    assert got[82]["n_features"] == got[83]["n_features"] == 0 and got[82]["log_weight"] == 0.0


def test_weights_by_brute_force(documents, labels, rows):
    got = {r["doc_id"]: r["log_weight"] for r in resample(documents, labels).collect()}
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    worst = {i: min(q for j, q in [(r["doc_id"], r["quality"]) for r in labels.collect()] if j == i and q is not None) for i in {r["doc_id"] for r in labels.where("quality is not null and doc_id is not null").collect()}}
    fit = {r["doc_id"] for r in documents.select("doc_id").distinct().where(F.xxhash64(F.lit(7), "doc_id").bitwiseAND(1) == 0).collect()}
    for i, t, _ in rows:
        for f in hashed_ngrams(t):
            raw += np.bincount(f, minlength=BUCKETS)
            if i in fit and worst.get(i, 0) > 0:
                target += np.bincount(f, minlength=BUCKETS)
    ratio = log_ratios(raw, target)
    for i, t, _ in rows:
        total, n = 0.0, 0
        for f in hashed_ngrams(t):
            total, n = total + ratio[f].sum(), n + len(f)
        assert got[i] == pytest.approx(total * 200 / (n + 200), abs=1e-9)


def test_top_k(documents, labels):
    rows = resample(documents, labels, k=20).select("doc_id", "sample_key", "kept").collect()
    keys = sorted((r["sample_key"] for r in rows), reverse=True)
    assert {r["kept"] for r in rows if r["sample_key"] >= keys[19]} == {True}
    assert {r["kept"] for r in rows if r["sample_key"] < keys[19]} == {False}


def test_same_result_again(documents, labels):
    cols = ("doc_id", "log_weight", "sample_key", "kept")
    assert plain(resample(documents, labels), *cols) == plain(resample(documents.repartition(7), labels), *cols)


def test_edges(documents, empty, clashing, labels):
    assert resample(empty, labels).count() == 0
    assert resample(documents, labels.limit(0)).where("kept").count() == documents.count()
    out = resample(clashing, labels, also=("text", "source"))
    assert out.columns == ["doc_id", "text", "source", "n_features", "log_weight", "sample_key", "kept"]
    assert plain(out, "doc_id", "text", "kept") == plain(resample(documents, labels, also=("text", "source")), "doc_id", "text", "kept")


def test_kth_largest(spark):
    values = [0.0, 0.0, 1.5, -3.0, 1e9, 1.5, 7.25, float(np.pi)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, 9):
        assert kth_largest(df, "x", k, bins=4) == sorted(values, reverse=True)[k - 1]


def test_best_cut():
    assert best_cut(np.array([5.0, 6, 7]), np.array([1.0, 2])) == 3.5
    assert best_cut(np.array([]), np.array([1.0])) == float("-inf")
    assert best_cut(np.array([0.0, 9]), np.array([5.0] * 50)) <= 0


def test_long_texts_come_in_parts():
    text = "word " * 600_000
    parts = list(hashed_ngrams(text))
    assert len(parts) > 1 and sum(len(p) for p in parts) > 600_000
