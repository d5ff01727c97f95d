import random

import numpy as np
import pytest

from suffloom.llm import decontamination
from suffloom.llm.decontamination import Searcher, benchmark_passages, common_weight, drop_leaks, find_leaks, fit_space, plain_words
from tests.llm.conftest import EN, plain, prose


@pytest.fixture(scope="module")
def planted(spark):
    """(documents, benchmark, {(doc, item)} that must be found, documents that hold nothing)"""
    rnd = random.Random(3)
    syllables = "ka lo mi ru te sa no vi do pe ga zu".split()
    fresh = lambda n: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4))) if rnd.random() < 0.6 else rnd.choice(EN) for _ in range(n))
    items = [(i, fresh(rnd.randint(15, 60))) for i in range(30)] + [(30, None), (31, "..."), (32, fresh(150))]
    docs, must = [], set()
    for i in range(120):
        docs.append((i, prose(rnd, EN, rnd.randint(80, 400))))
    clean = set(range(120))
    for i in range(30):  # whole
        words = prose(rnd, EN, 200).split()
        at = rnd.randint(0, 200)
        docs.append((200 + i, " ".join([*words[:at], items[i][1].upper() if i % 2 else items[i][1] + ",", *words[at:]])))
        must.add((200 + i, i))
    for i in range(30):  # paraphrased: a fifth of the words are replaced, dropped or added to
        words = prose(rnd, EN, 150).split()
        changed = []
        for w in items[i][1].split():
            x = rnd.random()
            changed += [] if x < 0.05 else [w, fresh(1)] if x < 0.1 else [fresh(1)] if x < 0.18 else [w]
        docs.append((300 + i, " ".join([*words[:70], *changed, *words[70:]])))
        must.add((300 + i, i))
    docs.append((400, " ".join([prose(rnd, EN, 50), items[32][1], prose(rnd, EN, 50)])))
    must.add((400, 32))
    docs += [(500, None), (501, ""), (200, docs[120][1])]
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), must, clean


def test_planted_leaks(planted):
    documents, benchmark, must, clean = planted
    got = find_leaks(documents, benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(must - pairs) <= 1, must - pairs
    assert not {d for d, _ in pairs} & clean
    assert sum(r["doc_id"] == 200 for r in got) == 2  # the repeated row
    kept = {r["doc_id"] for r in drop_leaks(documents, benchmark).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()} - {d for d, _ in pairs}


def test_recall_of_the_latent_space(planted):
    """Candidates against cosines of the full TF-IDF vectors: of pairs at 0.6 or more, 0.9 are found."""
    documents, benchmark, _, _ = planted
    passages = benchmark_passages([(r["item_id"], r["text"]) for r in benchmark.collect()])
    space = fit_space(documents, passages, rank=24, most_fitted=100)
    searcher = Searcher(space, 0.4, 0.6, 0.45, 0.8)
    dense = np.zeros((len(passages), len(space.terms)))
    for i, p in enumerate(passages):
        for w in p.words:
            if w in space.terms:
                dense[i, space.terms[w]] += space.idf[space.terms[w]]
    dense /= np.sqrt((dense**2).sum(1, keepdims=True))
    wanted = found = 0
    for r in documents.collect():
        words = plain_words(r["text"])
        ids = np.array([space.terms.get(w, -1) for w in words], np.int32)
        at = np.flatnonzero(ids >= 0)
        got = set(zip(*(x.tolist() for x in searcher.candidates(len(words), at, ids[at])[:2])))
        for w in range(len(words) // 32 + 1):
            v = np.zeros(len(space.terms))
            for t in ids[w * 32 : w * 32 + 64]:
                if t >= 0:
                    v[t] += space.idf[t]
            if v.any():
                for j in np.flatnonzero(dense @ v / np.sqrt(v @ v) >= 0.6):
                    wanted += 1
                    found += (w, int(j)) in got
    assert wanted >= 60 and found >= 0.9 * wanted


@pytest.mark.parametrize("stage", [False, True])
def test_all_passages_are_fitted(spark, monkeypatch, stage):
    """260,000 passages of six kinds: the space's vectors are the eigenvectors of M over every one of them,
    for the query's operator and for the pipeline's stage."""
    from pyspark.sql import functions as F

    spaces = []
    monkeypatch.setattr(decontamination, "_leaks_of", lambda source, fitted, key, item, arrow, schema, bounds: spaces.append(fitted) or spark.createDataFrame([], schema))
    monkeypatch.setattr(decontamination, "_dropped", lambda documents, fitted, bounds: spaces.append(fitted) or documents)
    kinds = ["ka lo", "lo mi mi", "mi ru te", "te sa", "sa ka ka no", "no ru lo"]
    shares = [37, 20, 17, 11, 9, 6]
    text = F.expr("elt(" + ", ".join(["1 + " + " + ".join(f"int(id % 100 >= {sum(shares[:k])})" for k in range(1, 6)), *(f"'{x}'" for x in kinds)]) + ")")
    n = 260_000
    (drop_leaks if stage else find_leaks)(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")), spark.createDataFrame(enumerate(kinds), "item_id bigint, text string"))
    [space] = spaces
    x = np.zeros((6, len(space.terms)))
    for i, kind in enumerate(kinds):
        for w in kind.encode().split():
            x[i, space.terms[w]] += space.idf[space.terms[w]]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    m = (x.T * (np.array(shares) * n / 100)) @ x + n / 6 * (x.T @ x)
    v = space.vectors / space.idf[:, None]
    turned = v.T @ m @ v
    along = np.diag(turned)
    assert len(along) == len(space.terms) == 7
    assert along[:6] == pytest.approx(np.linalg.eigvalsh(m)[::-1][:6], rel=1e-4)
    assert np.abs(turned - np.diag(along)).max() < 1e-4 * along[0]


def test_common_weight_by_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        a = [bytes([rnd.choice(b"abcd")]) for _ in range(rnd.randint(0, 8))]
        b = [bytes([rnd.choice(b"abcd")]) for _ in range(rnd.randint(0, 10))]
        weight = np.array([rnd.random() for _ in a])
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + weight[i] if a[i] == b[j] else 0)
        assert common_weight(a, b, weight) == pytest.approx(best[-1, -1])


def test_the_bound_loses_nothing(planted):
    documents, benchmark, _, _ = planted
    passages = benchmark_passages([(r["item_id"], r["text"]) for r in benchmark.collect()])
    searcher = Searcher(fit_space(documents, passages), -1.0, 0.6, 0.45, 0.8)
    for r in documents.where("doc_id between 200 and 215").collect():
        words = plain_words(r["text"])
        ids = np.array([searcher.s.terms.get(w, -1) for w in words], np.int32)
        at = np.flatnonzero(ids >= 0)
        for w, p, _ in zip(*searcher.candidates(len(words), at, ids[at])):
            if not searcher.possible(at, ids[at], int(w), int(p)):
                assert searcher.verify(words, int(w), int(p))[0] < 0.45


def test_edges(spark, planted, documents, empty, clashing):
    _, benchmark, _, _ = planted
    assert find_leaks(empty, benchmark).count() == 0
    assert find_leaks(documents, benchmark.limit(0)).count() == 0
    assert drop_leaks(documents, benchmark.limit(0)).count() == documents.count()
    assert drop_leaks(clashing, benchmark).columns == clashing.columns
    own = spark.createDataFrame([(7, None), (3, ""), (9, documents.where("doc_id = 2").first()["text"])], "item_id bigint, text string")
    cols = ("doc_id", "item_id")
    assert plain(find_leaks(documents, own), *cols) == plain(find_leaks(clashing, own), *cols)
    assert (2, 9) in plain(find_leaks(documents, own), *cols)


def test_large_benchmarks_go_in_parts(spark, planted):
    documents, benchmark, _, _ = planted
    some = documents.where("doc_id % 7 = 0 OR doc_id < 40")
    size = benchmark.selectExpr("sum(octet_length(text))").first()[0]
    cols = ("doc_id", "item_id")
    whole = plain(find_leaks(some, benchmark), *cols)
    assert whole and plain(find_leaks(some, benchmark, most_benchmark_bytes=size - 1), *cols) == whole
    kept = {r["doc_id"] for r in drop_leaks(some, benchmark, most_benchmark_bytes=size - 1).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in some.select("doc_id").collect()} - {x[0] for x in whole}


def test_windows_share_the_sums_of_their_blocks():
    """Candidates are those of every window by itself, and each term's vector is read once, not once for each of its windows."""

    class Counted:
        read, shape = 0, (40, 8)
        rows = np.random.default_rng(2).standard_normal((40, 8)).astype(np.float32)

        def __getitem__(self, at):
            self.read += len(at)
            return self.rows[at]

    rng = np.random.default_rng(1)
    terms = {b"t%d" % i: i for i in range(40)}
    passages = [decontamination.Passage(i, [b"t%d" % t for t in rng.integers(0, 40, 6)], 3) for i in range(9)]
    points = rng.standard_normal((9, 8)).astype(np.float32)
    points /= np.sqrt((points * points).sum(1, keepdims=True))
    vectors = Counted()
    searcher = Searcher(decontamination.Space(terms, np.ones(40), vectors, passages, points), 0.4, 0.6, 0.45, 0.8)
    at = np.flatnonzero(rng.random(2000) < np.repeat(rng.choice([0, 0.01, 0.3], 20), 100))
    ids = rng.integers(0, 40, len(at)).astype(np.int32)
    want = set()
    for w in range(2000 // 32 + 1):
        inside = ids[(at >= w * 32) & (at < w * 32 + 64)]
        if len(inside) >= 2:
            v = vectors.rows[inside].sum(0)
            want |= {(w, int(j)) for j in np.flatnonzero(points @ v / np.sqrt(v @ v) >= 0.4)}
    got = list(zip(*(x.tolist() for x in searcher.candidates(2000, at, ids)[:2]), strict=True))
    assert len(got) > 20 and set(got) == want and len(got) == len(want)
    assert vectors.read == len(ids)


def test_sums_of_runs():
    rng = np.random.default_rng(4)
    for longest in (1, 5, decontamination._LONG, decontamination._LONG**2 + 1):
        size = np.append(rng.integers(1, longest + 1, 30), longest)
        first = np.cumsum(size) - size
        rows, at = rng.integers(0, 100, (50, 3)).astype(np.float32), rng.integers(0, 50, size.sum())
        got = decontamination._sums(rows, at, first)
        assert got.dtype == np.float32 and (got == np.add.reduceat(rows[at], first, axis=0)).all()
    none = np.zeros(0, np.int64)
    assert decontamination._sums(rows, none, none).shape == (0, 3)


def test_texts_are_searched_together(planted, monkeypatch):
    """The windows of a batch's texts are compared at once, and each text holds what it holds by itself."""
    documents, benchmark, _, _ = planted
    passages = benchmark_passages([(r["item_id"], r["text"]) for r in benchmark.collect()])
    searcher = Searcher(fit_space(documents, passages), 0.4, 0.6, 0.45, 0.8)
    leaking = [r["text"] for r in documents.where("doc_id >= 200").orderBy("doc_id").collect()]
    items = [" ".join(w.decode() for w in p.words) for p in passages]
    halves = [" ".join(x.split()[a:b]) for x in items[:10] for a, b in ((0, len(x.split()) // 2), (len(x.split()) // 2, None))]  # an item across two texts is in neither
    texts = [None, "", *leaking, "", *items, None, *halves, "..."]
    alone = [(i, *row[1:]) for i, text in enumerate(texts) for row in searcher.leaks([text])]
    calls, compare = [], searcher.candidates
    monkeypatch.setattr(searcher, "candidates", lambda *a: calls.append(a) or compare(*a))
    together = list(searcher.leaks(texts))
    assert len(calls) == 1
    assert len(alone) > 90 and [(x[0], x[1], x[5]) for x in together] == [(x[0], x[1], x[5]) for x in alone]
    assert np.array([x[2:5] for x in together]) == pytest.approx(np.array([x[2:5] for x in alone]), abs=1e-5)
    assert list(searcher.leaks([])) == []
    monkeypatch.setattr(searcher, "blocks", 20)
    assert [(x[0], x[1], x[5]) for x in searcher.leaks(texts)] == [(x[0], x[1], x[5]) for x in alone] and 10 < len(calls) < len(texts)
