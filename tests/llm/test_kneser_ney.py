import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from suffloom.llm.common import lower_words_of
from suffloom.llm.kneser_ney import BEGIN, END, _packed, _unpacked, discounts, score_documents
from tests.llm.conftest import plain


class Brute:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            self.c.update(t)
            self.pairs.update(zip([BEGIN, *t], t))
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.total, self.kinds, self.before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (a, b), n in self.pairs.items():
            self.total[a] += n
            self.kinds[a][min(n, 3) - 1] += 1
            self.before[b] += 1
        count = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
        self.d, self.e = discounts(count(self.pairs.values())), discounts(count(self.before.values()))
        self.S = sum(self.before.values())
        self.rest = sum(self.e[min(v, 3)] for v in self.before.values()) / self.S

    def one(self, w):
        n = self.before.get(w, 0)
        return max(n - self.e[min(n, 3)], 0) / self.S + self.rest / (self.V + 1)

    def two(self, a, b):
        if not self.total.get(a):
            return self.one(b)
        n = self.pairs.get((a, b), 0)
        rest = sum(self.d[i + 1] * self.kinds[a][i] for i in range(3)) / self.total[a]
        return max(n - self.d[min(n, 3)], 0) / self.total[a] + rest * self.one(b)


@pytest.mark.parametrize("buckets", [None, 1, 4])
def test_against_brute_force(documents, rows, buckets, monkeypatch):
    texts = {k: (i, [*lower_words_of(t), END]) for k, (i, t, _) in enumerate(rows)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts.values()}
    model = Brute([t for i, t in texts.values() if not held[i]])
    assert sum(model.two(b"the", w) for w in model.c) + model.two(b"the", b"?") == pytest.approx(1)
    got = {}
    for r in score_documents(documents, buckets=buckets).collect():
        got[r["doc_id"]] = r
    for i, t in texts.values():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(model.c[w] > 0 for w in t), model.N)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c[w] + 1) / (model.N + model.V + 1)) for w in t), rel=1e-12)
        assert r["score"] == pytest.approx(sum(math.log10(model.two(a, b)) for a, b in zip([BEGIN, *t], t)), rel=1e-12)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(t)))


def test_hot_words_are_spread(documents, monkeypatch):
    from suffloom.llm import kneser_ney

    want = plain(score_documents(documents), "doc_id", "score")
    count = kneser_ney.count_words
    monkeypatch.setattr(kneser_ney, "count_words", lambda train, store, buckets, hot: count(train, store, buckets, 3))
    got = plain(score_documents(documents, buckets=8), "doc_id", "score")
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-12)


def test_held_out_beats_unigrams(documents):
    held = [r for r in score_documents(documents).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark, empty, clashing, documents):
    assert score_documents(empty).count() == 0
    assert plain(score_documents(clashing), "doc_id", "score") == plain(score_documents(documents), "doc_id", "score")
    lone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    only_held = spark.createDataFrame([(lone[0], "a b"), (lone[1], None), ], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in score_documents(only_held).collect()}
    assert got[lone[0]]["n_tokens"] == 3 and got[lone[0]]["score"] == 0 and got[lone[0]]["base_score"] == 0


def test_blobs():
    keys = np.array([0, 1, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    counts = np.array([1, 2, 3, 1 << 31, 7])
    k, c = _unpacked(_packed(keys, counts))
    assert (k == keys).all() and (c == counts).all()


def test_discounts():
    assert discounts([100, 40, 20, 10]).tolist() == pytest.approx([0, 1 - 2 * (100 / 180) * 0.4, 2 - 3 * (100 / 180) * 0.5, 3 - 4 * (100 / 180) * 0.5])
    assert discounts([3, 0, 1, 1]).tolist() == [0, 0.5, 1, 1.5]


def test_counts_past_32_bits(spark, tmp_path):
    """Kept in 64 bits where they don't fit 32, in what is shuffled and in what is looked up."""
    from suffloom.llm.kneser_ney import Model, Scorer
    from suffloom.llm.store import ArrayStore

    keys, counts = np.array([3, 9, 2**63], np.uint64), np.array([1, 2**33 + 5, 7], np.int64)
    got = _unpacked(_packed(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()
    for kind in ("<u4", "<u8"):
        store = ArrayStore(str(tmp_path / kind[1:]))
        some = np.array([0, 1, 1 << 32], np.uint64)
        store.put("0.words", np.array([5, 6], "<u8"))
        store.put("0.pairs", some)
        store.put("0.paircounts", np.array([4, 2**33 if kind == "<u8" else 9, 2], kind))
        scorer = Scorer.__new__(Scorer)
        scorer.m, scorer.hot = Model(store, np.array([0, 2]), 10, np.zeros(4), np.zeros(4), 0, (0, 0, 0)), np.zeros(0, np.int64)
        assert scorer._pair_counts(np.array([1, 1 << 32, 7, 1], np.uint64)).tolist() == [2**33 if kind == "<u8" else 9, 2, 0, 2**33 if kind == "<u8" else 9]
