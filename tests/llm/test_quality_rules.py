import re
from collections import Counter

import numpy as np
import pytest

from suffloom.llm.quality_rules import fit, judge, repeated_words, text_features
from tests.llm.conftest import plain

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] >= 2:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


EXTRA = ["a b c a b c", "a a a a", "x\nx\n \n \nx", "é ü z # *", "a\x1cb c", "1 2 3\n1 2 3", "w " * 50, "<b>|x|</b> $5 & 6%"]


def test_features_by_brute_force(rows):
    for t in [t for _, t, _ in rows] + EXTRA:
        assert text_features(t)[:5] == brute(t)


@pytest.mark.parametrize("size", [3, 50])
def test_repeated_words_with_many_kinds(size):
    rnd = np.random.default_rng(size)
    words = [b"%d" % x for x in rnd.integers(0, size, 400)]
    assert repeated_words(words) == brute(b" ".join(words).decode())[4]


def test_verdicts(documents, rows):
    got = {r["doc_id"]: r for r in judge(documents).collect()}
    for i, t, _ in rows:
        n, _, _, _, rep = brute(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert all(got[i]["kept"] for i in range(70) if not got[i]["base_failed"])
    assert not any(got[i]["kept"] for i in range(70, 78))


def test_em_finds_accuracies():
    rnd = np.random.default_rng(1)
    n = 20000
    good = rnd.random(n) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.stack([np.where(rnd.random(n) < 0.3, 0, np.where(rnd.random(n) < a, 1, -1) * np.where(good, 1, -1)) for a in accuracy], 1)
    patterns, back, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table = fit(patterns, count.astype(float))
    assert share == pytest.approx(0.8, abs=0.03)
    estimated = table[1][:, 2] / (table[1][:, 2] + table[1][:, 0])
    assert np.allclose(estimated, accuracy, atol=0.04)


def test_edges(empty, clashing, documents):
    assert judge(empty).count() == 0
    cols = ("doc_id", "n_words", "base_failed", "kept")
    assert plain(judge(clashing), *cols) == plain(judge(documents), *cols)
