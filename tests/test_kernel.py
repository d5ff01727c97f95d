import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from suffloom.functions import kernel, strings


def naive(text: bytes) -> list[int]:
    return sorted(range(len(text)), key=lambda i: text[i:])


EDGES = {
    b"": [],
    b"a": [0],
    b"ab": [0, 1],
    b"ba": [1, 0],
    b"aaaa": [3, 2, 1, 0],
    b"banana": [5, 3, 1, 0, 4, 2],
    b"mississippi": [10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2],
    b"abaababa": [7, 2, 5, 0, 3, 6, 1, 4],
    b"a\0a\0": [3, 1, 2, 0],
    b"\xff\xfe\xff": [1, 2, 0],
    "aäb".encode(): [0, 3, 2, 1],
}


@pytest.mark.parametrize("text", EDGES)
def test_edge_strings(text):
    assert kernel.suffix_array(text).tolist() == EDGES[text] == naive(text)


small = st.lists(st.sampled_from([0, 1, 97, 98, 255]), max_size=60).map(bytes)


@settings(max_examples=200, deadline=None)
@given(st.lists(small, max_size=6))
def test_many_texts_at_once(texts):
    starts, order = kernel.sort_suffixes(texts)
    for i, t in enumerate(texts):
        assert order[starts[i] : starts[i + 1]].tolist() == naive(t)


@pytest.mark.parametrize("text", [b"ab" * 100, b"a" * 300 + b"b", b"b" + b"a" * 300, bytes(range(256)) * 2, b"x" * 50 + b"y" + b"x" * 50])
def test_periods_and_wraps(text):
    assert kernel.suffix_array(text).tolist() == naive(text)


@settings(max_examples=200, deadline=None)
@given(small.filter(len))
def test_inverse_transform(text):
    order = kernel.suffix_array(text)
    symbols = np.array([text[p - 1] if p else 0 for p in order], np.uint8)
    assert kernel.invert_bwt(symbols, order.tolist().index(0), text[-1]) == text


@settings(max_examples=200, deadline=None)
@given(small, small)
def test_interval(text, pattern):
    order = kernel.suffix_array(text)
    lo, hi = kernel.interval(text, order, pattern)
    found = [i for i, p in enumerate(order) if text[p:].startswith(pattern)]
    assert found == list(range(lo, hi))
    assert lo == sum(text[p:][: len(pattern)] < pattern for p in range(len(text)))


@settings(max_examples=200, deadline=None)
@given(small, small, st.integers(0, 5))
def test_refining_an_interval(text, pattern, known):
    order = kernel.suffix_array(text)
    known = min(known, len(pattern))
    lo, hi = kernel.interval(text, order, pattern[:known])
    want = kernel.interval(text, order, pattern)
    got = kernel.refine(text, order, lo, hi, known, pattern)
    assert got == want if lo < hi else got == (lo, lo)


@settings(max_examples=200, deadline=None)
@given(small.filter(len))
def test_maximal_suffix(text):
    start, period = strings.maximal_suffix(text)
    assert start == max(range(len(text)), key=lambda i: text[i:])
    top = text[start:]
    assert period == min(p for p in range(1, len(top) + 1) if top[p:] == top[: len(top) - p])


def test_merge_schedule_is_cheapest():
    def cost(n):
        return 0 if n < 2 else min(left + 10 * (n - left) + cost(left) + cost(n - left) for left in range(1, n))

    assert [c for _, _, c in strings.merge_schedule(8)] == [cost(n) for n in range(1, 9)]
    assert all(left <= 2 for _, left, _ in strings.merge_schedule(9, most_left=2))


def test_more_texts_than_a_sort_takes(monkeypatch):
    monkeypatch.setattr(kernel, "MOST_TEXTS", 3)
    texts = [b"ab" * (i % 4) + bytes([97 + i]) for i in range(11)]
    starts, order = kernel.sort_suffixes(texts)
    for i, t in enumerate(texts):
        assert order[starts[i] : starts[i + 1]].tolist() == naive(t)
