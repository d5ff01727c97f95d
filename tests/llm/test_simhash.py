import re

import numpy as np
import pytest
import xxhash

from suffloom.llm import simhash
from suffloom.llm.components import connected_components
from suffloom.llm.simhash import fingerprint, keep_one_each, links, near_duplicates
from tests.llm.conftest import plain


def brute(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            count[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * count[i] > len(shingles))


def components(fps):
    """By comparing all pairs."""
    values = sorted(set(fps))
    a = np.array(values, np.uint64)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            p, q = find(v), find(values[j])
            root[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def test_fingerprints(rows, monkeypatch):
    texts = [t for _, t, _ in rows] + ["a", "a b", "a b c", "a b c d", "A\tB\nc", "É é", "a b c " * 5]
    for t in texts:
        assert fingerprint(t) == brute(t)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    for t in texts:
        assert fingerprint(t) == brute(t)


def test_groups(documents, rows):
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in near_duplicates(documents).collect()}
    fps = {i: brute(t) for i, t, _ in rows}
    root = components(fps.values())
    for i, f in fps.items():
        assert got[i] == (f, min(j for j, g in fps.items() if root[g] == root[f]))
    assert near_duplicates(documents).count() == len(rows)


@pytest.fixture(scope="module")
def crowd(spark):
    """A group of near fingerprints that all share bytes, chains, pairs at distances up to four, the signs' edges."""
    rnd = np.random.default_rng(5)
    values = {int(x) for x in rnd.integers(0, 1 << 64, 300, np.uint64)} | {0, 1, 3, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for base in [int(x) for x in rnd.integers(0, 1 << 64, 20, np.uint64)]:
        for d in range(1, 5):
            v = base
            for b in rnd.choice(64, d, replace=False):
                v ^= 1 << int(b)
            values |= {base, v}
    base = 0x0123456789ABCDEF
    values |= {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rnd.integers(0, 64, (200, 3))}
    v = 0xF0F0F0F0F0F0F0F0
    for k in range(40):
        v ^= 3 << int(rnd.integers(0, 63))
        values.add(v)
    rows = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    return spark.createDataFrame(rows, "fp bigint").cache(), components(values)


@pytest.mark.parametrize("longest", [1, 2, 8, 1000])
def test_links_lose_nothing(crowd, longest):
    df, want = crowd
    edges = links(df, 2, longest)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= (2 if longest == 1000 else 4)
    got = {}
    for r in connected_components(edges).collect():
        got.setdefault(r["component"], set()).add(r["node"] & (1 << 64) - 1)
    groups = {}
    for v, r in want.items():
        groups.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("longest", [1, 1000])
@pytest.mark.parametrize("bits", [0, 1])
def test_fewer_bits(crowd, bits, longest):
    df, _ = crowd
    values = [r["fp"] for r in df.collect()]
    want = {(min(a, b), max(a, b)) for a in values for b in values if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links(df, bits, longest).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (101, 100), (200, 300), (300, 250)] + [(1000, 2000 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 300: 200, 250: 200, 1000: 1000, **{2000 + i: 1000 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_stays(documents, rows):
    kept = [r["doc_id"] for r in keep_one_each(documents).collect()]
    groups = {r["component_id"] for r in near_duplicates(documents).collect()}
    assert sorted(kept) == sorted(groups)
    assert {3, 50} <= set(kept) and not {78, 79, 80, 81} & set(kept)
    assert keep_one_each(documents).columns == documents.columns


@pytest.mark.parametrize("per_bucket", [2, 1000])
def test_without_keys(spark, documents, per_bucket):
    from suffloom.llm.simhash import without_keys

    keys = spark.createDataFrame([(i,) for i in [5, 6, 7, 80, 999, -3, 5]], "doc_id bigint")
    nulls = documents.unionByName(documents.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    want = plain(nulls.where("doc_id is null or doc_id not in (5, 6, 7, 80)"), "doc_id", "text")
    out = without_keys(nulls, keys, "doc_id", per_bucket)
    assert plain(out, "doc_id", "text") == want and out.columns == documents.columns
    assert without_keys(nulls, keys.limit(0), "doc_id").count() == nulls.count()


def test_heavy_classes(spark):
    df = spark.createDataFrame([(i, "one text for all of them here") for i in range(300)] + [(300 + i, f"text {i} x y z") for i in range(50)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert len(got) == 350 and all(got[i] == 0 for i in range(300))


def test_edges(spark, empty, clashing, documents):
    assert near_duplicates(empty).count() == 0 and keep_one_each(empty).count() == 0
    cols = ("doc_id", "fp", "component_id")
    assert plain(near_duplicates(clashing), *cols) == plain(near_duplicates(documents), *cols)
    nulls = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "lonely text here"), (2, None)], "doc_id bigint, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(nulls).collect()), key=repr) == sorted([(None, 4), (4, 4), (None, None), (2, 2)], key=repr)
    assert keep_one_each(nulls).count() == 4
