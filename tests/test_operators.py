import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from suffloom.functions import kernel
from suffloom.operators import blocks, bwt, merging, search
from suffloom.operators import suffix_array as sa
from suffloom.operators.ranking import competition_ranks

TEXTS = [b"", b"a", b"banana", b"mississippi", b"aaaaaaaa", b"a\0a\0", b"\xff\xfe\xff", "aäb".encode(), b"missis" b"sippi" * 3, b"ab" * 20 + b"c" + b"ab" * 20]
random.seed(5)
TEXTS += [bytes(random.choice([0, 97, 98, 255]) for _ in range(random.randint(1, 40))) for _ in range(12)]


def naive(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(TEXTS)], "text_id bigint, bytes binary")


@pytest.fixture(scope="module")
def suf(texts):
    return sa.suffixes(texts).cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("strategy", ["kernel", "windows", "doubling", "auto"])
def test_strategies(texts, strategy):
    got = rows(sa.suffix_array(texts, strategy), "text_id", "rank", "pos")
    assert got == [(i, r, p) for i, t in enumerate(TEXTS) for r, p in enumerate(naive(t))]


def test_strategies_give_the_same_table(texts, suf):
    cols = suf.columns
    for strategy in ("windows", "doubling"):
        assert rows(sa.suffixes(texts, strategy), *cols) == rows(suf, *cols)


def test_long_texts_are_doubled(texts, suf, monkeypatch):
    monkeypatch.setattr(sa, "KERNEL_LIMIT", 10)
    assert rows(sa.suffixes(texts), *suf.columns) == rows(suf, *suf.columns)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "text_id bigint, bytes binary")
    for strategy in ("kernel", "windows", "doubling", "auto"):
        assert sa.suffixes(empty, strategy).count() == 0


def test_ranks_without_one_partition(spark):
    df = spark.createDataFrame([(x % 7, x % 3) for x in range(100)], "a int, b int")
    got = {(r["a"], r["b"]): r["rank"] for r in competition_ranks(df, ["a", "b"]).collect()}
    values = [(x % 7, x % 3) for x in range(100)]
    assert got == {v: sum(w < v for w in values) for v in values}


@pytest.mark.parametrize("large", [False, True])
def test_occurrences_and_lf(suf, large):
    occ = {(r["text_id"], r["rank"]): (r["sym"], r["occ"]) for r in bwt.occurrences(suf, large).collect()}
    lf = {(r["text_id"], r["rank"]): r["lf"] for r in bwt.lf_mapping(suf, large).collect()}
    for i, t in enumerate(TEXTS):
        order = naive(t)
        b = [t[p - 1] if p else 0 for p in order]
        for r, p in enumerate(order):
            assert occ[i, r] == (b[r], b[:r].count(b[r]))
            if p:
                assert lf[i, r] == order.index(p - 1)
            else:
                assert (i, r) not in lf


def test_inverse(suf):
    last = suf.where(F.col("pos") == F.col("n") - 1).select("text_id", F.col("sym").alias("last"))
    got = {r["text_id"]: bytes(r["bytes"]) for r in bwt.inverse_bwt(bwt.bwt(suf), bwt.primary_index(suf), last).collect()}
    assert got == {i: t for i, t in enumerate(TEXTS) if t}


def test_histogram(texts):
    whole = b"".join(TEXTS)
    assert rows(bwt.byte_histogram(texts), "sym", "cnt") == [(s, whole.count(s)) for s in range(256) if s in whole]


@pytest.mark.parametrize("large", [False, True])
def test_gap_and_merges(suf, large):
    left, right = blocks.zone(2, 0), blocks.zone(2, 1)
    got = {(r["text_id"], r["slot"]): r["cnt"] for r in blocks.gap(suf, left, right, large).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        h = len(t) // 2
        for q in range(h, len(t)):
            slot = sum(t[p:] < t[q:] for p in range(h))
            want[i, slot] = want.get((i, slot), 0) + 1
    assert got == want
    full = [(i, r, p) for i, t in enumerate(TEXTS) for r, p in enumerate(naive(t))]
    assert rows(merging.merge_halves(suf, large), "text_id", "rank", "pos") == full
    assert rows(merging.merge_parts(suf, 5, large), "text_id", "rank", "pos") == full
    assert rows(merging.merge_transforms(suf, large), "text_id", "rank", "sym") == rows(bwt.bwt(suf), "text_id", "rank", "sym")


def test_published_block_examples(spark):
    df = spark.createDataFrame([(0, bytearray(b"banana")), (1, bytearray(b"mississippi"))], "text_id bigint, bytes binary")
    s = sa.suffixes(df)
    zones = (F.col("pos") < F.when(F.col("text_id") == 0, 3).otherwise(6)), (F.col("pos") >= F.when(F.col("text_id") == 0, 3).otherwise(6))
    gaps = blocks.dense_gap(blocks.gap(s, *zones), blocks.zone_sizes(s, zones[0]))
    got = {}
    for r in gaps.orderBy("text_id", "slot").collect():
        got.setdefault(r["text_id"], []).append(r["cnt"])
    assert got == {0: [2, 0, 1, 0], 1: [2, 0, 0, 3, 0, 0, 0]}
    one = s.where("text_id = 0")
    assert [r["gt"] for r in blocks.gt_begin(one).orderBy("pos").collect()] == [False, True, False, True, False]
    assert [r["gt"] for r in blocks.gt_end(one, F.lit(0), F.lit(3)).orderBy("pos").collect()] == [True, True, True]


def test_gap_counts_above_a_byte(spark):
    df = spark.createDataFrame([(0, bytearray(b"b" + b"a" * 300))], "text_id bigint, bytes binary")
    s = sa.suffixes(df)
    assert rows(blocks.gap(s, F.col("pos") < 1, F.col("pos") >= 1), "slot", "cnt") == [(0, 300)]


def test_matrix(suf):
    got = {(r["text_id"], r["row"], r["col"]): r["cnt"] for r in blocks.block_rank_matrix(suf, 3).collect()}
    for i, t in enumerate(TEXTS):
        if not t:
            continue
        n = len(t)
        for c in range(3):
            for r in range(c):
                end = t[n * (c + 1) // 3 :]
                assert got[i, r, c] == sum(t[p:] < end for p in range(n * r // 3, n * (r + 1) // 3))


def test_search(spark, texts, suf):
    pats = [b"a", b"an", b"ss", b"\xff", b"", b"zzz", b"\0"]
    patterns = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(pats)], "pat_id int, pat binary")
    found = rows(search.pattern_positions(texts, patterns), "text_id", "pat_id", "pos")
    want = sorted((i, k, p) for i, t in enumerate(TEXTS) for k, pat in enumerate(pats) for p in range(len(t)) if t[p:].startswith(pat))
    assert found == want
    counts = {r["pat_id"]: r["cnt"] for r in search.pattern_counts(texts, patterns).collect()}
    assert counts == {k: sum(x[1] == k for x in want) for k in range(len(pats))}
    for pat in (b"an", b"zzz"):
        got = {r["text_id"]: (r["lo"], r["hi"]) for r in search.pattern_range_of_rows(suf, texts, pat).collect()}
        for i, t in enumerate(TEXTS):
            if t:
                heads = [t[p : p + len(pat)] for p in range(len(t))]
                assert got[i] == (sum(h < pat for h in heads), sum(h <= pat for h in heads))


def test_patterns_must_be_small(spark, texts, monkeypatch):
    monkeypatch.setattr(search, "MOST_PATTERN_BYTES", 2)
    with pytest.raises(ValueError):
        search.pattern_ranges(texts, spark.createDataFrame([(0, bytearray(b"abc"))], "pat_id int, pat binary"))


def test_random_texts(spark):
    from suffloom.functions.generate import random_texts

    df = random_texts(spark, 5, 40, b"ab\xff", 3)
    got = [bytes(r["bytes"]) for r in df.orderBy("text_id").collect()]
    assert len(set(got)) == 5 and all(len(t) == 40 and set(t) <= set(b"ab\xff") for t in got)
    assert got == [bytes(r["bytes"]) for r in random_texts(spark, 5, 40, b"ab\xff", 3).orderBy("text_id").collect()]
    assert rows(sa.suffix_array(df), "text_id", "rank", "pos") == [(i, r, p) for i, t in enumerate(got) for r, p in enumerate(naive(t))]


def test_order_faults(spark, suf):
    assert {(r["n"], r["positions"], r["faults"]) for r in sa.order_faults(suf).collect()} == {(len(t), len(t) * (len(t) - 1) // 2, 0) for t in TEXTS if t}
    swapped = suf.where("text_id = 3").withColumn("rank", F.when(F.col("rank") == 4, 5).when(F.col("rank") == 5, 4).otherwise(F.col("rank")))
    assert sa.order_faults(swapped).first()["faults"] > 0
    doubled = suf.where("text_id = 3").withColumn("rank", F.when(F.col("rank") == 4, 5).otherwise(F.col("rank")))
    assert sa.order_faults(doubled).first()["faults"] > 0


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("log", [0, 1, 3])
def test_approximate_rank(spark, suf, log, large):
    asked = [(i, at, s) for i in (2, 3, 4, 9) for at in range(0, len(TEXTS[i]) + 1, 3) for s in (0, 97, 98, 115)]
    got = {(r["text_id"], r["i"], r["sym"]): r["occ"] for r in bwt.approximate_rank(bwt.rank_samples(suf, log, large), spark.createDataFrame(asked, "text_id bigint, i bigint, sym int"), log, large).collect()}
    for i, at, s in asked:
        b = [TEXTS[i][p - 1] if p else 0 for p in naive(TEXTS[i])]
        assert got[i, at, s] == b[:at].count(s) >> log << log


def test_splits(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([1, 7, 16, 17, 63, 64, 65, 100, 1000])], "text_id bigint, n bigint")
    for most, unit in ((1, 8), (4, 8), (5, 16)):
        got = {}
        for r in blocks.aligned_ranges(sizes, most, unit).orderBy("text_id", "block_id").collect():
            got.setdefault(r["text_id"], []).append((r["beg"], r["end"]))
        for i, n in enumerate([1, 7, 16, 17, 63, 64, 65, 100, 1000]):
            parts = got[i]
            assert parts[0][0] == 0 and parts[-1][1] == n and len(parts) <= most
            assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            sizes_ = [b - a for a, b in parts]
            assert len(set(sizes_[1:])) <= 1 and sizes_[0] <= sizes_[-1] and (sizes_[-1] == n or sizes_[-1] % unit == 0)
    one = spark.createDataFrame([(0, 0, 0, 4, 9), (0, 1, 4, 8, 9), (0, 2, 8, 9, 9), (1, 0, 0, 1, 5)], "text_id bigint, block_id int, beg bigint, end bigint, n bigint")
    assert [r["mid"] for r in blocks.half_ranges(one, 30).orderBy("text_id", "block_id").collect()] == [2, 6, 9, 1]


def test_bits_saved_and_loaded(spark):
    rnd = random.Random(1)
    rows_ = [(t, i, rnd.random() < 0.5) for t, n in ((0, 1), (1, 8), (2, 100)) for i in range(n)]
    bits = spark.createDataFrame(rows_, "text_id bigint, i bigint, bit boolean")
    for size in (8, 24, 1 << 20):
        assert rows(blocks.unpacked_bits(blocks.packed_bits(bits, size), size), "text_id", "i", "bit") == sorted(rows_)
    changes = spark.createDataFrame([(2, 5, "set"), (2, 6, "reset"), (2, 7, "flip"), (9, 1, "set")], "text_id bigint, i bigint, change string")
    want = [(t, i, {5: True, 6: False, 7: not b}.get(i, b) if t == 2 else b) for t, i, b in rows_]
    assert rows(blocks.edited_bits(bits, changes), "text_id", "i", "bit") == sorted(want)


def test_suffixes_are_sorted_once(texts):
    """Operators that use the table of suffixes several times write it first."""
    for df in (bwt.lf_mapping(sa.suffixes(texts)), merging.merge_halves(sa.suffixes(texts)), merging.merge_parts(sa.suffixes(texts), 4), merging.merge_transforms(sa.suffixes(texts))):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from suffloom.operators.shared import shared_dir

    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_texts_without_long_repeats_are_ranked_without_rounds(texts, suf, monkeypatch):
    taken, doubled = [], sa._doubled
    monkeypatch.setattr(sa, "_doubled", lambda rows, *a: taken.append({r["text_id"] for r in rows.select("text_id").collect()}) or doubled(rows, *a))
    repeats = {i for i, t in enumerate(TEXTS) if len({t[p : p + 7] for p in range(len(t))}) < len(t)}
    plain = texts.where(~F.col("text_id").isin(list(repeats)))
    assert 5 < plain.count() and rows(sa.suffixes(plain, "doubling"), *suf.columns) == rows(suf.where(~F.col("text_id").isin(list(repeats))), *suf.columns)
    assert taken == []
    monkeypatch.setattr(sa, "KERNEL_LIMIT", 20)  # some are too long for a task
    assert rows(sa.suffixes(texts, "doubling"), *suf.columns) == rows(suf, *suf.columns)
    long = {i for i, t in enumerate(TEXTS) if len(t) > 20}
    assert taken == [repeats - long, long] and repeats - long


def test_order_faults_of_texts(texts, monkeypatch):
    want = sorted((i, len(t), len(t) * (len(t) - 1) // 2, 0) for i, t in enumerate(TEXTS) if t)
    columns = ["text_id", "n", "positions", "faults"]
    got = sa.order_faults_of_texts(texts)
    assert rows(got, *columns) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    monkeypatch.setattr(sa, "KERNEL_LIMIT", 20)
    assert rows(sa.order_faults_of_texts(texts), *columns) == want


def test_wrong_orders_are_found():
    """All orders of some short texts, a right one among others that repeat positions too."""
    for t in (b"aba", b"abab", b"aaa", b"\xff\0\xff"):
        for order in itertools.product(range(len(t)), repeat=len(t)):
            two = [b"ba", b"", t]
            flat = np.array([1, 0, *order])
            got = sa.order_checked(np.arange(3), np.frombuffer(b"".join(two), np.uint8), np.array([2, 0, len(t)]), flat).to_pydict()
            assert got["text_id"] == [0, 2] and got["n"] == [2, len(t)] and got["positions"] == [1, sum(order)]
            assert got["faults"][0] == 0 and (got["faults"][1] == 0) == (list(order) == naive(t))


def test_texts_are_inverted_together(suf, monkeypatch):
    last = suf.where(F.col("pos") == F.col("n") - 1).select("text_id", F.col("sym").alias("last"))
    by_text = bwt.inverse_bwt(bwt.bwt(suf), bwt.primary_index(suf).where("text_id <> 3"), last.where("text_id <> 4"))
    assert {r["text_id"]: bytes(r["bytes"]) for r in by_text.collect()} == {i: t for i, t in enumerate(TEXTS) if t and i not in (3, 4)}
    plan = by_text._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "FlatMapGroups" not in plan
    made = []
    for i, t in enumerate(TEXTS):
        order = naive(t)
        if t:
            made += [(i, -2, order.index(0)), (i, -1, t[-1]), *((i, r, t[p - 1] if p else 0) for r, p in enumerate(order))]
    for run, side, size in ((1, 1, 1), (7, 5, 3), (40, 1000, 16), (1000, 8, 50)):
        monkeypatch.setattr(bwt, "_RUN", run)
        monkeypatch.setattr(kernel, "_SIDE_BY_SIDE", side)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("text_id", "rank", "value"), x)) for x in made[k : k + size]]) for k in range(0, len(made), size)]
        got = [(r["text_id"], r["bytes"]) for b in bwt._inverted(batches) for r in b.to_pylist()]
        assert got == [(i, t) for i, t in enumerate(TEXTS) if t]


def test_texts_are_spread_by_their_bytes(spark, texts, monkeypatch):
    """However many bytes there are, no task gets much more than its part of them."""
    df = spark.createDataFrame([(i, bytearray(b"ab" * 500)) for i in range(400)], "text_id bigint, bytes binary").coalesce(1)
    monkeypatch.setattr(sa, "_SPREAD", 10_000)
    for total in (None, 40 << 30):
        if total:
            monkeypatch.setattr(sa, "_SPREAD", total // 40)
        got = sa.spread(df, total)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.rdd.getNumPartitions() == 40 and sum(sizes) == 400 and max(sizes) < 40
    monkeypatch.undo()
    assert rows(sa.spread(texts), "text_id") == rows(texts, "text_id")
