import random

import pytest

from suffloom.operators import index
from suffloom.operators import suffix_array as sa
from suffloom.sources.chunks import read_chunks

TEXTS = [b"banana", b"mississippi" * 3, b"", b"\xff\xfe\xff\0\0\xff\xff", b"ab" * 30, b"a" * 40]
PATTERNS = [b"", b"a", b"ana", b"ississip", b"ississippimississippim", b"\xff", b"\0", b"\xff\xff\xff", b"ab" * 10, b"a" * 7, b"a" * 8, b"a" * 40, b"a" * 41, b"q", b"\xff" * 7]


def plain(text, pattern):
    return [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame([*((i, bytearray(p)) for i, p in enumerate(PATTERNS)), (99, None)], "pat_id int, pat binary")


@pytest.mark.parametrize("strategy", ["kernel", "doubling"])
def test_occurrences(spark, tmp_path, patterns, strategy):
    texts = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(TEXTS)], "text_id bigint, bytes binary")
    stored = index.write_index(index.index_of(texts, strategy), str(tmp_path / "index"))
    want = {(i, k, p) for i, t in enumerate(TEXTS) for k, x in enumerate(PATTERNS) for p in plain(t, x)}
    got = index.occurrences(stored, patterns).collect()
    assert len(got) == len(want) and {(r["text_id"], r["pat_id"], r["pos"]) for r in got} == want
    for r in got:
        order = sorted(range(len(TEXTS[r["text_id"]])), key=lambda i: TEXTS[r["text_id"]][i:])
        assert order[r["rank"]] == r["pos"]
    for r in index.runs(stored, patterns).collect():
        assert r["hi"] - r["lo"] == len(plain(TEXTS[r["text_id"]], PATTERNS[r["pat_id"]]))
    assert {r["pat_id"]: r["cnt"] for r in index.counts(stored, patterns).collect()} == {**{k: sum(len(plain(t, x)) for t in TEXTS) for k, x in enumerate(PATTERNS)}, 99: 0}


def test_a_text_that_comes_in_chunks(spark, tmp_path, patterns):
    rnd = random.Random(2)
    text = bytes(rnd.choice(b"ab\xff\0") for _ in range(600)) + b"ississippimississippim" + b"a" * 60
    (tmp_path / "file").write_bytes(text)
    stored = index.write_index(index.index_of_chunks(read_chunks(spark, str(tmp_path / "file"), 50)), str(tmp_path / "index"))
    assert stored.columns == index.COLUMNS
    got = {(r["pat_id"], r["pos"]) for r in index.occurrences(stored, patterns).collect()}
    assert got == {(k, p) for k, x in enumerate(PATTERNS) for p in plain(text, x)}


def test_keys_are_pushed_down(spark, tmp_path):
    texts = spark.createDataFrame([(0, bytearray(b"banana"))], "text_id bigint, bytes binary")
    stored = index.write_index(index.index_of(texts), str(tmp_path / "index"))
    found = index.occurrences(stored, spark.createDataFrame([(0, bytearray(b"an"))], "pat_id int, pat binary"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key," in plan and "LessThanOrEqual(key," in plan


def test_many_patterns_and_none(spark, tmp_path):
    text = bytes(random.Random(4).choice(b"abc") for _ in range(300))
    stored = index.write_index(index.index_of(spark.createDataFrame([(0, bytearray(text))], "text_id bigint, bytes binary")), str(tmp_path / "index"))
    many = sorted({text[i : i + n] for i in range(0, 290, 3) for n in (2, 9)})
    got = {r["pat_id"]: r["cnt"] for r in index.counts(stored, spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(many)], "pat_id int, pat binary")).collect()}
    assert got == {i: len(plain(text, p)) for i, p in enumerate(many)}
    assert index.occurrences(stored, spark.createDataFrame([], "pat_id int, pat binary")).count() == 0


def test_index_needs_no_rows_of_sa(spark):
    assert index.index_of(spark.createDataFrame([], "text_id bigint, bytes binary")).count() == 0
    assert sa.suffixes(spark.createDataFrame([(0, bytearray(b"ab"))], "text_id bigint, bytes binary")).columns == ["text_id", "pos", "rank", "n", "sym", "prev"]
