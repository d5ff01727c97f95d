import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from suffloom.llm import common, packing, token_counts
from suffloom.llm.common import vocabulary_path
from suffloom.llm.packing import _inverse, cutting_stock, deals, pack
from suffloom.llm.token_counts import UnitTable, count_tokens, safe_pieces
from tests.llm.conftest import plain

PATH = vocabulary_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "é", "1", "'s", "'", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\u3000", "!", ".", "<|endoftext|>", "the ", "\0", "\x01", "\x1c", "日", "word,", "\r\n", "don't"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def strings(n=4000):
    rnd = random.Random(2)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def counted(known, texts):
    return [(n, x.tolist()) for n, x in known.texts(pa.array(texts, pa.string()))]


@pytest.mark.parametrize("batch", [1, 100])
def test_units_give_the_library_s_tokens(batch):
    texts = [*strings(), None, "", " ", "\n", "a ", " a", "\na", "a\n", "word's,\nnext&&& ''s", "x<|endoftext|>,", "<|endoftext|", "日本, ª. ǅ!"]
    known = {kind: UnitTable(PATH, kind == "lengths", most=2000) for kind in ("ids", "lengths")}
    for k in range(0, len(texts), batch):
        some = texts[k : k + batch]
        for t, (n, got), (m, _) in zip(some, counted(known["ids"], some), counted(known["lengths"], some), strict=True):
            want = ids(t or "")
            assert (got, n, m) == (want, len(want), len(want)), repr(t)


def test_many_words_in_a_string():
    rnd = random.Random(8)
    letters = "abcdeéßñ日本ªʰǅ"
    words = list({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(3000)})
    texts = ["x " + " ".join(words), "x\n" + "\n".join(words), "x " + " ".join(w + "&.," for w in words)]
    for lengths in (False, True):
        for t, (n, got) in zip(texts, counted(UnitTable(PATH, lengths), texts), strict=True):
            assert n == len(ids(t)) and (lengths or got == ids(t))


def test_safe_pieces():
    for t in strings(500):
        parts = list(safe_pieces(t, 3))
        assert "".join(parts) == t
        assert sum((ids(p) for p in parts), []) == ids(t)


def test_long_texts_and_full_tables(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 50)
    monkeypatch.setattr(token_counts, "LONG_UNIT", 5)
    texts = strings(800)
    for lengths in (True, False):
        known = UnitTable(PATH, lengths, most=20)
        for k in range(0, 800, 8):
            for t, (n, got) in zip(texts[k : k + 8], counted(known, texts[k : k + 8]), strict=True):
                assert n == len(ids(t)) and (lengths or got == ids(t))
        assert len(known.known) < 200


def test_counts(documents, rows, clashing, empty):
    got = {r["doc_id"]: r for r in count_tokens(documents, PATH).collect()}
    for i, t, _ in rows:
        n = len(ids(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert count_tokens(documents, PATH).count() == len(rows)
    assert count_tokens(empty, PATH).count() == 0
    cols = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert plain(count_tokens(clashing, PATH), *cols) == plain(count_tokens(documents, PATH), *cols)


def check_pieces(pieces, texts, capacity):
    """Offsets without gaps, each document's ids once, checksums; returns the lengths of the sequences."""
    by_sequence = pieces.sort_values(["sequence_id", "offset"])
    assert (by_sequence.groupby("sequence_id").length.cumsum() - by_sequence.length == by_sequence.offset).all()
    used = by_sequence.groupby("sequence_id").length.sum()
    assert used.max() <= capacity and pieces.length.min() > 0
    assert sorted(used.index) == list(range(len(used)))
    arrays = {i: np.array([*ids(t or ""), 1], "<u4") for i, t in texts}
    want, got = {}, {}
    for i, _ in texts:
        want[i] = want.get(i, 0) + len(arrays[i])
    covered = {i: np.zeros(len(x), int) for i, x in arrays.items()}
    for p in pieces.itertuples():
        x = arrays[p.doc_id]
        assert p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        covered[p.doc_id][p.start : p.start + p.length] += 1
    assert got == want and all(x.min() == x.max() for x in covered.values())
    return used


def padding(used, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in used)


@pytest.mark.parametrize("capacity", [128, 2048])
@pytest.mark.parametrize("spare", [1, 16])
def test_packing(documents, rows, capacity, spare):
    pieces = pack(documents, PATH, capacity=capacity, grain=capacity // 64, spare=spare).toPandas()
    used = check_pieces(pieces, [(i, t) for i, t, _ in rows], capacity)
    assert padding(used, capacity) <= (0 if spare == 1 else 0.05 * used.sum())
    least = -(-used.sum() // capacity)
    assert len(used) <= least + 12 + 0.12 * least


def test_packing_without_full_pieces(spark):
    """Nothing to close gaps with: padding is next to the least that patterns of whole documents can have."""
    texts = [(i, " ".join(["a"] * (n - 1))) for i, n in enumerate([30, 31, 33, 63, 40, 24, 17, 47, 9, 55, 16, 8])]
    pieces = pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, capacity=64, grain=1).toPandas()
    used = check_pieces(pieces, texts, 64)
    assert set(pieces.start) == {0}
    # By brute force: all ways to share documents out.
    sizes = [len(ids(t)) + 1 for _, t in texts]

    def best(i, rooms):
        if i == len(sizes):
            return padding([64 - r for r in rooms], 64)
        tried = {r for r in rooms if r >= sizes[i]}
        found = [best(i + 1, [*(x for j, x in enumerate(rooms) if j != rooms.index(r)), r - sizes[i]]) for r in tried]
        return min([*found, best(i + 1, [*rooms, 64 - sizes[i]])] if len(rooms) < 7 else found, default=10**9)

    assert padding(used, 64) <= best(0, []) + 64


def test_packing_edges(spark, empty, clashing, documents):
    assert pack(empty, PATH).count() == 0
    cols = ("doc_id", "start", "length", "ids_crc32")
    assert plain(pack(clashing, PATH), *cols) == plain(pack(documents, PATH), *cols)
    assert plain(pack(spark.createDataFrame([(1, None), (1, ""), (None, "a")], "doc_id long, text string"), PATH), "doc_id", "length") == [(1, 1), (1, 1), (None, 2)]


def test_idle_workers_keep_small_tables(spark, monkeypatch):
    """What workers keep after a task adds up beside the executor's heap. Tokens stay the library's."""
    runs, docs = [], spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(packing, "written", lambda df, name: 1 / 0)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(common, "_KEPT", {})
    with pytest.raises(ZeroDivisionError):
        pack(docs, PATH)
    texts = [" ".join(f"w{i * 700 + j}" for j in range(700)) for i in range(100)]
    batch = pa.record_batch({"doc_id": pa.array(range(100)), "text": pa.array(texts)})
    want = [len(ids(t)) + 1 for t in texts]
    for _ in range(2):
        out = pa.Table.from_batches(runs[0](iter([batch]))).to_pydict()
        assert [n for n, start in zip(out["doc_tokens"], out["start"], strict=True) if start == 0] == want
        (known,) = common._KEPT.values()
        assert known.count == len(known.known) <= 50_000
        assert len(known.lens) + len(known.begin) + len(known.flat) <= 2 * known.count + known.used


def test_closing_gaps_starts_no_further_workers(documents, rows, monkeypatch):
    """Rows from the driver's Python have workers of their own in each executor."""
    monkeypatch.setattr(type(documents.sparkSession), "createDataFrame", lambda *a, **b: 1 / 0)
    used = check_pieces(pack(documents, PATH, capacity=128, grain=2, spare=1).toPandas(), [(i, t) for i, t, _ in rows], 128)
    assert padding(used, 128) == 0


def test_cutting_stock_is_near_the_bound():
    rnd = np.random.default_rng(4)
    for capacity, n in ((20, 60), (64, 3000), (256, 20000)):
        sizes = np.clip(rnd.lognormal(np.log(capacity / 4), 0.8, n).astype(int), 1, capacity)
        demand = {int(s): int(c) for s, c in zip(*np.unique(sizes, return_counts=True))}
        patterns = cutting_stock(demand, capacity, {capacity // 2: 0.502})
        held = {}
        for p, k in patterns:
            assert sum(s * c for s, c in p.items()) <= capacity and k > 0
            for s, c in p.items():
                held[s] = held.get(s, 0) + c * k
        assert held == demand
        bound = max(sum(s * c for s, c in demand.items()) / capacity, sum(c for s, c in demand.items() if 2 * s > capacity))
        cost = sum(k * (0.502 if sum(s * c for s, c in p.items()) <= capacity // 2 else 1) for p, k in patterns)
        assert cost <= bound * 1.02 + 5


def test_cutting_stock_small_by_brute_force():
    # Three halves and four quarters fit three sequences; seven thirds fit three.
    assert sum(k for _, k in cutting_stock({6: 3, 3: 4}, 12)) == 3
    assert sum(k for _, k in cutting_stock({4: 7}, 12)) == 3
    assert cutting_stock({}, 12) == []


def test_deals_cover_all_ranks():
    patterns = [({3: 2, 5: 1}, 4), ({3: 1}, 2)]
    d = deals(patterns)
    assert d[3].begin.tolist() == [0, 8] and d[3].first.tolist() == [0, 4] and d[5].first.tolist() == [0]


def test_inverse():
    a = np.random.default_rng(0).random((20, 20))
    assert np.allclose(_inverse(a) @ a, np.eye(20))
