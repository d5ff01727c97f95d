from pathlib import Path

import duckdb
import pytest

from suffloom.plans import catalog


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, data, sql, name):
    df = catalog.QUERIES[name](spark, data)
    got = df.toPandas()
    want = sql.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count()


def test_documents_brute_force(spark, data):
    """Whole texts, but only the short ones are compared: sorting suffixes as strings takes quadratic time."""
    texts = {r["text_id"]: bytes(r["bytes"]) for r in catalog.document_texts(spark, data).collect()}
    got = {}
    for r in catalog.sa_documents(spark, data).collect():
        got.setdefault(r["text_id"], {})[r["rank"]] = r["pos"]
    assert got.keys() == {k for k, t in texts.items() if t}
    for k, t in texts.items():
        assert sorted(got[k].values()) == list(range(len(t)))
        if len(t) < 1500:
            assert [got[k][r] for r in range(len(t))] == sorted(range(len(t)), key=lambda i: t[i:])


GROWING = ["bit_edits", "gap_prefix_search", "pattern_range_rows", "gt_begin", "gt_end", "half_blocks", "lf_mapping", "inverse_bwt", "merge_two_way", "merge_bwt", "rename_roundtrip", "vbyte_roundtrip", "gap_chunk_sums"]


@pytest.mark.parametrize("name", GROWING)
def test_tables_of_suffixes_are_not_broadcast(spark, data, name):
    """Spark takes them for as small as the texts they come from; all of them would pass through the driver."""
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", ["sa_documents_order", "sa_pages_order"])
def test_orders_are_checked_without_rows_of_suffixes(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan
