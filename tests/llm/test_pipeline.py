import pytest

import corpus_pipeline as cp
from suffloom.llm.common import written
from suffloom.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, data), f"test-{name}")
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
            assert out.join(docs, columns, "left_anti").isEmpty()
            assert 0 < out.count() <= docs.count()
            docs = out
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == kept
    assert cp.run(spark, data).count() == out.count()


def test_stages_take_odd_rows(spark, data, documents, clashing, empty):
    for df in (documents, clashing.withColumnRenamed("kept", "is kept"), empty):
        docs = df
        for _, stage in cp.STAGES[:-1]:
            docs = written(stage(spark, docs, data), "odd")
            assert docs.columns == df.columns
        pieces = written(cp.STAGES[-1][1](spark, docs, data), "odd")
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_language_stage_drops_wordless_texts(spark, data, documents):
    kept = {r["doc_id"] for r in cp.language(spark, documents, data).collect()}
    assert not {82, 83, 84, 85} & kept
    assert set(range(70)) <= kept


@pytest.mark.parametrize("number", range(1, 11))
def test_each_operator_has_a_query(spark, data, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    df = QUERIES[name](spark, data)
    table = "pages" if number in (9, 10) else "documents"
    n = spark.read.parquet(f"{data}/{table}.parquet").count()
    if number == 5:
        assert df.count() > 0
    elif number == 7:
        assert df.select("doc_id").distinct().count() == n
    else:
        assert df.count() == n
    assert set(ORACLE_SQL) <= set(QUERIES)
