"""Stages and registration."""

import inspect

import pytest
from oracle_compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry_points
import corpus_pipeline
from coinbrook.llm.oracle import ORACLE_SQL


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name, sf):
    got = spark_rows(entry_points.queries()[name](spark, sf))
    want = duck_rows(duck(sf), ORACLE_SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


def test_each_stage_works_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        after = stage(spark, before, sf).cache()
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        assert after.count() <= before.count(), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        before = after
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in before.select("doc_id").collect())


def test_stages_accept_no_documents(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_every_operator_is_registered():
    names = list(entry_points.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
