"""Registered queries against their SQL, and the pipeline from end to end."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, compare
from labelwise.llm import mixing
from labelwise.llm.common import keep_table
from labelwise.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, con, sf, name):
    fn, sql = QUERIES[name]
    assert compare(spark, con, sf, name, fn, sql)[0].startswith("ok")


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = keep_table(out, name)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0
    index = corpus_pipeline.token_stage(spark, docs, sf)
    assert index.count() == counts[3]


@pytest.mark.parametrize("written", [True, False])
def test_token_files_follow_the_training_positions(spark, sf, written):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    when = {}
    for r in mixing.plan(docs).where("taken > 0").collect():
        when[r.doc_id] = list(r.positions)[::-1]
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    index = corpus_pipeline.token_stage(spark, keep_table(mixed, "mixed") if written else mixed, sf).orderBy("start").collect()
    order = [when[r.doc_id].pop() for r in index]
    assert len(order) > 50 and order == sorted(order)
    assert [r.start for r in index[1:]] == [r.start + r.n_tokens for r in index[:-1]]


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
