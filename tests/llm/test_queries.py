"""Registered queries on the tables: oracles, the pipeline, and what every query must return."""

import oracle
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from creditloom.llm.queries import LLM_QUERIES


@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if q.sql])
def test_matches_oracle(spark, sf001, name):
    assert oracle.compare(LLM_QUERIES[name].build(spark, sf001), oracle.connect(sf001), LLM_QUERIES[name].sql) == []


@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if not q.sql])
def test_one_row_per_input_row_or_match(spark, sf0001, name):
    rows = LLM_QUERIES[name].build(spark, sf0001).count()
    table = {"op5": "pages", "op8": "embeddings", "op10": None, "op13": None}.get(name.split("_")[0], "documents")
    if name.startswith("op8"):
        assert rows == 25 * 20
    elif table:
        assert rows == spark.read.parquet(f"{sf0001}/{table}.parquet").count()


def test_every_number_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14)) and {*LLM_QUERIES, "pipeline"} <= set(driver.queries())


def test_pipeline_stages_by_hand(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, sf0001)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns and 0 < at.count() <= before.count()
            assert at.exceptAll(before).isEmpty()
    assert at.count() == corpus_pipeline.run(spark, sf0001).count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf0001}/benchmark.parquet").collect()]
    assert not any(item in texts[r.doc_id] for r in at.select("doc_id").collect() for item in items)
