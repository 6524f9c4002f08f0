"""Defined cases of the pipeline's stages: nulls, empty texts, repeated rows, clashing columns, empty tables."""

import corpus_pipeline
from creditloom.llm.queries import prepared

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, `key` string, ids string, n_tokens int"


def rows_of(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 0.5, 7, "k", "mine", 3) for r in docs]
    other = lambda i, t: (i, t, "en", "s", 0, None, None, None, None, None)
    return [*rows, *rows[:3], other(10**6, None), other(10**6 + 1, ""), other(None, rows[5][1]), other(None, None), other(10**6 + 2, " \n ")]


def test_stages_keep_columns_and_take_every_case(spark, sf0001):
    rows = rows_of(prepared(spark), sf0001)
    at = spark.createDataFrame(rows, COLUMNS)
    before = at
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf0001).cache()
        assert after.columns == before.columns, name
        assert after.exceptAll(at).isEmpty(), name
        at = after
    ids = [r.doc_id for r in at.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    codes = corpus_pipeline.STAGES[-1][1](spark, before, sf0001)
    assert set(codes.columns) == {"doc_id", "lang", "source", "n_chars", "score", "node", "key", "ids", "n_tokens"}
    got = {r.doc_id: (r.ids, r.n_tokens) for r in codes.filter("doc_id >= 1000000").collect()}
    assert got[10**6] == (None, None)
    assert got[10**6 + 1][0] == [] and codes.count() == len(rows)


def test_empty_table_passes(spark, sf0001):
    at = prepared(spark).createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf0001)
        assert at.count() == 0


def test_repeated_rows_leave_one(spark, sf0001):
    rows = rows_of(prepared(spark), sf0001)[:3]
    docs = spark.createDataFrame(rows * 4, COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf0001)
    assert kept.count() == kept.select("doc_id").distinct().count() == len({r[0] for r in rows})
