"""Streams over several files give the batch result."""

import pytest
from pyspark.sql import functions as F

from creditloom.functions.nulls import rounded
from creditloom.operators.audit import decision_stats
from creditloom.session import scratch_path
from creditloom.sources.views import shape, table, view
from creditloom.streaming import jobs
from creditloom.streaming.tables import latest_complete, latest_update, run_to_table, table_stream


@pytest.fixture(scope="module")
def parts(spark, sf0001):
    """The event and line tables as folders of parts in time order."""
    root = scratch_path(spark, "parts")
    for name, order in (("events", "ts"), ("lineitem", "l_shipdate")):
        ordered = table(spark, sf0001, name).repartitionByRange(4, order).sortWithinPartitions(order)
        ordered.write.parquet(f"{root}/{name}.parquet")
    return root


def same(a, b):
    left, right = (sorted(map(tuple, x.select(*sorted(a.columns)).collect())) for x in (a, b))
    return left == right


def decisions_from(spark, parts, sf0001):
    tables = {"lineitem": table_stream(spark, parts, "lineitem", 1), "orders": table(spark, sf0001, "orders")}
    return shape(tables, "decisions")


def test_stream_scores_equal_batch_over_many_batches(spark, sf0001):
    from creditloom.operators.clean import MEDIAN_COLUMNS, flag_unknown_employment
    from creditloom.operators.order_stats import medians
    from creditloom.plans.explain_queries import linear_scores, scorecard, scorecard_rows

    root = scratch_path(spark, "customers")
    table(spark, sf0001, "customer").repartition(3).write.parquet(f"{root}/customer.parquet")
    middle = medians(flag_unknown_employment(view(spark, sf0001, "application_train")), MEDIAN_COLUMNS)
    source = {"customer": table_stream(spark, root, "customer", 1), "nation": table(spark, sf0001, "nation")}
    stream = jobs.score_stream(shape(source, "application_train"), scorecard(scorecard_rows(spark, sf0001)), middle)
    path = run_to_table(stream, "append", "scores")
    got = spark.read.parquet(path)
    assert got.select("epoch").distinct().count() == 3
    wanted = ["SK_ID_CURR", "probability", "decision"]
    assert same(rounded(got.select(*wanted)), linear_scores(spark, sf0001).select(*wanted))


def test_running_totals_over_many_batches(spark, parts, sf0001):
    stream = decisions_from(spark, parts, sf0001)
    predictions = view(spark, sf0001, "predictions")
    path = run_to_table(jobs.decision_stream_totals(stream, predictions), "complete", "t")
    assert spark.read.parquet(path).select("epoch").distinct().count() > 1
    assert same(latest_complete(spark, path), decision_stats(view(spark, sf0001, "decisions"), predictions))


def test_restart_continues_and_repeats_nothing(spark, parts, sf0001):
    predictions = view(spark, sf0001, "predictions")
    path, checkpoint = scratch_path(spark, "again"), scratch_path(spark, "again-checkpoint")
    for _ in range(2):
        stream = decisions_from(spark, parts, sf0001)
        run_to_table(jobs.decision_stream_totals(stream, predictions), "complete", "t", path, checkpoint)
    assert same(latest_complete(spark, path), decision_stats(view(spark, sf0001, "decisions"), predictions))


def test_officer_windows_equal_batch(spark, parts, sf0001):
    stream = decisions_from(spark, parts, sf0001)
    path = run_to_table(jobs.officer_windows(stream, late="3000 days"), "update", "w")
    got = latest_update(spark, path, ["window_start", "officer_id"])
    assert same(got, jobs.officer_windows(view(spark, sf0001, "decisions")))


def balances(events):
    dpd = F.when(F.col("event_type") == "error", F.floor(F.col("value") / 50).cast("int")).otherwise(0)
    return events.select(F.col("user_id").alias("SK_ID_CURR"), "ts", dpd.alias("SK_DPD"))


def test_warnings_equal_batch(spark, parts, sf0001):
    # The files arrive in the order they were written, so the watermark must wait for all of them.
    stream = jobs.delinquency_warnings(balances(table_stream(spark, parts, "events", 1)), late="60 days")
    path = run_to_table(stream, "update", "d")
    got = latest_update(spark, path, ["window_start", "SK_ID_CURR"])
    want = jobs.delinquency_warnings(balances(table(spark, sf0001, "events")))
    assert want.count() > 0 and same(rounded(got), rounded(want))


def test_late_rows_are_dropped(spark):
    root = scratch_path(spark, "late")
    schema = "SK_ID_CURR long, ts timestamp_ntz, SK_DPD int"
    for i, day in enumerate(("2024-03-01", "2024-06-01", "2024-03-02")):
        df = spark.createDataFrame([(1, day)], "SK_ID_CURR long, d string")
        row = df.select("SK_ID_CURR", F.to_timestamp_ntz("d").alias("ts"), F.lit(3).alias("SK_DPD"))
        row.coalesce(1).write.parquet(f"{root}/in/{i}")
    for i in range(3):  # one query run per arrival
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/[0-{i}]")
        run_to_table(jobs.delinquency_warnings(stream), "update", "l", f"{root}/out", f"{root}/checkpoint")
    got = latest_update(spark, f"{root}/out", ["window_start", "SK_ID_CURR"])
    assert got.agg(F.max("n")).first()[0] == 1
