"""Curves, thresholds, audit statistics and search rules."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from creditloom.operators import audit, evaluate, explore
from creditloom.sources.views import view


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "p double, y int")


def test_auc_with_ties(spark):
    assert evaluate.roc_auc(scored(spark, [(0.2, 0), (0.2, 1), (0.8, 0), (0.8, 1)])).first()[0] == 0.5


def test_auc_without_one_class(spark):
    assert evaluate.roc_auc(scored(spark, [(0.2, 1), (0.3, 1)])).first()[0] is None


def test_auc_matches_exact_evaluator_and_is_monotone_invariant(spark, sf001):
    df = view(spark, sf001, "scored").withColumn("y", F.when(F.rand(3) < F.col("p"), 1).otherwise(0))
    ours = evaluate.roc_auc(df).first()[0]
    exact = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert 0 <= ours <= 1 and ours == pytest.approx(exact, abs=1e-12)
    squared = evaluate.roc_auc(df.withColumn("p", F.col("p") * F.col("p"))).first()[0]
    assert squared == pytest.approx(ours, abs=1e-12)


def test_curve_against_brute_force(spark):
    rng = np.random.default_rng(1)
    p, y = rng.integers(0, 40, 500) / 40, rng.integers(0, 2, 500)
    df = scored(spark, [(float(a), int(b)) for a, b in zip(p, y, strict=True)])
    got = {round(r["threshold"], 6): (r["fpr"], r["tpr"]) for r in evaluate.roc_points(df).collect() if 0 < r["threshold"] < 1}
    for t, (fpr, tpr) in got.items():
        hit = p >= t - 1e-9
        assert fpr == pytest.approx((hit & (y == 0)).sum() / (y == 0).sum())
        assert tpr == pytest.approx((hit & (y == 1)).sum() / (y == 1).sum())
    for row in evaluate.threshold_sweep(df).collect():
        hit = p >= row["threshold"]
        tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
        assert row["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0)


def test_sweep_on_threshold_values(spark):
    """Scores that are thresholds themselves count as reached."""
    df = scored(spark, [(k / 100, 1) for k in range(0, 101)])
    for row in evaluate.threshold_sweep(df).collect():
        k = round(row["threshold"] * 100)
        assert row["recall"] == pytest.approx((101 - k) / 101)


def test_bins(spark):
    df = scored(spark, [(0.1, 0), (0.100001, 0), (1.0, 0)]).select(evaluate.calibration_bin(F.col("p")).alias("b"))
    assert [r["b"] for r in df.collect()] == [0, 1, 9]


def test_empty_confusion_is_zero(spark):
    row = evaluate.confusion(scored(spark, []), 0.15).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 0)


def test_empty_decisions_are_zero(spark):
    decisions = spark.createDataFrame([], "prediction_id long, decision string")
    predictions = spark.createDataFrame([], "id long, applicant_id long, predicted_probability double, ts timestamp")
    assert tuple(audit.decision_stats(decisions, predictions).first()) == (0, 0, 0, 0, 0, 0.0)


def log(spark):
    predictions = spark.createDataFrame(
        [(1, 10, 0.2, "2024-01-01 00:00:00"), (2, 10, 0.05, "2024-01-02 00:00:00"), (3, 11, 0.3, "2024-01-03 00:00:00")],
        "id long, applicant_id long, predicted_probability double, ts string",
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    decisions = spark.createDataFrame(
        [
            (1, 5, "APPROVED", "", "2024-01-05 00:00:00"),
            (2, 9, "declined", None, "2024-01-06 00:00:00"),
            (1, 5, "what", "n", "2024-01-07 00:00:00"),
        ],
        "prediction_id long, officer_id long, decision string, notes string, ts string",
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    return predictions, decisions, spark.createDataFrame([(5, "ann", "x")], "id long, username string, role string")


def test_overrides_and_unknown_decisions(spark):
    predictions, decisions, _ = log(spark)
    row = audit.decision_stats(decisions, predictions).first()
    assert (row["total_decisions"], row["approved_count"], row["declined_count"], row["escalated_count"]) == (3, 1, 1, 0)
    assert row["overrides_count"] == 2 and row["override_rate"] == pytest.approx(2 / 3)


def test_history_keeps_open_predictions_and_fills(spark):
    predictions, decisions, users = log(spark)
    rows = audit.applicant_history(predictions, decisions, users, defaults=True).collect()
    assert len(rows) == 4
    open_case = [r for r in rows if r["prediction_id"] == 3][0]
    assert (open_case["decision"], open_case["notes"], open_case["officer_name"]) == ("Awaiting decision", "", "")
    one = audit.applicant_history(predictions, decisions, users, applicant_id=10).collect()
    assert [r["prediction_id"] for r in one] == [2, 1, 1]
    assert one[0]["officer_name"] is None


def test_latest_history_row_is_the_decision_just_written(spark):
    predictions, decisions, users = log(spark)
    day = "2024-02-01 00:00:00"
    new = spark.createDataFrame(
        [(3, 5, "approved", "ok", day), (99, 5, "approved", "", day)],
        "prediction_id long, officer_id long, decision string, notes string, ts string",
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    accepted, rejected = audit.accept_decisions(new, predictions)
    assert (accepted.count(), rejected.count()) == (1, 1)
    grown = decisions.unionByName(accepted)
    assert grown.count() == decisions.count() + 1
    assert audit.applicant_history(predictions, grown, users, applicant_id=11).first()["decision"] == "approved"


def test_pending_uses_default_name(spark):
    predictions, decisions, _ = log(spark)
    cohort = spark.createDataFrame(
        [(10, 0, 0.2), (11, 1, 0.3), (12, 0, 0.1)], "applicant_id long, target int, probability double"
    )
    names = spark.createDataFrame([(11, "Eve")], "SK_ID_CURR long, name string")
    got = audit.pending_cases(cohort, predictions, decisions, names).orderBy("applicant_id").collect()
    assert [(r["applicant_id"], r["name"], r["risk_classification"], r["risk_group"]) for r in got] == [
        (11, "Eve", "High Risk", "High Risk"),
        (12, "Unknown Applicant", "Moderate Risk", "Safe"),
    ]


def test_search_wildcards(spark):
    df = spark.createDataFrame([(1, "a_b", 0), (2, "axb", 0), (31, "ZED", 1)], "SK_ID_CURR long, name string, TARGET int")
    ids = lambda text, mode="parity": [r[0] for r in audit.search_applicants(df, text, mode=mode).collect()]
    assert ids("a_b") == [1, 2] and ids("a_b", "safe") == [1]
    assert ids("3") == [31] and ids("zed") == [31]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 5.0), (1.0, 4.0, None)], "a double, b double, c double")
    got = {r["feature"]: r["corr"] for r in explore.correlations_with(df, ["a", "b", "c"], "b").collect()}
    assert got["a"] is None and got["c"] is None and got["b"] == pytest.approx(1)


def test_crossing_feature_is_left_out(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 1.0)], "feature string, importance double")
    got = {r["feature"]: r["selected"] for r in explore.cumulative_importance(df, 0.85).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_histogram_of_equal_values(spark):
    rows = explore.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) == 4
