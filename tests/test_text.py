"""Texts must read exactly as the formatting of the exact binary value."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.functions import risk
from creditloom.functions.catalog import description, display_name
from creditloom.functions.text import factor_line, half_even, narration, value_text

FACTOR = "array<struct<feature string, display_name string, shap_value double, feature_value double>>"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=50, max_size=200))
def test_half_even_is_exact(spark, values):
    values = [*values, 0.145, 0.155, 2.5, -0.5, 0.125, -0.001, 1.005, 12.25]
    for digits in (0, 1, 2, 4):
        df = spark.createDataFrame([(v,) for v in values], "x double").select(half_even(F.col("x"), digits).alias("r"))
        assert [r["r"] for r in df.collect()] == pytest.approx([round(v, digits) for v in values], abs=0)


@pytest.mark.parametrize(
    ("feature", "value", "text"),
    [
        ("CREDIT_INCOME_RATIO", 0.145, "14.5%"),
        ("DURATION", 0.5, "50.0%"),
        ("DAYS_EMPLOYED", -1234.0, "1234 days of employment"),
        ("DAYS_EMPLOYED", 365243.0, "unemployed"),
        ("AMT_CREDIT", 1234567.891, "$1,234,567.89"),
        ("EXT_SOURCE_2", 0.145, "0.14"),
        ("EXT_SOURCE_2", None, "N/A"),
    ],
)
def test_value_text(spark, feature, value, text):
    df = spark.createDataFrame([(feature, value)], "f string, v double")
    assert df.select(value_text(F.col("f"), F.col("v"))).first()[0] == text


def test_factor_line(spark):
    schema = "feature string, display_name string, shap_value double, feature_value double"
    df = spark.createDataFrame([("AMT_CREDIT", "Total Credit Amount", -0.12345, 10.0)], schema)
    line = df.select(factor_line(F.struct("*"))).first()[0]
    assert line == f"- Total Credit Amount = $10.00 (decreases risk by {0.12345:.4f})"


def story(spark, p, factors):
    rows = [(p, [(f, display_name(f), s, 1.0) for f, s in factors])]
    return spark.createDataFrame(rows, f"p double, e {FACTOR}").select(narration(F.col("p"), F.col("e"))).first()[0]


def test_narration_merges_scores(spark):
    text = story(spark, 0.2512, [("EXT_SOURCE_3", 0.4), ("CREDIT_TERM", -0.3), ("EXT_SOURCE_2", 0.2), ("AMT_CREDIT", 9.0)])
    assert text == (
        "This applicant has a 25.1% predicted default probability, placing them in the High Risk category."
        " The primary drivers are low Credit Bureau Scores A and B, and a low Credit Term Duration."
    )


def test_narration_of_three_scores(spark):
    text = story(spark, 0.1, [("EXT_SOURCE_1", -0.4), ("EXT_SOURCE_2", -0.3), ("EXT_SOURCE_3", 0.2)])
    assert text.endswith("in the Moderate Risk category. The primary driver is high Credit Bureau Scores A, B and C.")


def test_narration_prefixes(spark):
    text = story(spark, 0.0999, [("DAYS_EMPLOYED", 0.4), ("NAME_FAMILY_STATUS_Married", -0.3), ("EXT_SOURCE_1", 0.2)])
    assert text.endswith(
        "in the Low Risk category. The primary drivers are low Credit Bureau Score C, a short Employment Duration,"
        " and a favorable Family Status: Married."
    )
    assert story(spark, 0.5, []).endswith("There are no significant risk factors identified.")


def test_bands_and_decisions(spark):
    df = spark.createDataFrame([(0.0999,), (0.10,), (0.25,)], "p double")
    assert [r[0] for r in df.select(risk.risk_band(F.col("p"))).collect()] == ["low", "medium", "high"]
    df = spark.createDataFrame([(0.1499,), (0.15,)], "p double")
    assert [tuple(r) for r in df.select(risk.decision(F.col("p")), risk.prediction(F.col("p"))).collect()] == [
        ("Approved", 0),
        ("Rejected", 1),
    ]


def test_employment_years_and_status(spark):
    df = spark.createDataFrame([(-3653, 0), (365243, 1), (None, None)], "d int, t int")
    got = df.select(risk.years_employed(F.col("d")), risk.repayment_status(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(10.0, "Paid"), (0.0, "Defaulted"), (None, "Unknown")]


def test_dictionary_fallback():
    assert display_name("EXT_SOURCE_2") == "Credit Bureau Score A"
    assert display_name("DAYS_ID_PUBLISH") == "Days Id Publish"
    assert description("DAYS_ID_PUBLISH") == "SHAP explanation factor for Days Id Publish."
