"""Row-wise features computed from the joined customer row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.nulls import EPS

EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

# numerator, denominator, feature name
SMALL_TERM_RATIOS = [
    ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS", "INCOME_PER_PERSON"),
    ("CNT_CHILDREN", "CNT_FAM_MEMBERS", "CHILDREN_RATIO"),
    ("DAYS_EMPLOYED", "DAYS_BIRTH", "DAYS_EMPLOYED_PERCENT"),
    ("AMT_INCOME_TOTAL", "AMT_CREDIT", "INCOME_CREDIT_PERC"),
    ("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH", "DAYS_LAST_PHONE_CHANGE_BIRTH_RATIO"),
    ("DAYS_REGISTRATION", "DAYS_BIRTH", "DAYS_REGISTRATION_BIRTH_RATIO"),
    ("OWN_CAR_AGE", "DAYS_BIRTH", "CAR_TO_BIRTH_RATIO"),
    ("OWN_CAR_AGE", "DAYS_EMPLOYED", "CAR_TO_EMPLOYED_RATIO"),
]
PLUS_ONE_RATIOS = [
    ("AMT_CREDIT", "AMT_INCOME_TOTAL", "CREDIT_INCOME_RATIO"),
    ("AMT_ANNUITY", "AMT_INCOME_TOTAL", "ANNUITY_INCOME_RATIO"),
    ("AMT_CREDIT", "AMT_ANNUITY", "CREDIT_TERM"),
]


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _product(names: list[str]) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(F.col(c), F.lit(1.0)) for c in names])


def external_score_features(df: DataFrame) -> DataFrame:
    """Mean, spread, range and products of the external scores that are present."""
    scores = [F.col(c) for c in EXT_SOURCES]
    n = _total([F.col(c).isNotNull().cast("int") for c in EXT_SOURCES])
    mean = F.when(n > 0, _total([F.coalesce(c, F.lit(0.0)) for c in scores]) / n)
    squares = _total([F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in scores])
    one, two, three = EXT_SOURCES
    return df.withColumns(
        {
            "EXT_SOURCE_MEAN": mean,
            "EXT_SOURCE_STD": F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0),
            "EXT_SOURCE_MIN": F.least(*scores),
            "EXT_SOURCE_MAX": F.greatest(*scores),
            "EXT_SOURCE_PROD": _product(EXT_SOURCES),
            "EXT_SOURCE_1_2_MULT": _product([one, two]),
            "EXT_SOURCE_2_3_MULT": _product([two, three]),
            "EXT_SOURCE_1_3_MULT": _product([one, three]),
        }
    )


def ratio_features(df: DataFrame) -> DataFrame:
    """Money, family, age and car ratios of the application row."""
    made = {
        name: F.try_divide(F.col(a), F.col(b) + F.lit(EPS)) for a, b, name in SMALL_TERM_RATIOS
    } | {name: F.try_divide(F.col(a), F.col(b) + 1) for a, b, name in PLUS_ONE_RATIOS}
    made["AGE_YEARS"] = -F.col("DAYS_BIRTH") / F.lit(365.0)
    return df.withColumns(made)
