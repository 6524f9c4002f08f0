"""Cleaning, imputation and constant fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.order_stats import medians

UNKNOWN_EMPLOYMENT = 365243
MEDIAN_COLUMNS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED"]
NOT_FEATURES = ["SK_ID_CURR", "TARGET"]

# Features that are 0 for a customer without that history.
ZERO_FILL = [
    "BUREAU_LOAN_COUNT",
    "BUREAU_ACTIVE_COUNT",
    "PREV_APP_COUNT",
    "PREV_REFUSED_COUNT",
    "PREV_REFUSED_RATIO",
    "POS_COUNT",
    "POS_DPD_RATIO",
    "CC_COUNT",
    "CC_OVER_LIMIT_RATIO",
    "LATE_PAYMENT_RATIO",
    "UNDERPAID_RATIO",
    "RECENT_LATE_RATIO",
    "BUREAU_RECENCY_WEIGHTED_OVERDUE",
    "BUREAU_DEBT_DAYS_SLOPE",
    "BUREAU_ACTIVE_CLOSED_RATIO",
    "INST_LATE_RATIO_3M",
    "INST_LATE_RATIO_6M",
    "INST_LATE_RATIO_12M",
    "INST_PAY_RATIO_SLOPE",
    "INST_DELAY_SLOPE",
    "POS_DPD_SLOPE",
    "POS_COMPLETION_RATE_DIFF",
    "CC_UTILIZATION_TREND_6M",
    "CC_DRAWINGS_DIFF_6M",
    "PREV_REFUSED_RATIO_RECENT3",
]
NEVER_REFUSED_DAYS = 99999


def flag_unknown_employment(app: DataFrame) -> DataFrame:
    """Turn the employment sentinel into a flag and a missing value."""
    unknown = F.col("DAYS_EMPLOYED") == UNKNOWN_EMPLOYMENT
    return app.withColumns(
        {
            "DAYS_EMPLOYED_ANOM": F.when(unknown, 1).otherwise(0),
            "DAYS_EMPLOYED": F.nullif(F.col("DAYS_EMPLOYED"), F.lit(UNKNOWN_EMPLOYMENT)),
        }
    )


def impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Replace missing values by the given constants."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items() if v is not None}
    )


def clean_application(app: DataFrame, columns: Sequence[str] = tuple(MEDIAN_COLUMNS)) -> DataFrame:
    """Sentinel handling, then exact medians for the main money columns."""
    flagged = flag_unknown_employment(app)
    return impute(flagged, medians(flagged, [c for c in columns if c in app.columns]))


def fill_constants(df: DataFrame) -> DataFrame:
    """Zeros for absent history; a large day count for 'never refused'."""
    fills = {c: 0 for c in ZERO_FILL if c in df.columns}
    if "PREV_DAYS_SINCE_LAST_REFUSED" in df.columns:
        fills["PREV_DAYS_SINCE_LAST_REFUSED"] = NEVER_REFUSED_DAYS
    return df.na.fill(fills)


def candidate_columns(df: DataFrame, exclude: Sequence[str] = tuple(NOT_FEATURES)) -> list[str]:
    """Numeric columns except the key and the target."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def drop_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop those of ``columns`` that hold no value at all."""
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if seen[c] == 0])


def drop_empty_and_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop all-missing candidates and fill the others with their medians."""
    middle = medians(df, columns)
    return impute(df.drop(*[c for c in columns if middle[c] is None]), middle)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse becomes missing."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
