"""Features of the credit-card balance history, one row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.nulls import EPS, count_where, mean_over_rows, mean_seen, ratio, rows, sum0

RECENT_MONTHS = -6


def card_features(card: DataFrame) -> DataFrame:
    """Utilisation, drawings and payment behaviour of card accounts."""
    month = F.col("MONTHS_BALANCE").cast("long")
    balance, limit = F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL")
    minimum, drawings = F.col("AMT_INST_MIN_REGULARITY"), F.col("AMT_DRAWINGS_CURRENT")
    utilization = F.when(limit > 0, balance / limit)
    payment_share = F.when(minimum > 0, F.col("AMT_PAYMENT_CURRENT") / minimum)

    is_recent = F.col("MONTHS_BALANCE") >= RECENT_MONTHS
    recent_month = F.when(is_recent, month)
    recent_util = F.when(is_recent, utilization)
    # The months of every recent row enter the X sums, but n counts only the
    # rows that have a utilisation. That is how the feature is defined.
    n = F.count(recent_util)
    mean_x, mean_y = ratio(sum0(recent_month), n), ratio(sum0(recent_util), n)
    mean_xy = ratio(sum0(recent_month * recent_util), n)
    mean_xx = ratio(sum0(recent_month * recent_month), n)
    trend = (mean_xy - mean_x * mean_y) / (mean_xx - mean_x * mean_x + F.lit(EPS))

    return card.groupBy("SK_ID_CURR").agg(
        rows().alias("CC_COUNT"),
        F.max(utilization).alias("CC_MAX_UTILIZATION"),
        F.max("SK_DPD").alias("CC_MAX_DPD"),
        mean_seen(utilization).alias("CC_AVG_UTILIZATION"),
        mean_over_rows("SK_DPD").alias("CC_AVG_DPD"),
        mean_over_rows(drawings).alias("CC_AVG_DRAWINGS"),
        ratio(count_where(balance > limit), rows()).alias("CC_OVER_LIMIT_RATIO"),
        mean_seen(payment_share).alias("CC_PAYMENT_TO_MIN_RATIO"),
        F.when(n < 2, F.lit(0.0)).otherwise(trend).alias("CC_UTILIZATION_TREND_6M"),
        (mean_seen(F.when(is_recent, drawings)) - mean_seen(drawings)).alias("CC_DRAWINGS_DIFF_6M"),
    )
