"""Features of the previous applications, one row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.nulls import count_where, flag, mean_seen, ratio, rows

LAST_APPLICATIONS = 3


def previous_features(previous: DataFrame) -> DataFrame:
    """Counts, refusals and credit-to-application ratio of earlier applications."""
    asked, credit, day = F.col("AMT_APPLICATION"), F.col("AMT_CREDIT"), F.col("DAYS_DECISION")
    refused = F.col("NAME_CONTRACT_STATUS") == "Refused"
    per_customer = previous.groupBy("SK_ID_CURR").agg(
        rows().alias("PREV_APP_COUNT"),
        mean_seen(credit).alias("PREV_AVG_CREDIT"),
        count_where(refused).alias("PREV_REFUSED_COUNT"),
        ratio(count_where(refused), rows()).alias("PREV_REFUSED_RATIO"),
        mean_seen(F.when(asked > 0, credit / asked)).alias("PREV_CREDIT_APP_RATIO"),
        # The smallest day is the oldest decision, in spite of the feature's name.
        F.min(day).alias("PREV_MOST_RECENT_DAYS"),
        (-F.max(F.when(refused, day))).alias("PREV_DAYS_SINCE_LAST_REFUSED"),
    )
    return per_customer.join(last_refusals(previous), "SK_ID_CURR", "left")


def last_refusals(previous: DataFrame, k: int = LAST_APPLICATIONS) -> DataFrame:
    """Share of refusals among the k applications decided last."""
    newest = Window.partitionBy("SK_ID_CURR").orderBy(
        F.desc_nulls_last("DAYS_DECISION"), F.asc_nulls_last("SK_ID_PREV")
    )
    return (
        previous.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= k)
        .groupBy("SK_ID_CURR")
        .agg(F.avg(flag(F.col("NAME_CONTRACT_STATUS") == "Refused")).alias("PREV_REFUSED_RATIO_RECENT3"))
    )
