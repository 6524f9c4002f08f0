"""Features of the point-of-sale balance history, one row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.nulls import count_where, flag, ratio, rows, slope, sum0

RECENT_MONTHS = -6
RECENT_CONTRACT_MONTHS = -12


def pos_features(pos: DataFrame) -> DataFrame:
    """Delinquency level, trend and completion rates of POS contracts.

    The table is read once: rows are summed up per contract, contracts per
    customer. All sums are additive, so no join brings the levels together.
    """
    contracts = contract_sums(pos)
    recent = F.col("last_month") >= RECENT_CONTRACT_MONTHS
    older = F.col("last_month") < RECENT_CONTRACT_MONTHS

    def rate(which):
        return ratio(sum0(F.when(which, F.col("completed"))), count_where(which))

    n, sx, sy, sxy, sxx = (sum0(c) for c in ("n", "sx", "sy", "sxy", "sxx"))
    level = F.when((n < 2) | (F.min("first_month") == F.max("last_month")), F.lit(0.0))
    return (
        contracts.groupBy("SK_ID_CURR")
        .agg(
            n.alias("POS_COUNT"),
            F.max("max_dpd").alias("POS_MAX_DPD"),
            F.max("max_dpd_def").alias("POS_MAX_DPD_DEF"),
            ratio(sy, n).alias("POS_AVG_DPD"),
            ratio(sum0("dpd_def"), n).alias("POS_AVG_DPD_DEF"),
            ratio(sum0("overdue"), n).alias("POS_DPD_RATIO"),
            ratio(sum0("recent_dpd"), sum0("recent_n")).alias("POS_RECENT_AVG_DPD"),
            level.otherwise(slope(n, sx, sy, sxy, sxx)).alias("POS_DPD_SLOPE"),
            (rate(recent) - rate(older)).alias("POS_COMPLETION_RATE_DIFF"),
        )
        .withColumn("POS_DPD_TREND", F.col("POS_RECENT_AVG_DPD") - F.col("POS_AVG_DPD"))
    )


def contract_sums(pos: DataFrame) -> DataFrame:
    """Additive sums, last month and completion of every contract; one that several customers share counts for each."""
    month, dpd = F.col("MONTHS_BALANCE").cast("long"), F.col("SK_DPD")
    recent_dpd = F.when(F.col("MONTHS_BALANCE") >= RECENT_MONTHS, dpd)
    return pos.groupBy("SK_ID_CURR", "SK_ID_PREV").agg(
        rows().alias("n"),
        F.max(dpd).alias("max_dpd"),
        F.max("SK_DPD_DEF").alias("max_dpd_def"),
        F.sum("SK_DPD_DEF").alias("dpd_def"),
        count_where(dpd > 0).alias("overdue"),
        F.sum(recent_dpd).alias("recent_dpd"),
        F.count(recent_dpd).alias("recent_n"),
        F.sum(month).alias("sx"),
        F.sum(dpd).alias("sy"),
        F.sum(month * dpd).alias("sxy"),
        F.sum(month * month).alias("sxx"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
        F.max(flag(F.col("NAME_CONTRACT_STATUS") == "Completed")).alias("completed"),
    )
