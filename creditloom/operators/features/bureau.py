"""Features of the bureau loans and their monthly status, one row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.nulls import EPS, count_where, flag, mean_over_rows, mean_seen, ratio, rows, slope_of, sum0

RECENT_MONTHS = -12
OVERDUE_STATUS = ["1", "2", "3", "4", "5"]


def balance_by_loan(bureau_balance: DataFrame) -> DataFrame:
    """Months seen and share of overdue months for each bureau loan."""
    overdue = flag(F.col("STATUS").isin(OVERDUE_STATUS))
    recent = F.col("MONTHS_BALANCE") >= RECENT_MONTHS
    return bureau_balance.groupBy("SK_ID_BUREAU").agg(
        rows().alias("BB_MONTHS_COUNT"),
        F.max(overdue).alias("BB_EVER_DPD"),
        ratio(F.sum(overdue), rows()).alias("BB_DPD_RATIO"),
        ratio(sum0(F.when(recent, overdue)), count_where(recent)).alias("BB_RECENT_DPD_RATIO"),
    )


def bureau_features(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """Counts, exposure, overdue history and debt trend over a customer's bureau loans."""
    loans = bureau.join(balance_by_loan(bureau_balance), "SK_ID_BUREAU", "left")
    credit, debt = F.col("AMT_CREDIT_SUM"), F.col("AMT_CREDIT_SUM_DEBT")
    weight = F.exp(F.col("DAYS_CREDIT") / F.lit(365.0))
    active = count_where(F.col("CREDIT_ACTIVE") == "Active")
    closed = count_where(F.col("CREDIT_ACTIVE") == "Closed")
    return (
        loans.groupBy("SK_ID_CURR")
        .agg(
            rows().alias("BUREAU_LOAN_COUNT"),
            F.max("CREDIT_DAY_OVERDUE").alias("BUREAU_MAX_OVERDUE"),
            F.max("BB_EVER_DPD").alias("BUREAU_EVER_DPD"),
            mean_seen(credit).alias("BUREAU_AVG_CREDIT"),
            mean_over_rows(debt).alias("BUREAU_AVG_DEBT"),
            mean_seen("BB_DPD_RATIO").alias("BUREAU_AVG_DPD_RATIO"),
            mean_seen("BB_RECENT_DPD_RATIO").alias("BUREAU_RECENT_DPD_RATIO"),
            active.alias("BUREAU_ACTIVE_COUNT"),
            F.try_divide(sum0(debt), sum0(credit) + 1).alias("BUREAU_DEBT_CREDIT_RATIO"),
            (sum0(F.col("CREDIT_DAY_OVERDUE") * weight) / (sum0(weight) + F.lit(EPS))).alias(
                "BUREAU_RECENCY_WEIGHTED_OVERDUE"
            ),
            slope_of("DAYS_CREDIT", debt).alias("BUREAU_DEBT_DAYS_SLOPE"),
            (active / (closed + 1)).alias("BUREAU_ACTIVE_CLOSED_RATIO"),
        )
        .withColumn("BUREAU_DPD_TREND", F.col("BUREAU_RECENT_DPD_RATIO") - F.col("BUREAU_AVG_DPD_RATIO"))
    )
