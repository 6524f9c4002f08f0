"""Features of the instalment payments, one row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.nulls import EPS, count_where, flag, mean_over_rows, mean_seen, ratio, rows, slope_of

WINDOWS = {"3M": -90, "6M": -180, "12M": -365}
LAST_PAYMENTS = 5


def _delay():
    return F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")


def _late():
    """An instalment is late when it was paid after its day or not at all."""
    return F.col("DAYS_ENTRY_PAYMENT").isNull() | (_delay() > 0)


def installment_features(payments: DataFrame) -> DataFrame:
    """Delay, lateness and underpayment, their windows and their trends."""
    due, paid = F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    day, delay, late = F.col("DAYS_INSTALMENT"), _delay(), _late()
    shortfall = paid - due
    per_customer = payments.groupBy("SK_ID_CURR").agg(
        rows().alias("count_inst"),
        mean_seen(delay).alias("AVG_PAYMENT_DELAY"),
        F.max(delay).alias("MAX_PAYMENT_DELAY"),
        ratio(count_where(late), rows()).alias("LATE_PAYMENT_RATIO"),
        mean_over_rows(shortfall).alias("AVG_PAYMENT_DIFF"),
        ratio(count_where(shortfall < 0), rows()).alias("UNDERPAID_RATIO"),
        *[
            ratio(count_where((day >= days) & late), count_where(day >= days)).alias(f"INST_LATE_RATIO_{label}")
            for label, days in WINDOWS.items()
        ],
        slope_of(day, F.try_divide(paid, due + F.lit(EPS))).alias("INST_PAY_RATIO_SLOPE"),
        slope_of(day, F.coalesce(delay, F.lit(0))).alias("INST_DELAY_SLOPE"),
    )
    return per_customer.join(last_payments(payments), "SK_ID_CURR", "left").withColumn(
        "LATE_RATIO_TREND", F.col("RECENT_LATE_RATIO") - F.col("LATE_PAYMENT_RATIO")
    )


def last_payments(payments: DataFrame, k: int = LAST_PAYMENTS) -> DataFrame:
    """Lateness over the k instalments due last.

    ``row_number() <= k`` is pushed below the shuffle, so that each task sends
    at most k rows per customer, however many payments a customer has. Rows that
    tie in all four columns are late by the same days, so no further column is read;
    these are the columns of the aggregates, and both sides can share what lies below.
    """
    newest = Window.partitionBy("SK_ID_CURR").orderBy(
        F.desc_nulls_last("DAYS_INSTALMENT"),
        F.asc_nulls_last("AMT_INSTALMENT"),
        F.asc_nulls_last("AMT_PAYMENT"),
        F.asc_nulls_last("DAYS_ENTRY_PAYMENT"),
    )
    return (
        payments.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= k)
        .groupBy("SK_ID_CURR")
        .agg(F.avg(flag(_late())).alias("RECENT_LATE_RATIO"), F.avg(_delay()).alias("RECENT_AVG_DELAY"))
    )
