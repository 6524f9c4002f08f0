"""Hand-made rows for the missing-value and tie rules of the features."""

import pytest
from pyspark.sql import functions as F

from creditloom.operators.clean import fill_constants
from creditloom.operators.features.assemble import customer_features, join_histories
from creditloom.operators.features.bureau import bureau_features
from creditloom.operators.features.card import card_features
from creditloom.operators.features.installments import installment_features
from creditloom.operators.features.interactions import external_score_features
from creditloom.operators.features.pos import pos_features
from creditloom.operators.features.previous import previous_features

INST = (
    "SK_ID_CURR long, SK_ID_PREV long, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT long, AMT_INSTALMENT double,"
    " AMT_PAYMENT double"
)
POS = "SK_ID_CURR long, SK_ID_PREV long, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int, NAME_CONTRACT_STATUS string"
CARD = (
    "SK_ID_CURR long, MONTHS_BALANCE int, AMT_CREDIT_LIMIT_ACTUAL double, AMT_BALANCE double, SK_DPD int,"
    " AMT_DRAWINGS_CURRENT double, AMT_INST_MIN_REGULARITY double, AMT_PAYMENT_CURRENT double"
)
BUREAU = (
    "SK_ID_CURR long, SK_ID_BUREAU long, AMT_CREDIT_SUM double, CREDIT_DAY_OVERDUE long, AMT_CREDIT_SUM_DEBT double,"
    " CREDIT_ACTIVE string, DAYS_CREDIT int"
)
BALANCE = "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string"
PREV = (
    "SK_ID_PREV long, SK_ID_CURR long, AMT_APPLICATION double, AMT_CREDIT double, NAME_CONTRACT_STATUS string,"
    " DAYS_DECISION int"
)


def near(row, **expected):
    for name, value in expected.items():
        if value is None:
            assert row[name] is None, name
        else:
            assert row[name] == pytest.approx(value, abs=1e-6), name


def inst(spark, rows):
    return installment_features(spark.createDataFrame(rows, INST)).first()


def test_payment_never_entered(spark):
    row = inst(spark, [(1, 1, -10, None, 100.0, None)])
    near(
        row,
        count_inst=1,
        LATE_PAYMENT_RATIO=1,
        AVG_PAYMENT_DELAY=0,
        MAX_PAYMENT_DELAY=None,
        UNDERPAID_RATIO=0,
        AVG_PAYMENT_DIFF=0,
        INST_PAY_RATIO_SLOPE=0,
        INST_DELAY_SLOPE=0,
        RECENT_LATE_RATIO=1,
        RECENT_AVG_DELAY=None,
    )


def test_late_windows(spark):
    row = inst(spark, [(1, i, d, d + 1, 10.0, 10.0) for i, d in enumerate((-90, -91, -180, -365, -366))])
    near(row, INST_LATE_RATIO_3M=1, INST_LATE_RATIO_6M=1, INST_LATE_RATIO_12M=1)
    row = inst(spark, [(1, i, d, d, 10.0, 10.0) for i, d in enumerate((-90, -91, -180, -365))] + [(1, 9, -366, -1, 1.0, 1.0)])
    near(row, INST_LATE_RATIO_3M=0, INST_LATE_RATIO_6M=0, INST_LATE_RATIO_12M=0, LATE_PAYMENT_RATIO=0.2)


def test_equal_days_have_no_slope(spark):
    near(inst(spark, [(1, 1, -30, -29, 5.0, 5.0), (1, 2, -30, -25, 5.0, 4.0)]), INST_DELAY_SLOPE=0, INST_PAY_RATIO_SLOPE=0)


def test_last_five_payments(spark):
    rows = [(1, i, -i, -i + (1 if i >= 6 else 0), 1.0, 1.0) for i in range(1, 8)]
    near(inst(spark, rows), RECENT_LATE_RATIO=0, LATE_PAYMENT_RATIO=2 / 7, LATE_RATIO_TREND=-2 / 7)


def test_pos_without_recent_rows(spark):
    row = pos_features(spark.createDataFrame([(1, 1, -20, 4, 0, "Active")], POS)).first()
    near(row, POS_AVG_DPD=4, POS_RECENT_AVG_DPD=0, POS_DPD_TREND=-4, POS_DPD_SLOPE=0)


def test_pos_completion(spark):
    rows = [(1, 10, -3, 0, 0, "Completed"), (1, 11, -20, 0, 0, "Active")]
    near(pos_features(spark.createDataFrame(rows, POS)).first(), POS_COMPLETION_RATE_DIFF=1)


def test_card_with_zero_limit(spark):
    rows = [(1, -1, 0.0, 5.0, 0, 1.0, 0.0, 1.0), (1, -2, 0.0, 7.0, 0, 1.0, 0.0, 1.0)]
    row = card_features(spark.createDataFrame(rows, CARD)).first()
    near(
        row,
        CC_MAX_UTILIZATION=None,
        CC_AVG_UTILIZATION=0,
        CC_OVER_LIMIT_RATIO=1,
        CC_UTILIZATION_TREND_6M=0,
        CC_PAYMENT_TO_MIN_RATIO=0,
    )


def test_card_with_missing_drawings(spark):
    rows = [(1, -1, 10.0, 1.0, 0, None, 1.0, 1.0), (1, -9, 10.0, 1.0, 0, 10.0, 1.0, 1.0)]
    near(card_features(spark.createDataFrame(rows, CARD)).first(), CC_DRAWINGS_DIFF_6M=-10, CC_AVG_DRAWINGS=5)


def test_card_trend_counts_only_rows_with_utilization(spark):
    rows = [(1, -1, 10.0, 2.0, 0, 0.0, 1.0, 1.0), (1, -2, 10.0, 4.0, 0, 0.0, 1.0, 1.0), (1, -3, 0.0, 4.0, 0, 0.0, 1.0, 1.0)]
    sx, sy, sxy, sxx, n = -6, 0.6, -0.2 - 0.8, 14, 2
    expected = (sxy / n - sx / n * sy / n) / (sxx / n - (sx / n) ** 2)
    near(card_features(spark.createDataFrame(rows, CARD)).first(), CC_UTILIZATION_TREND_6M=expected)


def test_bureau_denominators(spark):
    rows = [(1, 1, 100.0, 0, None, "Active", -10), (1, 2, None, 0, 30.0, "Closed", -20)]
    row = bureau_features(spark.createDataFrame(rows, BUREAU), spark.createDataFrame([], BALANCE)).first()
    near(
        row,
        BUREAU_AVG_DEBT=15,
        BUREAU_AVG_CREDIT=100,
        BUREAU_DEBT_CREDIT_RATIO=30 / 101,
        BUREAU_AVG_DPD_RATIO=0,
        BUREAU_EVER_DPD=None,
        BUREAU_ACTIVE_CLOSED_RATIO=0.5,
    )


def test_previous_without_positive_application(spark):
    row = previous_features(spark.createDataFrame([(1, 1, 0.0, 5.0, "Approved", -3)], PREV)).first()
    near(row, PREV_CREDIT_APP_RATIO=0, PREV_AVG_CREDIT=5, PREV_DAYS_SINCE_LAST_REFUSED=None)


def test_previous_days(spark):
    rows = [(1, 1, 1.0, 1.0, "Approved", -5), (2, 1, 1.0, 1.0, "Refused", -50)]
    row = previous_features(spark.createDataFrame(rows, PREV)).first()
    near(row, PREV_MOST_RECENT_DAYS=-50, PREV_DAYS_SINCE_LAST_REFUSED=50, PREV_REFUSED_RATIO_RECENT3=0.5)


def test_one_external_score(spark):
    df = spark.createDataFrame([(0.4, None, None)], "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double")
    row = external_score_features(df).first()
    near(
        row,
        EXT_SOURCE_MEAN=0.4,
        EXT_SOURCE_STD=0,
        EXT_SOURCE_MIN=0.4,
        EXT_SOURCE_MAX=0.4,
        EXT_SOURCE_PROD=0.4,
        EXT_SOURCE_2_3_MULT=1,
    )


def test_no_external_score(spark):
    df = spark.createDataFrame([(None, None, None)], "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double")
    near(external_score_features(df).first(), EXT_SOURCE_MEAN=None, EXT_SOURCE_STD=0, EXT_SOURCE_MIN=None, EXT_SOURCE_PROD=1)


def test_applicant_without_history(spark):
    base = spark.createDataFrame([(7,)], "SK_ID_CURR long")
    histories = [
        bureau_features(spark.createDataFrame([], BUREAU), spark.createDataFrame([], BALANCE)),
        previous_features(spark.createDataFrame([], PREV)),
        installment_features(spark.createDataFrame([], INST)),
        pos_features(spark.createDataFrame([], POS)),
        card_features(spark.createDataFrame([], CARD)),
    ]
    row = fill_constants(join_histories(base, histories)).first()
    near(row, BUREAU_LOAN_COUNT=0, CC_DRAWINGS_DIFF_6M=0, PREV_DAYS_SINCE_LAST_REFUSED=99999, BUREAU_AVG_DEBT=None)


def test_replaced_columns_leave_the_base(spark):
    base = spark.createDataFrame([(1, 5.0)], "SK_ID_CURR long, PREV_AVG_CREDIT double")
    prev = previous_features(spark.createDataFrame([(1, 1, 1.0, 9.0, "Approved", -5)], PREV))
    assert join_histories(base, [prev]).first()["PREV_AVG_CREDIT"] == pytest.approx(9.0)


@pytest.fixture(scope="module")
def hot_payments(spark):
    """3000 payments of which customer 0 has a third; contracts follow the customer."""
    return (
        spark.range(3000)
        .select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 97).cast("long").alias("SK_ID_CURR"),
            (F.col("id") % 500).alias("SK_ID_PREV"),
            (-(F.col("id") * 37 % 700)).cast("int").alias("DAYS_INSTALMENT"),
            F.when(F.col("id") % 11 != 0, -(F.col("id") * 37 % 700) + F.col("id") % 7 - 3).alias("DAYS_ENTRY_PAYMENT"),
            (100.0 + F.col("id") % 13).alias("AMT_INSTALMENT"),
            F.when(F.col("id") % 11 != 0, 95.0 + F.col("id") % 17).alias("AMT_PAYMENT"),
        )
    )


def test_hot_customer_against_pandas(spark, hot_payments):
    got = installment_features(hot_payments).toPandas().set_index("SK_ID_CURR").sort_index()
    rows = hot_payments.toPandas()
    delay = rows.DAYS_ENTRY_PAYMENT - rows.DAYS_INSTALMENT
    rows = rows.assign(delay=delay, late=(rows.DAYS_ENTRY_PAYMENT.isna() | (delay > 0)).astype(int))
    by = rows.groupby("SK_ID_CURR")
    assert (got.count_inst == by.size()).all()
    assert got.LATE_PAYMENT_RATIO.to_numpy() == pytest.approx(by.late.mean().to_numpy(), abs=1e-6)
    assert got.MAX_PAYMENT_DELAY.to_numpy() == pytest.approx(by.delay.max().to_numpy())
    order = ["SK_ID_CURR", "DAYS_INSTALMENT", "SK_ID_PREV", "AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_ENTRY_PAYMENT"]
    last = rows.sort_values(order, ascending=[True, False, True, True, True, True]).groupby("SK_ID_CURR").head(5)
    expected = last.groupby("SK_ID_CURR").late.mean()
    assert got.RECENT_LATE_RATIO.to_numpy() == pytest.approx(expected.to_numpy(), abs=1e-9)
    x, y = rows.DAYS_INSTALMENT.astype(float), rows.delay.fillna(0)
    for key in (0, 5):
        at = rows.SK_ID_CURR == key
        cov = (x[at] * y[at]).mean() - x[at].mean() * y[at].mean()
        var = (x[at] ** 2).mean() - x[at].mean() ** 2
        assert got.INST_DELAY_SLOPE[key] == pytest.approx(cov / (var + 1e-9), abs=1e-9)


def test_partition_count_does_not_matter(spark, hot_payments):
    def rows(n):
        df = installment_features(hot_payments.repartition(n))
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())

    assert rows(1) == rows(13)


def test_assembled_row_has_every_family(spark, sf0001):
    from creditloom.plans.feature_queries import feature_tables

    df = customer_features(feature_tables(spark, sf0001))
    assert df.count() == 150
    assert {"POS_COUNT", "CC_COUNT", "count_inst", "PREV_APP_COUNT", "BUREAU_LOAN_COUNT"} <= set(df.columns)
