"""The physical plans are the ones the design asks for."""

import re

import pytest

from creditloom.functions.nulls import rounded
from creditloom.operators.features.card import card_features
from creditloom.operators.features.installments import last_payments
from creditloom.operators.features.pos import pos_features
from creditloom.plans import QUERIES
from creditloom.session import RUNTIME_CONF, scratch_path
from creditloom.sources.tables import save_bucketed
from creditloom.sources.views import table, view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LIGHT = [
    n
    for n, q in QUERIES.items()
    if q.sql is not None and not n.endswith("_stream") and not q.trains
]


@pytest.mark.parametrize("name", LIGHT)
def test_no_cross_join_no_python(spark, sf0001, name):
    text = plan(QUERIES[name].build(spark, sf0001))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "MapInPandas" not in text


def test_family_is_one_exchange(spark, sf0001):
    text = plan(card_features(view(spark, sf0001, "credit_card_balance")))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert text.count("partial_count") > 0


def test_scan_reads_only_needed_columns(spark, sf0001):
    text = plan(pos_features(view(spark, sf0001, "POS_CASH_balance")))
    assert "l_comment" not in text and "l_extendedprice" not in text
    assert "o_totalprice" not in text


def test_filter_reaches_the_scan(spark, sf0001):
    text = plan(view(spark, sf0001, "previous_application").where("SK_ID_PREV = 7"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderkey,7\)", text)


def test_rank_limit_is_below_the_shuffle(spark, sf0001):
    text = plan(last_payments(view(spark, sf0001, "installments_payments")))
    exchange = text.index("Exchange hashpartitioning(SK_ID_CURR")
    assert "WindowGroupLimit" in text[:exchange] and "WindowGroupLimit" in text[exchange:]


def test_top_n_is_not_a_full_sort(spark, sf0001):
    assert "TakeOrderedAndProject" in plan(QUERIES["recent_decisions"].build(spark, sf0001))


def test_explanations_need_no_shuffle(spark, sf0001):
    for name in ("top_factors", "narrations", "waterfall_steps", "factor_lines"):
        assert "Exchange hashpartitioning" not in plan(QUERIES[name].build(spark, sf0001)), name


def test_big_joins_are_not_forced_to_broadcast(spark, sf0001):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["customer_features"].build(spark, sf0001))
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
        # the assembled join adds one exchange for the base, none for an aggregate
        top = text[: text.index("Exchange")]
        assert top.count("SortMergeJoin") >= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("pos_history", 2, 3), ("installment_history", 4, 6), ("customer_features", 11, 18)])
def test_scans_and_exchanges_of_a_run(spark, sf0001, name, scans, exchanges):
    """As run, what is read twice is read once where Spark can share it; joins are not broadcast here."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name].build(spark, sf0001)
        df.collect()
        text = plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    ran = text[: text.index("== Initial Plan")]
    assert len(re.findall(r"Scan parquet", ran)) <= scans
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", ran)) <= exchanges


def test_bucketed_history_needs_no_shuffle(spark, sf0001):
    cards = view(spark, sf0001, "credit_card_balance")
    stored = save_bucketed(cards, "bucketed_cards", "SK_ID_CURR", 4, scratch_path(spark, "bucketed"))
    try:
        text = plan(card_features(stored))
        assert "Exchange hashpartitioning" not in text
        rows = lambda df: sorted(map(str, rounded(df).collect()))
        assert rows(card_features(stored)) == rows(card_features(cards))
    finally:
        spark.sql("drop table bucketed_cards")


def test_runtime_settings_are_applied(spark, sf0001):
    table(spark, sf0001, "nation")
    for key, value in RUNTIME_CONF.items():
        assert spark.conf.get(key) == value


def test_accepted_and_rejected_decisions_are_joined_by_tasks_of_their_own(spark, sf0001):
    """One task for both joins would sort its decisions twice and hold both."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    df = QUERIES["decision_appends"].build(spark, sf0001)
    old = {key: spark.conf.get(key) for key in off}
    try:
        for key, value in off.items():
            spark.conf.set(key, value)
        assert df.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
