"""One wide feature row per customer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from creditloom.operators.clean import clean_application, fill_constants
from creditloom.operators.features.bureau import bureau_features
from creditloom.operators.features.card import card_features
from creditloom.operators.features.installments import installment_features
from creditloom.operators.features.interactions import external_score_features, ratio_features
from creditloom.operators.features.pos import pos_features
from creditloom.operators.features.previous import previous_features

KEY = "SK_ID_CURR"

# Columns of the application table that an aggregate of the same name replaces.
REPLACED_BY_AGGREGATES = [
    "BUREAU_MAX_OVERDUE",
    "BUREAU_AVG_CREDIT",
    "BUREAU_LOAN_COUNT",
    "PREV_APP_COUNT",
    "AVG_PAYMENT_DELAY",
    "MAX_PAYMENT_DELAY",
    "PREV_AVG_CREDIT",
]


def history_features(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """The five per-customer aggregate tables."""
    return [
        bureau_features(tables["bureau"], tables["bureau_balance"]),
        previous_features(tables["previous_application"]),
        installment_features(tables["installments_payments"]),
        pos_features(tables["POS_CASH_balance"]),
        card_features(tables["credit_card_balance"]),
    ]


def join_histories(base: DataFrame, histories: list[DataFrame]) -> DataFrame:
    """Left-join the aggregates onto the applicants.

    Each aggregate leaves its shuffle partitioned by customer, so only the base
    table moves once more.
    """
    joined = base.drop(*REPLACED_BY_AGGREGATES)
    for history in histories:
        joined = joined.join(history, KEY, "left")
    return joined


def customer_features(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Application columns, history aggregates, interactions and constant fills."""
    base = clean_application(tables["application_train"])
    joined = join_histories(base, history_features(tables))
    return fill_constants(ratio_features(external_score_features(joined)))
