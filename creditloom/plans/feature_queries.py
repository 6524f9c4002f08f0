"""Feature families and the assembled customer row."""

from __future__ import annotations

from creditloom.functions.nulls import rounded
from creditloom.operators.clean import NEVER_REFUSED_DAYS, ZERO_FILL, clean_application
from creditloom.operators.features import assemble
from creditloom.operators.features.bureau import balance_by_loan, bureau_features
from creditloom.operators.features.card import card_features
from creditloom.operators.features.installments import installment_features
from creditloom.operators.features.interactions import (
    PLUS_ONE_RATIOS,
    SMALL_TERM_RATIOS,
    external_score_features,
    ratio_features,
)
from creditloom.operators.features.pos import pos_features
from creditloom.operators.features.previous import previous_features
from creditloom.plans.registry import columns_sql, query, r6, with_views
from creditloom.sources.views import view

E = "1e-9"


def _sum0(x):
    return f"coalesce(sum({x}),0)"


def _where(c):
    return f"count(*) filter (where {c})"


def _over_rows(x):
    return f"{_sum0(x)}/(count(*)+{E})"


def _seen(x):
    return f"{_sum0(x)}/(count({x})+{E})"


def _slope(x, y):
    x = f"cast({x} as bigint)"
    n = "count(*)"
    return (
        f"case when count(*)<2 or min({x})=max({x}) then 0e0 else"
        f" ({_sum0(f'{x}*({y})')}/{n} - ({_sum0(x)}/{n})*({_sum0(y)}/{n}))"
        f" / ({_sum0(f'{x}*{x}')}/{n} - ({_sum0(x)}/{n})*({_sum0(x)}/{n}) + {E}) end"
    )


# --- point of sale ---------------------------------------------------------------

POS_INT = ["SK_ID_CURR", "POS_COUNT", "POS_MAX_DPD", "POS_MAX_DPD_DEF"]
POS_DBL = [
    "POS_AVG_DPD",
    "POS_AVG_DPD_DEF",
    "POS_DPD_RATIO",
    "POS_RECENT_AVG_DPD",
    "POS_DPD_SLOPE",
    "POS_DPD_TREND",
    "POS_COMPLETION_RATE_DIFF",
]
_RECENT_DPD = "case when MONTHS_BALANCE>=-6 then SK_DPD end"
_RATE = "coalesce(sum(case when {w} then completed end),0)/(count(*) filter (where {w})+1e-9)"
POS_CTES = [
    f"""pos_main as (select SK_ID_CURR, count(*) as POS_COUNT, max(SK_DPD) as POS_MAX_DPD,
 max(SK_DPD_DEF) as POS_MAX_DPD_DEF, {_over_rows('SK_DPD')} as POS_AVG_DPD,
 {_over_rows('SK_DPD_DEF')} as POS_AVG_DPD_DEF, {_where('SK_DPD>0')}/(count(*)+{E}) as POS_DPD_RATIO,
 {_seen(_RECENT_DPD)} as POS_RECENT_AVG_DPD, {_slope('MONTHS_BALANCE', 'SK_DPD')} as POS_DPD_SLOPE
 from POS_CASH_balance group by SK_ID_CURR)""",
    """contracts as (select SK_ID_PREV, min(SK_ID_CURR) as SK_ID_CURR, max(MONTHS_BALANCE) as last_month,
 max(case when NAME_CONTRACT_STATUS='Completed' then 1 else 0 end) as completed
 from POS_CASH_balance group by SK_ID_PREV)""",
    f"""completion as (select SK_ID_CURR, {_RATE.format(w='last_month>=-12')} - {_RATE.format(w='last_month<-12')}
 as POS_COMPLETION_RATE_DIFF from contracts group by SK_ID_CURR)""",
    """pos as (select m.*, POS_RECENT_AVG_DPD-POS_AVG_DPD as POS_DPD_TREND, POS_COMPLETION_RATE_DIFF
 from pos_main m left join completion c on m.SK_ID_CURR=c.SK_ID_CURR)""",
]


@query(
    "A01-A07, J03",
    with_views(["POS_CASH_balance"], f"select {columns_sql(POS_INT, POS_DBL)} from pos", POS_CTES),
)
def pos_history(spark, sf_dir):
    return rounded(pos_features(view(spark, sf_dir, "POS_CASH_balance")))


# --- cards -----------------------------------------------------------------------

CARD_INT = ["SK_ID_CURR", "CC_COUNT", "CC_MAX_DPD"]
CARD_DBL = [
    "CC_MAX_UTILIZATION",
    "CC_AVG_UTILIZATION",
    "CC_AVG_DPD",
    "CC_AVG_DRAWINGS",
    "CC_OVER_LIMIT_RATIO",
    "CC_PAYMENT_TO_MIN_RATIO",
    "CC_UTILIZATION_TREND_6M",
    "CC_DRAWINGS_DIFF_6M",
]
_RU = "case when m>=-6 then u end"
_RM = "case when m>=-6 then m end"
_RD = "case when m>=-6 then AMT_DRAWINGS_CURRENT end"
_N = f"(count({_RU})+{E})"
_MX, _MY = f"({_sum0(_RM)}/{_N})", f"({_sum0(_RU)}/{_N})"
_MXY, _MXX = f"({_sum0('case when m>=-6 then m*u end')}/{_N})", f"({_sum0('case when m>=-6 then m*m end')}/{_N})"
CARD_CTES = [
    """cc as (select *, cast(MONTHS_BALANCE as bigint) as m,
 case when AMT_CREDIT_LIMIT_ACTUAL>0 then AMT_BALANCE/AMT_CREDIT_LIMIT_ACTUAL end as u,
 case when AMT_INST_MIN_REGULARITY>0 then AMT_PAYMENT_CURRENT/AMT_INST_MIN_REGULARITY end as pay
 from credit_card_balance)""",
    f"""card as (select SK_ID_CURR, count(*) as CC_COUNT, max(u) as CC_MAX_UTILIZATION, max(SK_DPD) as CC_MAX_DPD,
 {_seen('u')} as CC_AVG_UTILIZATION, {_over_rows('SK_DPD')} as CC_AVG_DPD,
 {_over_rows('AMT_DRAWINGS_CURRENT')} as CC_AVG_DRAWINGS,
 {_where('AMT_BALANCE>AMT_CREDIT_LIMIT_ACTUAL')}/(count(*)+{E}) as CC_OVER_LIMIT_RATIO,
 {_seen('pay')} as CC_PAYMENT_TO_MIN_RATIO,
 case when count({_RU})<2 then 0e0 else ({_MXY}-{_MX}*{_MY})/({_MXX}-{_MX}*{_MX}+{E}) end as CC_UTILIZATION_TREND_6M,
 {_seen(_RD)}-{_seen('AMT_DRAWINGS_CURRENT')} as CC_DRAWINGS_DIFF_6M from cc group by SK_ID_CURR)""",
]


@query(
    "A08-A13",
    with_views(["credit_card_balance"], f"select {columns_sql(CARD_INT, CARD_DBL)} from card", CARD_CTES),
)
def card_history(spark, sf_dir):
    return rounded(card_features(view(spark, sf_dir, "credit_card_balance")))


# --- bureau ----------------------------------------------------------------------

BUREAU_INT = ["SK_ID_CURR", "BUREAU_LOAN_COUNT", "BUREAU_MAX_OVERDUE", "BUREAU_EVER_DPD", "BUREAU_ACTIVE_COUNT"]
BUREAU_DBL = [
    "BUREAU_AVG_CREDIT",
    "BUREAU_AVG_DEBT",
    "BUREAU_AVG_DPD_RATIO",
    "BUREAU_RECENT_DPD_RATIO",
    "BUREAU_DEBT_CREDIT_RATIO",
    "BUREAU_RECENCY_WEIGHTED_OVERDUE",
    "BUREAU_DEBT_DAYS_SLOPE",
    "BUREAU_ACTIVE_CLOSED_RATIO",
    "BUREAU_DPD_TREND",
]
_LATE_STATUS = "STATUS in ('1','2','3','4','5')"
_RECENT_LATE = f"MONTHS_BALANCE>=-12 and {_LATE_STATUS}"
LOAN_CTE = f"""loan_balance as (select SK_ID_BUREAU, count(*) as BB_MONTHS_COUNT,
 max(case when {_LATE_STATUS} then 1 else 0 end) as BB_EVER_DPD,
 {_where(_LATE_STATUS)}/(count(*)+{E}) as BB_DPD_RATIO,
 {_where(_RECENT_LATE)}/({_where('MONTHS_BALANCE>=-12')}+{E}) as BB_RECENT_DPD_RATIO
 from bureau_balance group by SK_ID_BUREAU)"""
_W = "exp(DAYS_CREDIT/365e0)"
BUREAU_CTES = [
    LOAN_CTE,
    f"""bureau_main as (select SK_ID_CURR, count(*) as BUREAU_LOAN_COUNT, max(CREDIT_DAY_OVERDUE) as BUREAU_MAX_OVERDUE,
 max(BB_EVER_DPD) as BUREAU_EVER_DPD, {_seen('AMT_CREDIT_SUM')} as BUREAU_AVG_CREDIT,
 {_over_rows('AMT_CREDIT_SUM_DEBT')} as BUREAU_AVG_DEBT, {_seen('BB_DPD_RATIO')} as BUREAU_AVG_DPD_RATIO,
 {_seen('BB_RECENT_DPD_RATIO')} as BUREAU_RECENT_DPD_RATIO,
 {_where("CREDIT_ACTIVE='Active'")} as BUREAU_ACTIVE_COUNT,
 {_sum0('AMT_CREDIT_SUM_DEBT')}/({_sum0('AMT_CREDIT_SUM')}+1) as BUREAU_DEBT_CREDIT_RATIO,
 {_sum0(f'CREDIT_DAY_OVERDUE*{_W}')}/({_sum0(_W)}+{E}) as BUREAU_RECENCY_WEIGHTED_OVERDUE,
 {_slope('DAYS_CREDIT', 'AMT_CREDIT_SUM_DEBT')} as BUREAU_DEBT_DAYS_SLOPE,
 {_where("CREDIT_ACTIVE='Active'")}/({_where("CREDIT_ACTIVE='Closed'")}+1) as BUREAU_ACTIVE_CLOSED_RATIO
 from bureau b left join loan_balance l on b.SK_ID_BUREAU=l.SK_ID_BUREAU group by SK_ID_CURR)""",
    """bureau_all as (select *, BUREAU_RECENT_DPD_RATIO-BUREAU_AVG_DPD_RATIO as BUREAU_DPD_TREND from bureau_main)""",
]


@query(
    "A15-A21, J02",
    with_views(
        ["bureau", "bureau_balance"], f"select {columns_sql(BUREAU_INT, BUREAU_DBL)} from bureau_all", BUREAU_CTES
    ),
)
def bureau_history(spark, sf_dir):
    return rounded(bureau_features(view(spark, sf_dir, "bureau"), view(spark, sf_dir, "bureau_balance")))


@query(
    "A14",
    with_views(
        ["bureau_balance"],
        "select "
        + columns_sql(["SK_ID_BUREAU", "BB_MONTHS_COUNT", "BB_EVER_DPD"], ["BB_DPD_RATIO", "BB_RECENT_DPD_RATIO"])
        + " from loan_balance",
        [LOAN_CTE],
    ),
)
def bureau_loan_balance(spark, sf_dir):
    return rounded(balance_by_loan(view(spark, sf_dir, "bureau_balance")))


# --- instalments -----------------------------------------------------------------

INST_INT = ["SK_ID_CURR", "count_inst", "MAX_PAYMENT_DELAY"]
INST_DBL = [
    "AVG_PAYMENT_DELAY",
    "LATE_PAYMENT_RATIO",
    "AVG_PAYMENT_DIFF",
    "UNDERPAID_RATIO",
    "INST_LATE_RATIO_3M",
    "INST_LATE_RATIO_6M",
    "INST_LATE_RATIO_12M",
    "INST_PAY_RATIO_SLOPE",
    "INST_DELAY_SLOPE",
    "RECENT_LATE_RATIO",
    "RECENT_AVG_DELAY",
    "LATE_RATIO_TREND",
]
_LATE = "(DAYS_ENTRY_PAYMENT is null or delay>0)"


def _window_ratio(days):
    due = f"DAYS_INSTALMENT>={days}"
    return f"{_where(f'{due} and {_LATE}')}/({_where(due)}+{E})"


INST_CTES = [
    """inst_rows as (select *, DAYS_ENTRY_PAYMENT-DAYS_INSTALMENT as delay, AMT_PAYMENT-AMT_INSTALMENT as diff
 from installments_payments)""",
    f"""inst_main as (select SK_ID_CURR, count(*) as count_inst, {_seen('delay')} as AVG_PAYMENT_DELAY,
 max(delay) as MAX_PAYMENT_DELAY, {_where(_LATE)}/(count(*)+{E}) as LATE_PAYMENT_RATIO,
 {_over_rows('diff')} as AVG_PAYMENT_DIFF, {_where('diff<0')}/(count(*)+{E}) as UNDERPAID_RATIO,
 {_window_ratio(-90)} as INST_LATE_RATIO_3M, {_window_ratio(-180)} as INST_LATE_RATIO_6M,
 {_window_ratio(-365)} as INST_LATE_RATIO_12M,
 {_slope('DAYS_INSTALMENT', 'AMT_PAYMENT/(AMT_INSTALMENT+1e-9)')} as INST_PAY_RATIO_SLOPE,
 {_slope('DAYS_INSTALMENT', 'coalesce(delay,0)')} as INST_DELAY_SLOPE from inst_rows group by SK_ID_CURR)""",
    """inst_ranked as (select *, row_number() over (partition by SK_ID_CURR order by DAYS_INSTALMENT desc nulls last,
 AMT_INSTALMENT nulls last, AMT_PAYMENT nulls last, DAYS_ENTRY_PAYMENT nulls last) as rn
 from inst_rows)""",
    f"""inst_last as (select SK_ID_CURR, avg(case when {_LATE} then 1 else 0 end) as RECENT_LATE_RATIO,
 avg(delay) as RECENT_AVG_DELAY from inst_ranked where rn<=5 group by SK_ID_CURR)""",
    """inst as (select m.*, RECENT_LATE_RATIO, RECENT_AVG_DELAY, RECENT_LATE_RATIO-LATE_PAYMENT_RATIO as LATE_RATIO_TREND
 from inst_main m left join inst_last l on m.SK_ID_CURR=l.SK_ID_CURR)""",
]


@query(
    "A22-A28, W01",
    with_views(["installments_payments"], f"select {columns_sql(INST_INT, INST_DBL)} from inst", INST_CTES),
)
def installment_history(spark, sf_dir):
    return rounded(installment_features(view(spark, sf_dir, "installments_payments")))


# --- previous applications ----------------------------------------------------------

PREV_INT = [
    "SK_ID_CURR",
    "PREV_APP_COUNT",
    "PREV_REFUSED_COUNT",
    "PREV_MOST_RECENT_DAYS",
    "PREV_DAYS_SINCE_LAST_REFUSED",
]
PREV_DBL = ["PREV_AVG_CREDIT", "PREV_REFUSED_RATIO", "PREV_CREDIT_APP_RATIO", "PREV_REFUSED_RATIO_RECENT3"]
_REFUSED = "NAME_CONTRACT_STATUS='Refused'"
PREV_CTES = [
    f"""prev_main as (select SK_ID_CURR, count(*) as PREV_APP_COUNT, {_seen('AMT_CREDIT')} as PREV_AVG_CREDIT,
 {_where(_REFUSED)} as PREV_REFUSED_COUNT, {_where(_REFUSED)}/(count(*)+{E}) as PREV_REFUSED_RATIO,
 {_seen('case when AMT_APPLICATION>0 then AMT_CREDIT/AMT_APPLICATION end')} as PREV_CREDIT_APP_RATIO,
 min(DAYS_DECISION) as PREV_MOST_RECENT_DAYS,
 -max(case when {_REFUSED} then DAYS_DECISION end) as PREV_DAYS_SINCE_LAST_REFUSED
 from previous_application group by SK_ID_CURR)""",
    """prev_ranked as (select *, row_number() over (partition by SK_ID_CURR order by DAYS_DECISION desc nulls last,
 SK_ID_PREV nulls last) as rn from previous_application)""",
    f"""prev_last as (select SK_ID_CURR, avg(case when {_REFUSED} then 1 else 0 end) as PREV_REFUSED_RATIO_RECENT3
 from prev_ranked where rn<=3 group by SK_ID_CURR)""",
    """prev as (select m.*, PREV_REFUSED_RATIO_RECENT3 from prev_main m left join prev_last l
 on m.SK_ID_CURR=l.SK_ID_CURR)""",
]


@query(
    "A29-A33, W02",
    with_views(["previous_application"], f"select {columns_sql(PREV_INT, PREV_DBL)} from prev", PREV_CTES),
)
def previous_history(spark, sf_dir):
    return rounded(previous_features(view(spark, sf_dir, "previous_application")))


# --- application, interactions, assembly -----------------------------------------------

MEDIANS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"]
FLAGGED_CTE = """flagged as (select * replace (nullif(DAYS_EMPLOYED, 365243) as DAYS_EMPLOYED),
 case when DAYS_EMPLOYED=365243 then 1 else 0 end as DAYS_EMPLOYED_ANOM from application_train)"""
CLEAN_CTES = [
    FLAGGED_CTE,
    """mid as (select median(AMT_INCOME_TOTAL) as m1, median(AMT_CREDIT) as m2, median(AMT_ANNUITY) as m3,
 median(DAYS_EMPLOYED) as m4 from flagged)""",
    """app as (select flagged.* replace (coalesce(AMT_INCOME_TOTAL, m1) as AMT_INCOME_TOTAL,
 coalesce(AMT_CREDIT, m2) as AMT_CREDIT, coalesce(AMT_ANNUITY, m3) as AMT_ANNUITY,
 cast(coalesce(DAYS_EMPLOYED, m4) as double) as DAYS_EMPLOYED) from flagged, mid)""",
]
APP_INT = [
    "SK_ID_CURR",
    "TARGET",
    "DAYS_BIRTH",
    "DAYS_REGISTRATION",
    "DAYS_LAST_PHONE_CHANGE",
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
    "CODE_GENDER",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "DAYS_EMPLOYED_ANOM",
]
APP_DBL = [*MEDIANS, "DAYS_EMPLOYED", "OWN_CAR_AGE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXT_DBL = [
    "EXT_SOURCE_MEAN",
    "EXT_SOURCE_STD",
    "EXT_SOURCE_MIN",
    "EXT_SOURCE_MAX",
    "EXT_SOURCE_PROD",
    "EXT_SOURCE_1_2_MULT",
    "EXT_SOURCE_2_3_MULT",
    "EXT_SOURCE_1_3_MULT",
]
RATIO_DBL = [*[n for _, _, n in SMALL_TERM_RATIOS], *[n for _, _, n in PLUS_ONE_RATIOS], "AGE_YEARS"]
_LIST = "[x for x in [EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3] if x is not null]"
EXT_SQL = ", ".join(
    [
        f"list_avg({_LIST}) as EXT_SOURCE_MEAN",
        f"case when len({_LIST})>1 then list_stddev_samp({_LIST}) else 0e0 end as EXT_SOURCE_STD",
        f"list_min({_LIST}) as EXT_SOURCE_MIN",
        f"list_max({_LIST}) as EXT_SOURCE_MAX",
        "coalesce(EXT_SOURCE_1,1)*coalesce(EXT_SOURCE_2,1)*coalesce(EXT_SOURCE_3,1) as EXT_SOURCE_PROD",
        "coalesce(EXT_SOURCE_1,1)*coalesce(EXT_SOURCE_2,1) as EXT_SOURCE_1_2_MULT",
        "coalesce(EXT_SOURCE_2,1)*coalesce(EXT_SOURCE_3,1) as EXT_SOURCE_2_3_MULT",
        "coalesce(EXT_SOURCE_1,1)*coalesce(EXT_SOURCE_3,1) as EXT_SOURCE_1_3_MULT",
    ]
)
RATIO_SQL = ", ".join(
    [
        *[f"{a}/({b}+{E}) as {n}" for a, b, n in SMALL_TERM_RATIOS],
        *[f"{a}/({b}+1) as {n}" for a, b, n in PLUS_ONE_RATIOS],
        "-DAYS_BIRTH/365e0 as AGE_YEARS",
    ]
)


@query(
    "C01, C02",
    with_views(["application_train"], f"select {columns_sql(APP_INT, APP_DBL)} from app", CLEAN_CTES),
)
def application_clean(spark, sf_dir):
    return rounded(clean_application(view(spark, sf_dir, "application_train")))


@query(
    "F01, F02",
    with_views(
        ["application_train"],
        f"select SK_ID_CURR, {', '.join(r6(c) for c in EXT_DBL)} from (select SK_ID_CURR, {EXT_SQL} from app)",
        CLEAN_CTES,
    ),
)
def external_scores(spark, sf_dir):
    app = clean_application(view(spark, sf_dir, "application_train"))
    return rounded(external_score_features(app).select("SK_ID_CURR", *EXT_DBL))


@query(
    "F03, F04",
    with_views(
        ["application_train"],
        f"select SK_ID_CURR, {', '.join(r6(c) for c in RATIO_DBL)} from (select SK_ID_CURR, {RATIO_SQL} from app)",
        CLEAN_CTES,
    ),
)
def application_ratios(spark, sf_dir):
    app = clean_application(view(spark, sf_dir, "application_train"))
    return rounded(ratio_features(app).select("SK_ID_CURR", *RATIO_DBL))


HISTORY_VIEWS = [
    "application_train",
    "bureau",
    "bureau_balance",
    "previous_application",
    "installments_payments",
    "POS_CASH_balance",
    "credit_card_balance",
]
HISTORIES = {
    "bureau_all": (BUREAU_INT, BUREAU_DBL),
    "prev": (PREV_INT, PREV_DBL),
    "inst": (INST_INT, INST_DBL),
    "pos": (POS_INT, POS_DBL),
    "card": (CARD_INT, CARD_DBL),
}
FEATURE_INT = [*APP_INT, *[c for ints, _ in HISTORIES.values() for c in ints if c != "SK_ID_CURR"]]
FEATURE_DBL = [*APP_DBL, *[c for _, dbls in HISTORIES.values() for c in dbls], *EXT_DBL, *RATIO_DBL]


def _filled(c):
    if c in ZERO_FILL:
        return f"coalesce({c},0) as {c}"
    if c == "PREV_DAYS_SINCE_LAST_REFUSED":
        return f"coalesce({c},{NEVER_REFUSED_DAYS}) as {c}"
    return c


_JOINED = "app " + " ".join(f"left join {h} on app.SK_ID_CURR={h}.SK_ID_CURR" for h in HISTORIES)
_FEATURE_COLUMNS = ", ".join(
    f"app.{c}" if c in APP_INT or c in APP_DBL else _filled(c)
    for c in [*FEATURE_INT, *FEATURE_DBL]
    if c not in EXT_DBL and c not in RATIO_DBL
)
FEATURE_CTES = [
    *CLEAN_CTES,
    *BUREAU_CTES,
    *PREV_CTES,
    *INST_CTES,
    *POS_CTES,
    *CARD_CTES,
    f"joined as (select {_FEATURE_COLUMNS} from {_JOINED})",
    f"features as (select *, {EXT_SQL}, {RATIO_SQL} from joined)",
]


def feature_tables(spark, sf_dir):
    return {v: view(spark, sf_dir, v) for v in HISTORY_VIEWS}


def feature_rows(spark, sf_dir):
    return assemble.customer_features(feature_tables(spark, sf_dir))


@query(
    "J01, C04, C05, S05, U01",
    with_views(HISTORY_VIEWS, f"select {columns_sql(FEATURE_INT, FEATURE_DBL)} from features", FEATURE_CTES),
)
def customer_features(spark, sf_dir):
    return rounded(feature_rows(spark, sf_dir))
