"""Credit-shaped views over the star-schema test tables.

Each view is declared once; the same expressions are rendered for Spark and for
the SQL oracle. ``DD(x,d)`` stands for the days from date d to x.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


@dataclass(frozen=True)
class View:
    tables: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    on: str | None = None


_CREDIT = "cast(45000+(c_custkey*37%1000)*500 as double)"
_DUE = "DD(o_orderdate,2001-12-01)+10*l_linenumber"
_SHIP_MONTH = "cast((extract(year from l_shipdate)-2001)*12+extract(month from l_shipdate)-12 as int)"
_APPLICATION = (
    ("SK_ID_CURR", "c_custkey"),
    ("TARGET", "case when (c_custkey*7919)%100 < case when c_acctbal<2000 then 20 else 4 end then 1 else 0 end"),
    ("AMT_INCOME_TOTAL", "case when c_custkey%17=0 then null else cast(20000+10*c_acctbal as double) end"),
    ("AMT_CREDIT", _CREDIT),
    ("AMT_ANNUITY", f"case when c_custkey%23=0 then null else {_CREDIT}/(10+c_custkey%20) end"),
    ("DAYS_EMPLOYED", "case when c_custkey%6=0 then 365243 else -(c_custkey*31%12000+1) end"),
    ("DAYS_BIRTH", "-(7500+c_custkey*53%17000)"),
    ("DAYS_REGISTRATION", "-(c_custkey*71%4000)"),
    ("DAYS_LAST_PHONE_CHANGE", "-(c_custkey*17%3000)"),
    ("CNT_CHILDREN", "c_custkey%4"),
    ("CNT_FAM_MEMBERS", "case when c_custkey%41=0 then null else c_custkey%4+1+c_custkey%2 end"),
    ("OWN_CAR_AGE", "case when c_custkey%3=0 then cast(c_custkey%25 as double) else null end"),
    ("EXT_SOURCE_1", "case when c_custkey%2=0 then null else cast(c_custkey*13%1000 as double)/1000 end"),
    ("EXT_SOURCE_2", "case when c_custkey%50=0 then null else (c_acctbal+1000)/11000 end"),
    ("EXT_SOURCE_3", "case when c_custkey%10<2 then null else cast(c_custkey*29%1000 as double)/1000 end"),
    ("CODE_GENDER", "case c_custkey%3 when 0 then 'M' else 'F' end"),
    ("NAME_INCOME_TYPE", "case when c_custkey%19=0 then null else c_mktsegment end"),
    ("NAME_EDUCATION_TYPE", "n_name"),
)

VIEWS = {
    "application_train": View(("customer", "nation"), _APPLICATION, on="c_nationkey = n_nationkey"),
    "applicants": View(
        ("customer", "nation"), (*_APPLICATION, ("name", "c_name")), on="c_nationkey = n_nationkey"
    ),
    "previous_application": View(
        ("orders",),
        (
            ("SK_ID_PREV", "o_orderkey"),
            ("SK_ID_CURR", "o_custkey"),
            ("AMT_APPLICATION", "case when o_orderkey%11=0 then 0e0 else o_totalprice end"),
            ("AMT_CREDIT", "case when o_orderkey%29=0 then null else o_totalprice*(8e-1+5e-2*(o_orderkey%8)) end"),
            (
                "NAME_CONTRACT_STATUS",
                "case o_orderstatus when 'F' then 'Approved' when 'O' then 'Canceled' else 'Refused' end",
            ),
            ("DAYS_DECISION", "DD(o_orderdate,2001-12-01)"),
        ),
    ),
    "installments_payments": View(
        ("lineitem", "orders"),
        (
            ("SK_ID_CURR", "o_custkey"),
            ("SK_ID_PREV", "l_orderkey"),
            ("DAYS_INSTALMENT", _DUE),
            ("DAYS_ENTRY_PAYMENT", f"case when l_partkey%37=0 then null else {_DUE}+l_partkey%9-5 end"),
            ("AMT_INSTALMENT", "l_extendedprice"),
            ("AMT_PAYMENT", "case when l_partkey%37=0 then null else l_extendedprice*(1-l_discount+l_tax) end"),
        ),
        on="l_orderkey = o_orderkey",
    ),
    "POS_CASH_balance": View(
        ("lineitem", "orders"),
        (
            # Every seventh customer's contracts belong to the next one, so that some have none.
            ("SK_ID_CURR", "case when o_custkey%7=0 then o_custkey+1 else o_custkey end"),
            ("SK_ID_PREV", "l_orderkey"),
            ("MONTHS_BALANCE", _SHIP_MONTH),
            ("SK_DPD", "cast(case when l_quantity>40 then l_quantity-40 else 0 end as int)"),
            ("SK_DPD_DEF", "cast(case when l_quantity>47 then l_quantity-47 else 0 end as int)"),
            (
                "NAME_CONTRACT_STATUS",
                "case l_returnflag when 'A' then 'Active' when 'R' then 'Completed' else 'Signed' end",
            ),
        ),
        on="l_orderkey = o_orderkey",
    ),
    "credit_card_balance": View(
        ("events",),
        (
            ("SK_ID_CURR", "user_id"),
            ("MONTHS_BALANCE", "DD(ts,2024-01-31)"),
            ("AMT_CREDIT_LIMIT_ACTUAL", "case when event_id%13=0 then 0e0 else 100e0 end"),
            ("AMT_BALANCE", "value"),
            ("SK_DPD", "case when event_type='error' then cast(floor(value/50) as int) else 0 end"),
            ("AMT_DRAWINGS_CURRENT", "case when event_id%31=0 then null else value/2 end"),
            ("AMT_INST_MIN_REGULARITY", "case when event_id%5=0 then 0e0 else 20e0 end"),
            ("AMT_PAYMENT_CURRENT", "case when event_type='view' then null else value/3 end"),
        ),
    ),
    "bureau": View(
        ("orders",),
        (
            # Every fifth customer's loans belong to the next one.
            ("SK_ID_CURR", "case when o_custkey%5=0 then o_custkey+1 else o_custkey end"),
            ("SK_ID_BUREAU", "o_orderkey"),
            ("AMT_CREDIT_SUM", "case when o_orderkey%29=0 then null else o_totalprice end"),
            ("CREDIT_DAY_OVERDUE", "case when o_orderkey%40=0 then o_orderkey%97 else 0 end"),
            ("AMT_CREDIT_SUM_DEBT", "case when o_orderkey%3=0 then null else o_totalprice*3e-1 end"),
            ("CREDIT_ACTIVE", "case o_orderstatus when 'F' then 'Closed' when 'O' then 'Active' else 'Sold' end"),
            ("DAYS_CREDIT", "DD(o_orderdate,2001-12-01)"),
        ),
    ),
    "bureau_balance": View(
        ("lineitem",),
        (
            # Balances of two neighbouring loans belong to the even one; odd loans have none.
            ("SK_ID_BUREAU", "l_orderkey-l_orderkey%2"),
            ("MONTHS_BALANCE", _SHIP_MONTH),
            (
                "STATUS",
                "case l_partkey%8 when 0 then '0' when 1 then '1' when 2 then '2' when 3 then '5'"
                " when 4 then 'X' else 'C' end",
            ),
        ),
    ),
    "users": View(
        ("supplier",),
        (
            ("id", "s_suppkey"),
            ("username", "s_name"),
            ("role", "case when s_suppkey=0 then 'admin' else 'loan_officer' end"),
        ),
    ),
    "predictions": View(
        ("orders",),
        (
            ("id", "o_orderkey"),
            # Every fourth customer's predictions belong to the next one, so that some wait without any.
            ("applicant_id", "case when o_custkey%4=0 then o_custkey+1 else o_custkey end"),
            ("officer_id", "o_custkey%10"),
            ("ts", "o_orderdate"),
            ("predicted_probability", "cast(o_orderkey*7919%1000 as double)/2000"),
        ),
    ),
    "decisions": View(
        ("lineitem",),
        (
            # Every third prediction stays open; its decisions belong to the next one, the last of which may not exist.
            ("prediction_id", "case when l_orderkey%3=0 then l_orderkey+1 else l_orderkey end"),
            ("officer_id", "case when l_suppkey%9=0 then -1 else l_suppkey end"),
            ("decision", "case l_returnflag when 'A' then 'approved' when 'R' then 'Declined' else 'escalated' end"),
            ("notes", "case when l_partkey%4=0 then null else l_linestatus end"),
            ("ts", "l_shipdate"),
            ("l_linenumber", "l_linenumber"),
            ("l_partkey", "l_partkey"),
        ),
    ),
    # Every applicant with a deterministic score: the cohort of the dashboards.
    "cohort": View(
        ("customer",),
        (
            ("applicant_id", "c_custkey"),
            ("target", _APPLICATION[1][1]),
            ("probability", "cast(c_custkey*7919%1000 as double)/2000"),
        ),
    ),
    # Deterministic score with labels, for the evaluation operators.
    "scored": View(
        ("orders",),
        (
            ("id", "o_orderkey"),
            ("p", "cast(o_orderkey*7919%1000 as double)/2000"),
            ("y", "case when o_orderkey%10<3 then 1 else 0 end"),
        ),
    ),
}

_DAYS = re.compile(r"DD\((\w+),([\d-]+)\)")


def _spark_expr(text: str) -> str:
    return _DAYS.sub(r"datediff(\1, date'\2')", text)


def _duck_expr(text: str) -> str:
    return _DAYS.sub(r"cast(date_diff('day', timestamp '\2', \1) as int)", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its declared schema, so that opening it starts no job."""
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shape(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Apply the view ``name`` to base DataFrames, batch or streaming."""
    view = VIEWS[name]
    df = tables[view.tables[0]]
    for other in view.tables[1:]:
        df = df.join(tables[other], F.expr(view.on))
    return df.selectExpr(*[f"{_spark_expr(e)} as {c}" for c, e in view.columns])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shape({t: table(spark, sf_dir, t) for t in VIEWS[name].tables}, name)


def view_sql(name: str) -> str:
    """The same view as SQL text for the oracle."""
    v = VIEWS[name]
    cols = ", ".join(f"{_duck_expr(e)} as {c}" for c, e in v.columns)
    source = v.tables[0] if len(v.tables) == 1 else f"{v.tables[0]} join {v.tables[1]} on {v.on}"
    return f"select {cols} from {source}"
