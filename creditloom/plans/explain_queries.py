"""Explanation queries over a fixed linear scorecard."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creditloom.functions.catalog import DESCRIPTIONS, DISPLAY_NAMES, display_name
from creditloom.functions.nulls import rounded
from creditloom.functions.text import narration
from creditloom.operators import audit, explain
from creditloom.operators.clean import clean_application, coerce_numeric
from creditloom.operators.encode import baseline_means
from creditloom.operators.features.interactions import ratio_features
from creditloom.plans.audit_queries import band_sql
from creditloom.plans.feature_queries import CLEAN_CTES, RATIO_SQL
from creditloom.plans.registry import query, r6, with_views
from creditloom.session import scratch_path
from creditloom.sources import tables
from creditloom.sources.views import view

INTERCEPT = 1.2
COEFFICIENTS = {
    "EXT_SOURCE_1": -1.4,
    "EXT_SOURCE_2": -2.6,
    "EXT_SOURCE_3": -2.2,
    "AMT_CREDIT": 4e-7,
    "AMT_ANNUITY": 9e-6,
    "AMT_INCOME_TOTAL": -2e-6,
    "DAYS_EMPLOYED": 5e-5,
    "DAYS_BIRTH": 2e-5,
    "OWN_CAR_AGE": 1.5e-2,
    "CNT_CHILDREN": 6e-2,
    "CREDIT_INCOME_RATIO": 3e-2,
    "CREDIT_TERM": -2e-2,
}
FEATURES = list(COEFFICIENTS)


def scorecard_rows(spark, sf_dir):
    return ratio_features(clean_application(view(spark, sf_dir, "application_train")))


def scorecard(df):
    means = baseline_means(df, FEATURES).first().asDict()
    return explain.LinearModel(INTERCEPT, COEFFICIENTS, means)


def explained(spark, sf_dir):
    df = scorecard_rows(spark, sf_dir)
    return explain.explain(df, scorecard(df))


def contributions(spark, sf_dir):
    df = scorecard_rows(spark, sf_dir)
    return explain.contribution_columns(df, scorecard(df))


APP = ["application_train"]


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


COEFFICIENT_SQL = {c: repr(b) if "e" in repr(b) else f"{b!r}e0" for c, b in COEFFICIENTS.items()}
_PER_FEATURE = " union all ".join(
    f"select SK_ID_CURR, {i} as pos, '{c}' as feature, {quoted(display_name(c))} as display_name,"
    f" coalesce({COEFFICIENT_SQL[c]}*({c}-(select avg({c}) from sc)), 0e0) as shap_value,"
    f" cast({c} as double) as feature_value from sc"
    for i, c in enumerate(FEATURES)
)
BASE_SQL = "1.2e0+" + "+".join(f"({COEFFICIENT_SQL[c]})*(select avg({c}) from sc)" for c in FEATURES)
CTES = [
    *CLEAN_CTES,
    f"sc as (select *, {RATIO_SQL} from app)",
    f"long as ({_PER_FEATURE})",
    "ranked as (select *, row_number() over (partition by SK_ID_CURR order by abs(shap_value) desc, pos) as rk from long)",
    f"base as (select {BASE_SQL} as base_value)",
    """score as (select SK_ID_CURR, base_value, 1/(1+exp(-(base_value+sum(shap_value)))) as probability
 from long, base group by SK_ID_CURR, base_value)""",
]


@query(
    "M14",
    with_views(APP, f"select SK_ID_CURR, feature, {r6('shap_value')}, {r6('feature_value')} from long", CTES),
)
def linear_contributions(spark, sf_dir):
    long = explain.factors_long(explained(spark, sf_dir))
    return rounded(long.select("SK_ID_CURR", "feature", "shap_value", "feature_value"))


@query(
    "M05, M14, F06",
    with_views(
        APP,
        f"""select SK_ID_CURR, {r6('base_value')}, {r6('probability')},
 case when probability>=15e-2 then 'Rejected' else 'Approved' end as decision from score""",
        CTES,
    ),
)
def linear_scores(spark, sf_dir):
    from creditloom.functions.risk import decision

    scored = explained(spark, sf_dir).select("SK_ID_CURR", "base_value", "probability")
    return rounded(scored.withColumn("decision", decision(F.col("probability"))))


@query(
    "W09",
    with_views(
        APP,
        f"select SK_ID_CURR, cast(rk as int) as rank, feature, display_name, {r6('shap_value')},"
        f" {r6('feature_value')} from ranked where rk<=10",
        CTES,
    ),
)
def top_factors(spark, sf_dir):
    return rounded(explain.factors_long(explained(spark, sf_dir), top=10))


@query(
    "C18",
    with_views(
        APP,
        "select * from ("
        + " union all ".join(
            f"select SK_ID_CURR, '{c}' as feature, {r6(f'cast({c} as double)', 'value')} from sc" for c in FEATURES
        )
        + ")",
        CTES[: len(CLEAN_CTES) + 1],
    ),
)
def unpivoted_features(spark, sf_dir):
    df = scorecard_rows(spark, sf_dir).select("SK_ID_CURR", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return rounded(df.unpivot("SK_ID_CURR", FEATURES, "feature", "value"))


@query(
    "G19, K02",
    with_views(
        APP,
        f"select feature, {r6('avg(abs(shap_value))', 'importance')} from long group by feature"
        " order by avg(abs(shap_value)) desc limit 30",
        CTES,
    ),
)
def global_importance(spark, sf_dir):
    return rounded(explain.global_importance(contributions(spark, sf_dir), FEATURES, top=30))


@query(
    "G20",
    with_views(
        APP,
        f"""select feature, {r6('count(*) filter (where shap_value>1e-4)*100/count(*)', 'increased_pct')},
 {r6('count(*) filter (where shap_value<-1e-4)*100/count(*)', 'decreased_pct')},
 {r6('count(*) filter (where abs(shap_value)<=1e-4)*100/count(*)', 'neutral_pct')} from long group by feature""",
        CTES,
    ),
)
def impact_shares(spark, sf_dir):
    return rounded(explain.impact_summary(contributions(spark, sf_dir), FEATURES))


@query(
    "W07",
    with_views(
        APP,
        f"""select SK_ID_CURR, feature, {r6('feature_value')},
 {r6('coalesce((feature_value-lo)/case when hi=lo then 1 else hi-lo end, 5e-1)', 'normalized_value')}
 from long join (select feature, min(feature_value) as lo, max(feature_value) as hi from long group by feature) e
 using (feature)""",
        CTES,
    ),
)
def normalized_feature_values(spark, sf_dir):
    return rounded(explain.normalized_values(scorecard_rows(spark, sf_dir), FEATURES))


WATERFALL_CTES = [
    *CTES,
    """steps as (select SK_ID_CURR, 0 as step, 'base' as type, 'BASE_VALUE' as feature,
 'Baseline (Average Risk)' as label, base_value as value from score union all
 select SK_ID_CURR, rk, 'contrib', feature, display_name, shap_value from ranked where rk<=6 union all
 select SK_ID_CURR, 7, 'contrib', 'OTHER_FEATURES', 'Other Factors', sum(shap_value) from ranked where rk>6
 group by SK_ID_CURR having sum(shap_value)<>0)""",
    """run as (select *, sum(value) over (partition by SK_ID_CURR order by step) as upto from steps)""",
    """fall as (select SK_ID_CURR, cast(step as int) as step, type, feature, label,
 case when type='base' then 0e0 else upto-value end as start, upto as "end", value from run union all
 select SK_ID_CURR, cast(count(*) as int), 'final', 'FINAL_PREDICTION', 'Final Score Prediction', 0e0, sum(value),
 sum(value) from steps group by SK_ID_CURR)""",
]


@query(
    "W08",
    with_views(
        APP,
        f"select SK_ID_CURR, step, type, feature, label, {r6('start')}, {r6('''"end"''')}, {r6('value')} from fall",
        WATERFALL_CTES,
    ),
)
def waterfall_steps(spark, sf_dir):
    return rounded(explain.waterfall(explained(spark, sf_dir)))


def _has(words):
    return "(" + " or ".join(f"feature like '%{w.replace('_', '!_')}%' escape '!'" for w in words) + ")"


VALUE_TEXT = f"""case when feature_value is null then 'N/A'
 when {_has(['RATIO', 'RATE'])} then format('{{:.1f}}%', feature_value*100)
 when {_has(['DAYS_EMPLOYED'])} then case when feature_value<0
 then cast(cast(floor(abs(feature_value)) as bigint) as varchar) || ' days of employment' else 'unemployed' end
 when {_has(['PRICE', 'CREDIT', 'ANNUITY', 'INCOME'])} then '$' || format('{{:,.2f}}', feature_value)
 else format('{{:.2f}}', feature_value) end"""


@query(
    "F09",
    with_views(
        APP,
        f"""select SK_ID_CURR, cast(rk as int) as rank, '- ' || display_name || ' = ' || {VALUE_TEXT} || ' (' ||
 case when shap_value>0 then 'increases risk' else 'decreases risk' end || ' by ' ||
 format('{{:.4f}}', abs(shap_value)) || ')' as line from ranked where rk<=6""",
        CTES,
    ),
)
def factor_lines(spark, sf_dir):
    return explain.factor_lines(explained(spark, sf_dir))


NARRATION_CTES = [
    *CTES,
    f"""parts as (select *, case feature when 'EXT_SOURCE_2' then 'A' when 'EXT_SOURCE_3' then 'B'
 when 'EXT_SOURCE_1' then 'C' end as letter, case
 when {_has(['RATIO', 'RATE', 'DELAY', 'AMT', 'COUNT', 'AGE'])} then case when shap_value>0 then 'high ' else 'low ' end
 when {_has(['DAYS_EMPLOYED'])} then case when shap_value>0 then 'short ' else 'stable ' end
 else case when shap_value>0 then 'high ' else 'low ' end end as prefix from ranked where rk<=3)""",
    """phrase as (select SK_ID_CURR, case when sum(shap_value)>0 then 'low ' else 'high ' end || case count(*)
 when 1 then 'Credit Bureau Score ' || min(letter) when 2 then 'Credit Bureau Scores ' || min(letter) || ' and ' ||
 max(letter) else 'Credit Bureau Scores A, B and C' end as txt, 0 as rk from parts where letter is not null
 group by SK_ID_CURR union all
 select SK_ID_CURR, 'a ' || prefix || display_name, rk from parts where letter is null)""",
    """driver as (select SK_ID_CURR, array_agg(txt order by rk) as d from phrase group by SK_ID_CURR)""",
]


@query(
    "F10, S10",
    with_views(
        APP,
        f"""select SK_ID_CURR, 'This applicant has a ' || format('{{:.1f}}', probability*100) ||
 '% predicted default probability, placing them in the ' || {band_sql('probability', 'report')} || ' category. ' ||
 case len(d) when 1 then 'The primary driver is ' || d[1] || '.'
 when 2 then 'The primary drivers are ' || d[1] || ', and ' || d[2] || '.'
 else 'The primary drivers are ' || d[1] || ', ' || d[2] || ', and ' || d[3] || '.' end as narration
 from score join driver using (SK_ID_CURR)""",
        NARRATION_CTES,
    ),
)
def narrations(spark, sf_dir):
    return explained(spark, sf_dir).select(
        "SK_ID_CURR", narration(F.col("probability"), F.col("explanation")).alias("narration")
    )


@query(
    "S09, S10",
    with_views(
        APP,
        f"""select SK_ID_CURR as applicant_id, {band_sql('probability')} as risk_label,
 {r6('probability', 'predicted_probability')}, feature, {r6('shap_value')}
 from score join long using (SK_ID_CURR)""",
        CTES,
    ),
)
def prediction_log(spark, sf_dir):
    """Two appends to a table with declared types; the JSON in it, read back as one row per feature."""
    scored = explained(spark, sf_dir).select(
        F.col("SK_ID_CURR").alias("applicant_id"),
        F.lit(0).alias("officer_id"),
        F.col("probability").alias("predicted_probability"),
        "explanation",
    )
    records = audit.prediction_records(scored, explain.shap_map("explanation")).drop("explanation")
    name = f"prediction_log_{uuid.uuid4().hex}"
    tables.create_typed_table(records, name, "applicant_id", scratch_path(spark, "prediction-log"))
    for part in ("applicant_id % 2 = 0", "applicant_id % 2 <> 0"):
        tables.append_rows(records.where(part), name)
    log = spark.table(name)
    read = F.from_json("shap_values", "map<string,double>")
    return rounded(
        log.select(
            "applicant_id", "risk_label", "predicted_probability", F.explode(read).alias("feature", "shap_value")
        )
    )


DICTIONARY_CTE = (
    "dict(feature, display_name, description) as (values "
    + ", ".join(f"({quoted(f)}, {quoted(n)}, {quoted(DESCRIPTIONS[f])})" for f, n in DISPLAY_NAMES.items())
    + ")"
)
WORDS = """array_to_string(list_transform(string_split(lower(replace(g.feature,'_',' ')),' '),
 lambda w: upper(w[1]) || w[2:]), ' ')"""
NAMED_CTES = [
    *CTES,
    DICTIONARY_CTE,
    "g as (select feature, avg(abs(shap_value)) as importance from long group by feature)",
    f"""named as (select g.feature, importance, coalesce(dict.display_name, {WORDS}) as display_name,
 coalesce(description, 'SHAP explanation factor for ' || {WORDS} || '.') as description
 from g left join dict on g.feature=dict.feature)""",
]


@query(
    "J11, F11",
    with_views(APP, f"select feature, {r6('importance')}, display_name, description from named", NAMED_CTES),
)
def importance_with_names(spark, sf_dir):
    table = explain.global_importance(contributions(spark, sf_dir), FEATURES, top=None)
    return rounded(explain.with_display_names(table))


@query(
    "C16",
    with_views(
        APP,
        f"select feature, {r6('importance')}, display_name, description from named"
        " where lower(display_name) like '%credit%' or lower(feature) like '%credit%'",
        NAMED_CTES,
    ),
)
def glossary_search(spark, sf_dir):
    table = explain.global_importance(contributions(spark, sf_dir), FEATURES, top=None)
    return rounded(explain.glossary(table, "credit"))


@query(
    "C17",
    with_views(
        APP,
        f"""select SK_ID_CURR, {r6("try_cast(t as double)", "OWN_CAR_AGE")} from (select SK_ID_CURR,
 case when SK_ID_CURR%5=0 then 'n/a' else cast(OWN_CAR_AGE as varchar) end as t from application_train)""",
    ),
)
def coerced_numbers(spark, sf_dir):
    """Every fifth age is replaced by text, which must come out as missing."""
    age = F.when(F.col("SK_ID_CURR") % 5 == 0, "n/a").otherwise(F.col("OWN_CAR_AGE").cast("string"))
    df = view(spark, sf_dir, "application_train").select("SK_ID_CURR", age.alias("OWN_CAR_AGE"))
    return rounded(coerce_numeric(df, ["OWN_CAR_AGE"]))


@query(
    "C19",
    with_views(
        APP,
        f"""select SK_ID_CURR, cast(rn-1 as bigint) as position, {r6('EXT_SOURCE_2')} from (select *,
 row_number() over (order by SK_ID_CURR) as rn from application_train) where (rn-1)%5=0""",
    ),
)
def every_fifth_row(spark, sf_dir):
    from creditloom.operators.order_stats import running_totals

    df = view(spark, sf_dir, "application_train").select("SK_ID_CURR", "EXT_SOURCE_2")
    indexed = running_totals(df, "SK_ID_CURR", {"rn": F.lit(1).cast("long")})
    position = F.col("rn") - 1
    return rounded(indexed.where(position % 5 == 0).select("SK_ID_CURR", position.alias("position"), "EXT_SOURCE_2"))
