"""Audit-log, dashboard and lookup queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.functions import risk
from creditloom.functions.nulls import rounded
from creditloom.operators import audit, evaluate
from creditloom.plans.registry import query, r6, with_views
from creditloom.sources.views import table, view

LOG = ["decisions", "predictions", "applicants", "users"]
BAND = (
    "case when {p}>=25e-2 then '{a}' when {p}>=1e-1 then '{b}' else '{c}' end"
)


def band_sql(p, style="log"):
    a, b, c = risk.BAND_LABELS[style]
    return BAND.format(p=p, a=a, b=b, c=c)


@query(
    "J04, K02",
    with_views(
        LOG,
        """select prediction_id, decision, notes, d.ts as decision_time, applicant_id, predicted_probability,
 a.name as applicant_name, u.username as officer_name from decisions d join predictions p on d.prediction_id=p.id
 join applicants a on p.applicant_id=a.SK_ID_CURR left join users u on d.officer_id=u.id
 order by d.ts desc, prediction_id, l_linenumber, l_partkey, decision, d.officer_id, notes nulls last limit 5""",
    ),
)
def recent_decisions(spark, sf_dir):
    return audit.recent_activity(*[view(spark, sf_dir, v) for v in LOG])


_HISTORY = f"""select p.id as prediction_id, applicant_id, p.ts as pred_time, predicted_probability,
 {band_sql('predicted_probability')} as risk_label, {{columns}} from predictions p
 left join decisions d on d.prediction_id=p.id left join users u on d.officer_id=u.id"""


def _history(spark, sf_dir, **options):
    return audit.applicant_history(*[view(spark, sf_dir, v) for v in ("predictions", "decisions", "users")], **options)


@query(
    "J05, F05",
    with_views(
        LOG,
        _HISTORY.format(columns="decision, notes, d.ts as decision_time, u.username as officer_name"),
    ),
)
def applicant_histories(spark, sf_dir):
    return _history(spark, sf_dir)


@query(
    "J05",
    with_views(
        LOG,
        _HISTORY.format(
            columns="coalesce(nullif(decision,''),'Awaiting decision') as decision, coalesce(notes,'') as notes,"
            " coalesce(cast(d.ts as varchar),'') as decision_time, coalesce(u.username,'') as officer_name"
        ),
    ),
)
def applicant_histories_filled(spark, sf_dir):
    return _history(spark, sf_dir, defaults=True)


@query(
    "J06",
    with_views(
        LOG,
        """select d.officer_id, prediction_id, decision, notes, d.ts as decision_time, applicant_id,
 predicted_probability, p.ts as pred_time, a.name as applicant_name from decisions d
 join predictions p on d.prediction_id=p.id join applicants a on p.applicant_id=a.SK_ID_CURR""",
    ),
)
def officer_activities(spark, sf_dir):
    return audit.officer_activity(*[view(spark, sf_dir, v) for v in ("decisions", "predictions", "applicants")])


@query(
    "J05",
    with_views(
        LOG,
        "select *, row_number() over (order by pred_time desc, prediction_id, decision_time nulls last, decision nulls last,"
        " notes nulls last, officer_name nulls last)::int as place from ("
        + _HISTORY.format(columns="decision, notes, d.ts as decision_time, u.username as officer_name")
        + " where applicant_id=1) order by place limit 20",
    ),
)
def one_applicant_history(spark, sf_dir):
    return _history(spark, sf_dir, applicant_id=1)


@query(
    "J06",
    with_views(
        LOG,
        """select *, row_number() over (order by decision_time desc, prediction_id, decision nulls last, notes nulls last)::int as place
 from (select d.officer_id, prediction_id, decision, notes, d.ts as decision_time, applicant_id,
 predicted_probability, p.ts as pred_time, a.name as applicant_name from decisions d
 join predictions p on d.prediction_id=p.id join applicants a on p.applicant_id=a.SK_ID_CURR where d.officer_id=2) order by place limit 20""",
    ),
)
def one_officer_activity(spark, sf_dir):
    return audit.officer_activity(*[view(spark, sf_dir, v) for v in ("decisions", "predictions", "applicants")], officer_id=2)


PENDING_CTES = [
    "decided as (select distinct p.applicant_id from predictions p join decisions d on d.prediction_id=p.id)",
    f"""pending as (select c.applicant_id, coalesce(a.name,'Unknown Applicant') as name, c.target, probability,
 {band_sql('probability', 'report')} as risk_classification,
 case when probability>=15e-2 then 'High Risk' else 'Safe' end as risk_group
 from cohort c left join applicants a on a.SK_ID_CURR=c.applicant_id
 where c.applicant_id not in (select applicant_id from decided))""",
]
PENDING_VIEWS = ["cohort", "predictions", "decisions", "applicants"]


def _pending(spark, sf_dir):
    return audit.pending_cases(*[view(spark, sf_dir, v) for v in PENDING_VIEWS])


@query("J07, J10", with_views(PENDING_VIEWS, "select * from pending", PENDING_CTES))
def pending_applicants(spark, sf_dir):
    return _pending(spark, sf_dir)


@query("K02", with_views(PENDING_VIEWS, "select * from pending order by applicant_id limit 5", PENDING_CTES))
def first_pending_applicants(spark, sf_dir):
    return audit.first_pending(_pending(spark, sf_dir))


@query(
    "G16",
    with_views(
        PENDING_VIEWS,
        f"""select (select count(*) from applicants) as total_applicants,
 (select count(*) from decisions) as total_decisions,
 (select count(*) from decisions where decision='approved') as total_approved,
 (select count(*) from decisions where decision='declined') as total_rejected,
 (select count(*) from pending) as total_pending,
 {r6('(select coalesce(avg(probability),0) from pending)', 'avg_risk_pending')}""",
        PENDING_CTES,
    ),
)
def home_dashboard(spark, sf_dir):
    return rounded(
        audit.home_stats(
            view(spark, sf_dir, "applicants"), view(spark, sf_dir, "decisions"), _pending(spark, sf_dir)
        )
    )


DECISION_STATS = """count(*) as total_decisions, count(*) filter (where lower(decision)='approved') as approved_count,
 count(*) filter (where lower(decision)='declined') as declined_count,
 count(*) filter (where lower(decision)='escalated') as escalated_count,
 count(*) filter (where over) as overrides_count,
 floor(coalesce(count(*) filter (where over)/nullif(count(*),0),0)*1e6+5e-1)/1e6 as override_rate"""
JOINED_CTE = """joined as (select d.*, predicted_probability, (lower(decision)='approved' and
 predicted_probability>=15e-2) or (lower(decision)='declined' and predicted_probability<15e-2) as over
 from decisions d join predictions p on d.prediction_id=p.id)"""


@query("G17", with_views(["decisions", "predictions"], f"select {DECISION_STATS} from joined", [JOINED_CTE]))
def decision_statistics(spark, sf_dir):
    return rounded(audit.decision_stats(view(spark, sf_dir, "decisions"), view(spark, sf_dir, "predictions")))


@query(
    "G18",
    with_views(
        ["cohort"],
        """select count(*) filter (where probability<15e-2) as approved,
 round(count(*) filter (where probability<15e-2)*100/count(*), 1) as approved_pct,
 count(*) filter (where probability>=15e-2) as rejected,
 round(count(*) filter (where probability>=15e-2)*100/count(*), 1) as rejected_pct,
 count(*) filter (where target=1) as defaults, round(count(*) filter (where target=1)*100/count(*), 1) as defaults_pct
 from cohort""",
    ),
)
def cohort_headline(spark, sf_dir):
    return audit.cohort_header(view(spark, sf_dir, "cohort"))


@query(
    "C15",
    with_views(["cohort"], "select * from cohort where probability>=15e-2 and cast(applicant_id as varchar) like '%7%'"),
)
def cohort_high_risk(spark, sf_dir):
    return audit.cohort_view(view(spark, sf_dir, "cohort"), "high-risk", "7", "prob-desc")


@query("C15", with_views(["cohort"], "select * from cohort where target=1"))
def cohort_defaults(spark, sf_dir):
    return audit.cohort_view(view(spark, sf_dir, "cohort"), "defaults", "", "prob-asc")


@query("C15", with_views(["cohort"], "select *, row_number() over (order by probability, applicant_id)::int as place from cohort where probability<15e-2 order by place limit 50"))
def cohort_approved(spark, sf_dir):
    """The first screen of the approved, lowest risk first, with its order."""
    return _first_screen(audit.cohort_view(view(spark, sf_dir, "cohort"), "approved", "", "prob-asc"), "probability", "applicant_id")


@query("C15", with_views(["cohort"], "select *, row_number() over (order by applicant_id)::int as place from cohort where probability>=15e-2 and cast(applicant_id as varchar) like '%3%' order by place limit 50"))
def cohort_rejected(spark, sf_dir):
    """The first screen of the rejected with a 3 in their id, by id."""
    return _first_screen(audit.cohort_view(view(spark, sf_dir, "cohort"), "rejected", "3", "id-asc"), "applicant_id")


def _first_screen(sorted_rows, *order, n=50):
    return sorted_rows.limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("K01, C15", with_views(["cohort"], "select * from cohort"))
def cohort_by_risk(spark, sf_dir):
    return audit.cohort_view(view(spark, sf_dir, "cohort"))


@query(
    "F05, F06, F07, F08",
    with_views(
        ["cohort", "application_train"],
        f"""select applicant_id, {band_sql('probability')} as risk_label,
 {band_sql('probability', 'report')} as risk_classification, {band_sql('probability', 'table')} as risk_badge,
 case when probability>=15e-2 then 1 else 0 end as prediction,
 case when probability>=15e-2 then 'Rejected' else 'Approved' end as decision,
 case when probability>=15e-2 then 'High Risk' else 'Safe' end as risk_group,
 round(abs(DAYS_BIRTH)/365.25e0, 1) as age_years,
 case when DAYS_EMPLOYED<0 then round(abs(DAYS_EMPLOYED)/365.25e0, 1) else 0e0 end as employed_years,
 case c.target when 0 then 'Paid' when 1 then 'Defaulted' else 'Unknown' end as repayment_status
 from cohort c join application_train a on a.SK_ID_CURR=c.applicant_id""",
    ),
)
def risk_labels(spark, sf_dir):
    p = F.col("probability")
    app = view(spark, sf_dir, "application_train").select(
        F.col("SK_ID_CURR").alias("applicant_id"), "DAYS_BIRTH", "DAYS_EMPLOYED"
    )
    return (
        view(spark, sf_dir, "cohort")
        .join(app, "applicant_id")
        .select(
            "applicant_id",
            risk.risk_band(p).alias("risk_label"),
            risk.risk_band(p, "report").alias("risk_classification"),
            risk.risk_band(p, "table").alias("risk_badge"),
            risk.prediction(p).alias("prediction"),
            risk.decision(p).alias("decision"),
            risk.risk_group(p).alias("risk_group"),
            risk.years_from_days(F.col("DAYS_BIRTH")).alias("age_years"),
            risk.years_employed(F.col("DAYS_EMPLOYED")).alias("employed_years"),
            risk.repayment_status(F.col("target")).alias("repayment_status"),
        )
    )


@query("F13", with_views(["users"], "select id, lower(trim('  ' || username || ' ')) as username from users"))
def normalized_usernames(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("username"), F.lit(" "))
    return view(spark, sf_dir, "users").select("id", risk.normal_key(padded).alias("username"))


def _search_sql(mode: str, prefix: str, inside: str) -> str:
    return (
        f"(select '{mode}' as mode, SK_ID_CURR as applicant_id, name, TARGET as target from applicants"
        f" where cast(SK_ID_CURR as varchar) ilike '{prefix}' escape '!' or name ilike '{inside}' escape '!' order by SK_ID_CURR limit 6)"
    )


@query(
    "C13",
    with_views(
        ["applicants"],
        " union all ".join([_search_sql("parity", "1_%", "%1_%"), _search_sql("safe", "1!_%", "%1!_%"), _search_sql("plain", "12%", "%12%")]),
    ),
)
def applicant_search(spark, sf_dir):
    """One text looked for in ids and names: with a wildcard in it, with the same text taken literally, and without one."""
    applicants = view(spark, sf_dir, "applicants")
    found = None
    for mode, text in (("parity", "1_"), ("safe", "1_"), ("plain", "12")):
        part = audit.search_applicants(applicants, text, mode="safe" if mode == "safe" else "parity")
        part = part.select(F.lit(mode).alias("mode"), "*")
        found = part if found is None else found.union(part)
    return found


LOOKUP = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "EXT_SOURCE_2", "DAYS_BIRTH", "CNT_CHILDREN"]


@query(
    "C14",
    with_views(
        ["applicants"],
        "select SK_ID_CURR as applicant_id, name, TARGET as target, f.feature, f.value from applicants,"
        f" unnest([{', '.join(f'''{{'feature': '{c}', 'value': cast({c} as double)}}''' for c in LOOKUP)}]) u(f)",
    ),
)
def applicant_lookup(spark, sf_dir):
    found = audit.lookup_applicants(view(spark, sf_dir, "applicants"), LOOKUP)
    return found.select("applicant_id", "name", "target", F.explode("features").alias("feature", "value"))


@query(
    "W03",
    "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id"
    " order by turn desc, role, text) as rn from conversations) where rn<=20",
)
def conversation_tails(spark, sf_dir):
    return audit.conversation_tail(table(spark, sf_dir, "conversations"))


_IDS = "select applicant_id from cohort where probability>=25e-2"


@query(
    "J08",
    with_views(["application_train", "cohort"], f"select SK_ID_CURR, AMT_CREDIT from application_train where SK_ID_CURR in ({_IDS})"),
)
def rows_of_cohort(spark, sf_dir):
    ids = view(spark, sf_dir, "cohort").where("probability >= 0.25").select(F.col("applicant_id").alias("SK_ID_CURR"))
    return view(spark, sf_dir, "application_train").select("SK_ID_CURR", "AMT_CREDIT").join(ids, "SK_ID_CURR", "left_semi")


@query(
    "J09",
    with_views(
        ["application_train", "cohort"],
        f"select SK_ID_CURR, AMT_CREDIT from application_train where SK_ID_CURR not in ({_IDS})",
    ),
)
def rows_outside_cohort(spark, sf_dir):
    ids = view(spark, sf_dir, "cohort").where("probability >= 0.25").select(F.col("applicant_id").alias("SK_ID_CURR"))
    return view(spark, sf_dir, "application_train").select("SK_ID_CURR", "AMT_CREDIT").join(ids, "SK_ID_CURR", "left_anti")


@query(
    "J12",
    with_views(
        ["application_train", "cohort"],
        "select SK_ID_CURR, AMT_CREDIT, EXT_SOURCE_2, c.target as label from application_train a"
        " join cohort c on a.SK_ID_CURR=c.applicant_id",
    ),
)
def labels_aligned(spark, sf_dir):
    labels = view(spark, sf_dir, "cohort").select(F.col("applicant_id").alias("SK_ID_CURR"), F.col("target").alias("label"))
    return view(spark, sf_dir, "application_train").select("SK_ID_CURR", "AMT_CREDIT", "EXT_SOURCE_2").join(labels, "SK_ID_CURR")


_LATE_LOG = (
    "select prediction_id, decision, notes, ts,"
    " case when l_partkey%5=0 then -prediction_id else prediction_id end as pid from decisions"
)


@query(
    "S11",
    with_views(
        ["decisions", "predictions"],
        f"""select pid as prediction_id, decision, notes, d.ts,
 case when p.id is null then 'rejected' else 'accepted' end as outcome
 from ({_LATE_LOG}) d left join predictions p on p.id=d.pid""",
    ),
)
def decision_appends(spark, sf_dir):
    """Every fifth part number stands for a mistyped prediction id."""
    typed = F.when(F.col("l_partkey") % 5 == 0, -F.col("prediction_id")).otherwise(F.col("prediction_id"))
    proposed = view(spark, sf_dir, "decisions").select(typed.alias("prediction_id"), "decision", "notes", "ts")
    accepted, rejected = audit.accept_decisions(proposed, view(spark, sf_dir, "predictions"))
    return accepted.withColumn("outcome", F.lit("accepted")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected"))
    )


@query(
    "S12",
    with_views(
        ["predictions"],
        """select id, applicant_id, predicted_probability,
 case when officer_id<5 then null else 'p=' || cast(id as varchar) end as narration from predictions""",
    ),
)
def log_with_added_column(spark, sf_dir):
    log = view(spark, sf_dir, "predictions")
    columns = ["id", "applicant_id", "predicted_probability"]
    old = log.where("officer_id < 5").select(*columns)
    new = log.where("officer_id >= 5").select(
        *columns, F.concat(F.lit("p="), F.col("id").cast("string")).alias("narration")
    )
    return audit.add_missing_columns(old, new)


@query(
    "G21",
    with_views(
        ["applicants", "cohort", "scored"],
        f"""select 15e-2 as threshold, (select count(*) from applicants) as total_applicants,
 (select count(*) from cohort) as sample_size,
 {r6('count(*) filter (where p>=15e-2 and y=1)/count(*) filter (where p>=15e-2)', 'precision')},
 {r6('count(*) filter (where p>=15e-2 and y=1)/count(*) filter (where y=1)', 'recall')} from scored""",
    ),
)
def platform_overview(spark, sf_dir):
    metrics = evaluate.confusion(view(spark, sf_dir, "scored"), 0.15).select(
        F.lit(0.15).alias("threshold"), "precision", "recall"
    )
    return rounded(
        audit.platform_summary(view(spark, sf_dir, "applicants"), view(spark, sf_dir, "cohort"), metrics)
    )
