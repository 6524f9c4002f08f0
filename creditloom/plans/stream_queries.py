"""Streams run to the end of their input, next to batch oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.functions.nulls import rounded
from creditloom.operators.clean import MEDIAN_COLUMNS, flag_unknown_employment, impute
from creditloom.operators.features.interactions import ratio_features
from creditloom.operators.order_stats import medians
from creditloom.plans.audit_queries import DECISION_STATS, JOINED_CTE, band_sql
from creditloom.plans.explain_queries import APP, CTES, scorecard
from creditloom.plans.registry import query, r6, with_views
from creditloom.sources.views import shape, table, view
from creditloom.streaming import jobs
from creditloom.streaming.tables import appended, latest_complete, latest_update, run_to_table, table_stream

@query(
    "T01",
    with_views(
        APP,
        f"""select SK_ID_CURR, {r6('probability')}, case when probability>=15e-2 then 1 else 0 end as prediction,
 case when probability>=15e-2 then 'Rejected' else 'Approved' end as decision, {band_sql('probability')} as risk_label
 from score""",
        CTES,
    ),
)
def scored_stream(spark, sf_dir):
    """Applicants arrive as a stream and get the scores of ``linear_scores``."""
    history = flag_unknown_employment(view(spark, sf_dir, "application_train"))
    middle = medians(history, MEDIAN_COLUMNS)
    model = scorecard(ratio_features(impute(history, middle)))
    tables = {"customer": table_stream(spark, sf_dir, "customer"), "nation": table(spark, sf_dir, "nation")}
    arriving = shape(tables, "application_train")
    path = run_to_table(jobs.score_stream(arriving, model, middle), "append", "scored-stream")
    return rounded(appended(spark, path))


def _decision_stream(spark, sf_dir):
    return shape({"lineitem": table_stream(spark, sf_dir, "lineitem")}, "decisions")


@query("T02", with_views(["decisions", "predictions"], f"select {DECISION_STATS} from joined", [JOINED_CTE]))
def decision_statistics_stream(spark, sf_dir):
    totals = jobs.decision_stream_totals(_decision_stream(spark, sf_dir), view(spark, sf_dir, "predictions"))
    return rounded(latest_complete(spark, run_to_table(totals, "complete", "decision-totals")))


@query(
    "T03",
    with_views(
        ["decisions"],
        """select timestamp '1970-01-01' + to_days(cast(floor(epoch(ts)/86400/30)*30 as int)) as window_start, officer_id,
 count(*) as decisions, count(*) filter (where lower(decision)='approved') as approved
 from decisions group by 1, 2""",
    ),
)
def officer_windows_stream(spark, sf_dir):
    path = run_to_table(jobs.officer_windows(_decision_stream(spark, sf_dir)), "update", "officer-windows")
    return latest_update(spark, path, ["window_start", "officer_id"])


_DAY = "cast(floor(epoch(ts)/86400) as bigint)"


@query(
    "T04",
    with_views(
        [],
        f"""select window_start, SK_ID_CURR, n, max_dpd, {r6('dpd_slope')},
 case when dpd_slope>5e-2 then 1 else 0 end as warning from slopes""",
        [
            f"""placed as (select user_id as SK_ID_CURR, cast(floor({_DAY}/7)*7 - 7*k as bigint) as first_day,
 {_DAY} as d, case when event_type='error' then cast(floor(value/50) as int) else 0 end as y
 from events, range(2) t(k))""",
            """sums as (select SK_ID_CURR, first_day, count(*) as n, max(y) as max_dpd, min(d) as lo, max(d) as hi,
 sum(d-first_day) as sx, sum(y) as sy, sum((d-first_day)*y) as sxy, sum((d-first_day)*(d-first_day)) as sxx
 from placed group by 1, 2)""",
            """slopes as (select timestamp '1970-01-01' + to_days(cast(first_day as int)) as window_start, SK_ID_CURR, n,
 max_dpd, case when n<2 or lo=hi then 0e0 else (sxy/n-(sx/n)*(sy/n))/(sxx/n-(sx/n)*(sx/n)+1e-9) end as dpd_slope
 from sums)""",
        ],
    ),
)
def delinquency_warning_stream(spark, sf_dir):
    events = table_stream(spark, sf_dir, "events")
    dpd = F.when(F.col("event_type") == "error", F.floor(F.col("value") / 50).cast("int")).otherwise(0)
    balances = events.select(F.col("user_id").alias("SK_ID_CURR"), "ts", dpd.alias("SK_DPD"))
    path = run_to_table(jobs.delinquency_warnings(balances), "update", "delinquency")
    return rounded(latest_update(spark, path, ["window_start", "SK_ID_CURR"]))
