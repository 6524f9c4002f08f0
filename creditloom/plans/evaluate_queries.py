"""Evaluation queries over the deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.functions.nulls import rounded
from creditloom.functions.risk import sigmoid
from creditloom.operators import evaluate
from creditloom.operators.sampling import split_and_folds, stratified_cut, stratified_split
from creditloom.plans.registry import query, r6, with_views
from creditloom.sources.views import view

S = ["scored"]
CONF_CTE = """conf as (select count(*) filter (where p>=15e-2 and y=1) as tp,
 count(*) filter (where p>=15e-2 and y=0) as fp, count(*) filter (where p<15e-2 and y=0) as tn,
 count(*) filter (where p<15e-2 and y=1) as fn from scored)"""
BY_SCORE = "by_score as (select p, count(*) filter (where y=1) as pos, count(*) filter (where y=0) as neg from scored group by p)"
CUM = """cum as (select p, pos, neg, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp,
 sum(pos) over () as np, sum(neg) over () as nn from by_score)"""


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


@query(
    "M16",
    with_views(
        S,
        f"""select tp, fp, tn, fn, {r6('(tp+tn)/(tp+fp+tn+fn)', 'accuracy')}, {r6('tp/(tp+fp)', 'precision')},
 {r6('tp/(tp+fn)', 'recall')}, {r6('2*tp/(2*tp+fp+fn)', 'f1')} from conf""",
        [CONF_CTE],
    ),
)
def confusion_metrics(spark, sf_dir):
    return rounded(evaluate.confusion(_scored(spark, sf_dir), 0.15))


REPORT_CTES = [
    CONF_CTE,
    """per_class as (select '0' as label, tn/(tn+fn) as precision, tn/(tn+fp) as recall, 2*tn/(2*tn+fp+fn) as f1,
 tn+fp as support from conf union all
 select '1', tp/(tp+fp), tp/(tp+fn), 2*tp/(2*tp+fp+fn), tp+fn from conf)""",
    """report as (select * from per_class union all
 select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from per_class union all
 select 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
 sum(f1*support)/sum(support), cast(sum(support) as bigint) from per_class)""",
]


@query(
    "M17",
    with_views(
        S, f"select label, {r6('precision')}, {r6('recall')}, {r6('f1')}, support from report", REPORT_CTES
    ),
)
def class_report(spark, sf_dir):
    return rounded(evaluate.classification_report(_scored(spark, sf_dir), 0.15))


SWEEP_CTE = """sweep as (select k/100e0 as threshold, coalesce(tp/nullif(tp+fp,0),0) as precision,
 coalesce(tp/nullif(np,0),0) as recall, coalesce(2*tp/nullif(tp+fp+np,0),0) as f1 from (
 select k, count(*) filter (where p>=k/100e0 and y=1) as tp, count(*) filter (where p>=k/100e0 and y=0) as fp,
 count(*) filter (where y=1) as np from scored, range(1,60) t(k) group by k))"""
_SWEEP = f"select {r6('threshold')}, {r6('precision')}, {r6('recall')}, {r6('f1')} from sweep"


@query("M18", with_views(S, _SWEEP, [SWEEP_CTE]))
def f1_by_threshold(spark, sf_dir):
    return rounded(evaluate.threshold_sweep(_scored(spark, sf_dir)))


@query("M18", with_views(S, _SWEEP + " order by round(sweep.f1, 12) desc, sweep.threshold limit 1", [SWEEP_CTE]))
def best_f1_threshold(spark, sf_dir):
    return rounded(evaluate.best_threshold(evaluate.threshold_sweep(_scored(spark, sf_dir))))


ROC_CTE = """roc as (select fp/nn as fpr, tp/np as tpr, p as threshold from cum
 union all select 0e0, 0e0, 1e0 union all select 1e0, 1e0, 0e0)"""
_ROC = f"select {r6('fpr')}, {r6('tpr')}, {r6('threshold')} from roc"


@query("W05", with_views(S, _ROC, [BY_SCORE, CUM, ROC_CTE]))
def roc_curve(spark, sf_dir):
    return rounded(evaluate.roc_points(_scored(spark, sf_dir)))


@query(
    "W06",
    with_views(
        S,
        _ROC + " order by abs(roc.threshold-15e-2), roc.threshold desc, roc.fpr limit 1",
        [BY_SCORE, CUM, ROC_CTE],
    ),
)
def roc_point_at_threshold(spark, sf_dir):
    return rounded(evaluate.nearest_point(evaluate.roc_points(_scored(spark, sf_dir)), 0.15))


@query(
    "M19",
    with_views(S, f"select {r6('sum(pos*(nn-fp+neg/2e0))/max(np*nn)', 'roc_auc')} from cum", [BY_SCORE, CUM]),
)
def roc_area(spark, sf_dir):
    return rounded(evaluate.roc_auc(_scored(spark, sf_dir)))


@query(
    "M20",
    with_views(
        S,
        f"select p as threshold, {r6('tp/(tp+fp)', 'precision')}, {r6('tp/np', 'recall')},"
        f" {r6('pos/np', 'recall_step')} from cum",
        [BY_SCORE, CUM],
    ),
)
def precision_recall_curve(spark, sf_dir):
    return rounded(evaluate.precision_recall_points(_scored(spark, sf_dir)))


@query(
    "M20",
    with_views(S, f"select {r6('sum(pos/np*tp/(tp+fp))', 'average_precision')} from cum", [BY_SCORE, CUM]),
)
def average_precision_score(spark, sf_dir):
    return rounded(evaluate.average_precision(_scored(spark, sf_dir)))


BIN = "cast(" + "+".join(f"(case when p>{k}e-1 then 1 else 0 end)" for k in range(1, 10)) + " as int)"
CURVE = f"curve as (select {BIN} as bin, avg(p) as mean_predicted, avg(y) as actual_rate, count(*) as n from scored group by 1)"


@query("M21", with_views(S, f"select bin, {r6('mean_predicted')}, {r6('actual_rate')}, n from curve", [CURVE]))
def calibration_bins(spark, sf_dir):
    return rounded(evaluate.calibration_curve(_scored(spark, sf_dir)))


@query("M22", with_views(S, f"select {r6('avg(abs(actual_rate-mean_predicted))', 'mean_gap')} from curve", [CURVE]))
def calibration_gap(spark, sf_dir):
    return rounded(evaluate.mean_gap(evaluate.calibration_curve(_scored(spark, sf_dir))))


@query("M22", with_views(S, f"select {r6('avg((p-y)*(p-y))', 'brier_score')} from scored"))
def brier(spark, sf_dir):
    return rounded(evaluate.brier_score(_scored(spark, sf_dir)))


@query(
    "F12",
    with_views(S, f"select id, {r6('1/(1+exp(-ln((p+1e-3)/(1-p))))', 'probability')} from scored"),
)
def sigmoid_of_logit(spark, sf_dir):
    logit = F.log((F.col("p") + 1e-3) / (1 - F.col("p")))
    return rounded(_scored(spark, sf_dir).select("id", sigmoid(logit).alias("probability")))


_HASH = "('0x' || substr(md5('split:' || SK_ID_CURR), 1, 10))::bigint"
FOLD_HASH = "('0x' || substr(md5('fold:' || SK_ID_CURR), 1, 10))::bigint"
FOLD_NUMBER = " + ".join(
    "case when row_number() over (partition by TARGET order by g, SK_ID_CURR)"
    f" > round(count(*) over (partition by TARGET)*{k}/5e0) then 1 else 0 end"
    for k in range(1, 5)
)


@query(
    "M01",
    with_views(
        ["application_train"],
        f"""select SK_ID_CURR, TARGET, row_number() over (partition by TARGET order by h, SK_ID_CURR)
 <= round_even(8e-1*count(*) over (partition by TARGET), 0) as is_train, cast({FOLD_NUMBER} as int) as fold
 from (select *, {_HASH} as h, {FOLD_HASH} as g from application_train)""",
    ),
)
def train_test_split(spark, sf_dir):
    df = view(spark, sf_dir, "application_train").select("SK_ID_CURR", "TARGET")
    return split_and_folds(df)


SAMPLE_CTE = f"""split as (select *, row_number() over (partition by TARGET order by h, SK_ID_CURR) as rn,
 round_even(8e-1*count(*) over (partition by TARGET), 0) as nt
 from (select SK_ID_CURR, TARGET, {_HASH} as h from application_train))"""


@query(
    "M01",
    with_views(
        ["application_train"],
        "select SK_ID_CURR, TARGET from split where rn<=nt and rn<=round_even(25e-2*nt, 0)",
        [SAMPLE_CTE],
    ),
)
def tuning_sample(spark, sf_dir):
    train = stratified_split(view(spark, sf_dir, "application_train").select("SK_ID_CURR", "TARGET"))
    train = train.where("is_train").drop("is_train")
    return train.where(stratified_cut(train, 0.25))
