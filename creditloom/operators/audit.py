"""Audit log of predictions and officer decisions: appends, histories, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.nulls import rows
from creditloom.functions.risk import THRESHOLD, risk_band, risk_group

UNKNOWN_NAME = "Unknown Applicant"
AWAITING = "Awaiting decision"


def prediction_records(scored: DataFrame, shap_map: Column) -> DataFrame:
    """Rows for the prediction log: band and the contributions as JSON text.

    ``scored`` has applicant_id, officer_id and predicted_probability.
    """
    return scored.withColumns(
        {"risk_label": risk_band(F.col("predicted_probability")), "shap_values": F.to_json(shap_map)}
    )


def add_missing_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new log rows under the wider schema; absent columns read as NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def accept_decisions(proposed: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split decisions into those whose prediction exists and those without one."""
    known = predictions.select(F.col("id").alias("prediction_id"))
    return proposed.join(known, "prediction_id", "left_semi"), proposed.join(known, "prediction_id", "left_anti")


def _officers(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("officer_id"), F.col("username").alias("officer_name"))


def _predictions(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.col("id").alias("prediction_id"),
        "applicant_id",
        "predicted_probability",
        F.col("ts").alias("pred_time"),
    )


def _decisions(decisions: DataFrame) -> DataFrame:
    return decisions.withColumnRenamed("ts", "decision_time")


def _names(applicants: DataFrame) -> DataFrame:
    return applicants.select(F.col("SK_ID_CURR").alias("applicant_id"), F.col("name").alias("applicant_name"))


def recent_activity(
    decisions: DataFrame, predictions: DataFrame, applicants: DataFrame, users: DataFrame, n: int = 5
) -> DataFrame:
    """The n newest decisions with applicant and officer names."""
    return (
        _decisions(decisions)
        .join(_predictions(predictions).drop("pred_time"), "prediction_id")
        .join(_names(applicants), "applicant_id")
        .join(_officers(users), "officer_id", "left")
        .orderBy(
            F.desc("decision_time"),
            F.asc("prediction_id"),
            F.asc("l_linenumber"),
            F.asc("l_partkey"),
            F.asc("decision"),
            F.asc("officer_id"),
            F.asc_nulls_last("notes"),
        )
        .limit(n)
        .select(
            "prediction_id",
            "decision",
            "notes",
            "decision_time",
            "applicant_id",
            "predicted_probability",
            "applicant_name",
            "officer_name",
        )
    )


def applicant_history(
    predictions: DataFrame,
    decisions: DataFrame,
    users: DataFrame,
    applicant_id: int | None = None,
    defaults: bool = False,
    newest: int = 20,
) -> DataFrame:
    """Predictions with their decisions, of all applicants or the ``newest`` of one, newest first.

    ``defaults`` writes the texts shown for an open case; an empty text counts
    as missing, too. Decided and open predictions are joined apart: an inner join
    can be split where one prediction has very many decisions, a left join cannot. Open ones need no officer.
    """
    made = _predictions(predictions).withColumn("risk_label", risk_band(F.col("predicted_probability")))
    if applicant_id is not None:
        made = made.where(F.col("applicant_id") == applicant_id)
    decided = made.join(_decisions(decisions), "prediction_id").join(_officers(users), "officer_id", "left")
    undecided = made.join(decisions.select("prediction_id").distinct(), "prediction_id", "left_anti")
    history = (
        decided.unionByName(undecided, allowMissingColumns=True)
        .select(
            "prediction_id",
            "applicant_id",
            "pred_time",
            "predicted_probability",
            "risk_label",
            "decision",
            "notes",
            "decision_time",
            "officer_name",
        )
    )
    if defaults:
        history = history.withColumns(
            {
                "decision": F.coalesce(F.nullif("decision", F.lit("")), F.lit(AWAITING)),
                "notes": F.coalesce("notes", F.lit("")),
                "decision_time": F.coalesce(F.col("decision_time").cast("string"), F.lit("")),
                "officer_name": F.coalesce("officer_name", F.lit("")),
            }
        )
    if applicant_id is not None:
        ties = [F.asc_nulls_last(c) for c in ("decision_time", "decision", "notes", "officer_name")]
        history = _numbered(history, [F.desc("pred_time"), F.asc("prediction_id"), *ties], newest)
    return history


def _numbered(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their ``place``; only they reach the window."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def officer_activity(
    decisions: DataFrame,
    predictions: DataFrame,
    applicants: DataFrame,
    officer_id: int | None = None,
    newest: int = 20,
) -> DataFrame:
    """Decisions of all officers, or the ``newest`` of one, newest first, with applicant and score."""
    made = _decisions(decisions)
    if officer_id is not None:
        made = made.where(F.col("officer_id") == officer_id)
    activity = (
        made.join(_predictions(predictions), "prediction_id")
        .join(_names(applicants), "applicant_id")
        .select(
            "officer_id",
            "prediction_id",
            "decision",
            "notes",
            "decision_time",
            "applicant_id",
            "predicted_probability",
            "pred_time",
            "applicant_name",
        )
    )
    if officer_id is None:
        return activity
    ties = [F.asc_nulls_last(c) for c in ("prediction_id", "decision", "notes")]
    return _numbered(activity, [F.desc("decision_time"), *ties], newest)


def decided_ids(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applicants with at least one decision."""
    made = decisions.select("prediction_id").distinct()
    return (
        predictions.select(F.col("id").alias("prediction_id"), "applicant_id")
        .join(made, "prediction_id", "left_semi")
        .select("applicant_id")
        .distinct()
    )


def pending_cases(cohort: DataFrame, predictions: DataFrame, decisions: DataFrame, names: DataFrame) -> DataFrame:
    """Cohort members without any decision, with name, band and group.

    ``cohort`` has applicant_id, target and probability; one join finds all
    names at once.
    """
    p = F.col("probability")
    return (
        cohort.join(decided_ids(predictions, decisions), "applicant_id", "left_anti")
        .join(_names(names), "applicant_id", "left")
        .select(
            "applicant_id",
            F.coalesce("applicant_name", F.lit(UNKNOWN_NAME)).alias("name"),
            "target",
            "probability",
            risk_band(p, "report").alias("risk_classification"),
            risk_group(p).alias("risk_group"),
        )
    )


def first_pending(pending: DataFrame, n: int = 5) -> DataFrame:
    return pending.orderBy("applicant_id").limit(n)


def decision_stats(decisions: DataFrame, predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts per decision, and how often the officer went against the model."""
    joined = decisions.select("prediction_id", "decision").join(
        _predictions(predictions).select("prediction_id", "predicted_probability"), "prediction_id"
    )
    return decision_totals(joined, threshold)


def decision_totals(joined: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    said, model_approves = F.lower("decision"), F.col("predicted_probability") < threshold
    approved, declined = said == "approved", said == "declined"
    overrides = F.count_if((approved & ~model_approves) | (declined & model_approves))
    return joined.agg(
        rows().alias("total_decisions"),
        F.count_if(approved).alias("approved_count"),
        F.count_if(declined).alias("declined_count"),
        F.count_if(said == "escalated").alias("escalated_count"),
        overrides.alias("overrides_count"),
        F.coalesce(F.try_divide(overrides, rows()), F.lit(0.0)).alias("override_rate"),
    )


def home_stats(applicants: DataFrame, decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """The dashboard's numbers as one row; each table is read once."""
    spark = applicants.sparkSession
    per_decision = decisions.agg(
        F.struct(
            rows().alias("total"),
            F.count_if(F.col("decision") == "approved").alias("approved"),
            F.count_if(F.col("decision") == "declined").alias("declined"),
        ).alias("d")
    ).scalar()
    open_cases = pending.agg(
        F.struct(rows().alias("n"), F.coalesce(F.avg("probability"), F.lit(0.0)).alias("risk")).alias("p")
    ).scalar()
    return (
        spark.range(1)
        .select(applicants.agg(rows()).scalar().alias("total_applicants"), per_decision.alias("d"), open_cases.alias("p"))
        .select(
            "total_applicants",
            F.col("d.total").alias("total_decisions"),
            F.col("d.approved").alias("total_approved"),
            F.col("d.declined").alias("total_rejected"),
            F.col("p.n").alias("total_pending"),
            F.col("p.risk").alias("avg_risk_pending"),
        )
    )


def cohort_header(cohort: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Approved, rejected and defaulted counts with their percentages."""
    n = rows()
    approved = F.count_if(F.col("probability") < threshold)
    defaults = F.count_if(F.col("target") == 1)

    def pct(x: Column) -> Column:
        return F.round(F.try_divide(x * 100, n), 1)

    return cohort.agg(
        approved.alias("approved"),
        pct(approved).alias("approved_pct"),
        (n - approved).alias("rejected"),
        pct(n - approved).alias("rejected_pct"),
        defaults.alias("defaults"),
        pct(defaults).alias("defaults_pct"),
    )


def cohort_view(
    cohort: DataFrame,
    which: str = "all",
    id_contains: str = "",
    sort: str = "prob-desc",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Filtered, searched and sorted cohort table."""
    p = F.col("probability")
    conditions = {
        "all": F.lit(True),
        "approved": p < threshold,
        "rejected": p >= threshold,
        "defaults": F.col("target") == 1,
        "high-risk": p >= THRESHOLD,
    }
    orders = {
        "prob-desc": [p.desc(), F.col("applicant_id").asc()],
        "prob-asc": [p.asc(), F.col("applicant_id").asc()],
        "id-asc": [F.col("applicant_id").asc()],
    }
    picked = cohort.where(conditions[which])
    if id_contains:
        picked = picked.where(F.col("applicant_id").cast("string").contains(id_contains.lower()))
    return picked.orderBy(*orders[sort])


def platform_summary(applicants: DataFrame, cohort: DataFrame, metrics: DataFrame) -> DataFrame:
    """Population sizes next to a stored one-row metrics table."""
    sizes = [
        applicants.agg(rows()).scalar().alias("total_applicants"),
        cohort.agg(rows()).scalar().alias("sample_size"),
    ]
    return metrics.select("*", *sizes)


def search_applicants(applicants: DataFrame, text: str, n: int = 6, mode: str = "parity") -> DataFrame:
    """Applicants whose id starts with, or whose name contains, the text.

    In ``parity`` mode % and _ in the text are wildcards; ``safe`` takes them literally.
    """
    if mode == "safe":
        for special in ("\\", "%", "_"):
            text = text.replace(special, "\\" + special)
    hit = F.col("SK_ID_CURR").cast("string").ilike(text + "%") | F.col("name").ilike("%" + text + "%")
    return (
        applicants.where(hit)
        .orderBy("SK_ID_CURR")
        .limit(n)
        .select(F.col("SK_ID_CURR").alias("applicant_id"), "name", F.col("TARGET").alias("target"))
    )


def lookup_applicants(applicants: DataFrame, features: list[str], applicant_id: int | None = None) -> DataFrame:
    """Id, name, target and a map of all features as doubles; one applicant or all."""
    if applicant_id is not None:
        applicants = applicants.where(F.col("SK_ID_CURR") == applicant_id)
    values = F.array(*[F.col(c).cast("double") for c in features])
    return applicants.select(
        F.col("SK_ID_CURR").alias("applicant_id"),
        F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name"),
        F.col("TARGET").alias("target"),
        F.map_from_arrays(F.array(*map(F.lit, features)), values).alias("features"),
    )


def conversation_tail(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of every conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.asc("role"), F.asc("text"))
    return messages.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")
