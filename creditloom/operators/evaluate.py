"""Score evaluation: confusion counts, curves, threshold search, calibration.

Input is a table with a score ``p`` and a 0/1 label ``y``. Curves work on one row
per distinct score, so their cost after one aggregation does not depend on ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.nulls import rows
from creditloom.operators.order_stats import running_totals
from creditloom.session import materialize

SWEEP = 59


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates at one threshold, one pass."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    counts = df.agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("accuracy", _share(tp + tn, tp + fp + tn + fn))
        .withColumn("precision", _share(tp, tp + fp))
        .withColumn("recall", _share(tp, tp + fn))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def classification_report(df: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    c = confusion(df, threshold).select("tp", "fp", "tn", "fn")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))

    def entry(label: str, hits: Column, called: Column, support: Column) -> Column:
        p, r = _share(hits, called), _share(hits, support)
        return F.struct(
            F.lit(label).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            _f1(p, r).alias("f1"),
            support.alias("support"),
        )

    per_class = c.select(entry("0", tn, tn + fn, tn + fp).alias("a"), entry("1", tp, tp + fp, tp + fn).alias("b"))
    a, b = F.col("a"), F.col("b")
    total = a["support"] + b["support"]

    def average(label: str, wa: Column, wb: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            *[(a[m] * wa + b[m] * wb).alias(m) for m in ("precision", "recall", "f1")],
            total.alias("support"),
        )

    half = F.lit(0.5)
    return per_class.select(
        F.inline(
            F.array(
                a,
                b,
                average("macro avg", half, half),
                average("weighted avg", _share(a["support"], total), _share(b["support"], total)),
            )
        )
    )


def distinct_scores(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, stored because several jobs read it."""
    grouped = df.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    return materialize(grouped, "scores")


def _class_totals(scores: DataFrame) -> tuple[int, int]:
    t = scores.agg(F.sum("pos"), F.sum("neg")).first()
    return t[0] or 0, t[1] or 0


def _from_the_top(scores: DataFrame) -> DataFrame:
    """True and false positives when everything down to a score is called positive."""
    return running_totals(scores, "p", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)


def roc_points(df: DataFrame) -> DataFrame:
    """One point per distinct score plus both corners."""
    scores = distinct_scores(df)
    pos, neg = _class_totals(scores)
    points = _from_the_top(scores).select(
        (F.col("fp") / F.lit(neg or 1)).alias("fpr"),
        (F.col("tp") / F.lit(pos or 1)).alias("tpr"),
        F.col("p").alias("threshold"),
    )
    corners = df.sparkSession.range(2).select(
        F.col("id").cast("double").alias("fpr"),
        F.col("id").cast("double").alias("tpr"),
        (1.0 - F.col("id")).alias("threshold"),
    )
    return points.unionByName(corners)


def nearest_point(points: DataFrame, threshold: float) -> DataFrame:
    """The curve point closest to a threshold; of two the higher one."""
    return points.orderBy(F.abs(F.col("threshold") - threshold), F.desc("threshold"), F.asc("fpr")).limit(1)


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area under the curve: the share of ordered pairs, ties counting half."""
    scores = distinct_scores(df)
    pos, neg = _class_totals(scores)
    below = running_totals(scores, "p", {"seen": F.col("neg")})
    wins = F.col("pos").cast("double") * (F.col("seen") - F.col("neg") / 2)
    pairs = float(pos) * float(neg)
    return below.agg(F.try_divide(F.sum(wins), F.lit(pairs)).alias("roc_auc"))


def precision_recall_points(df: DataFrame) -> DataFrame:
    """Precision and recall when everything down to each distinct score is called positive."""
    scores = distinct_scores(df)
    pos, _ = _class_totals(scores)
    return _from_the_top(scores).select(
        F.col("p").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _share(F.col("tp"), F.lit(pos)).alias("recall"),
        _share(F.col("pos"), F.lit(pos)).alias("recall_step"),
    )


def average_precision(df: DataFrame) -> DataFrame:
    points = precision_recall_points(df)
    return points.agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def threshold_sweep(df: DataFrame, steps: int = SWEEP) -> DataFrame:
    """F1 at every k/100: each score falls in one of ``steps + 1`` classes, then suffix sums.

    The data is read once, not once per threshold.
    """
    p, guess = F.col("p"), F.floor(F.col("p") * 100)
    reached = F.when(p >= (guess + 1) / 100, guess + 1).when(p < guess / 100, guess - 1).otherwise(guess)
    k = F.greatest(F.least(reached, F.lit(steps)), F.lit(0)).cast("int")
    per_class = df.groupBy(k.alias("k")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    filled = every.join(per_class, "k", "left").na.fill(0, ["pos", "neg"])
    up = Window.orderBy("k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tp, fp = F.sum("pos").over(up), F.sum("neg").over(up)
    precision, recall = _share(tp, tp + fp), _share(tp, F.sum("pos").over(whole))
    return (
        filled.select("k", precision.alias("precision"), recall.alias("recall"))
        .where(F.col("k") > 0)
        .select(
            (F.col("k") / 100).alias("threshold"), "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1")
        )
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1."""
    return sweep.orderBy(F.round("f1", 12).desc(), F.asc("threshold")).limit(1)


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Number of inner edges strictly below the score."""
    edges = [(F.lit(k / bins) < p).cast("int") for k in range(1, bins)]
    return reduce(lambda a, b: a + b, edges)


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width bin; empty bins do not appear."""
    return df.groupBy(calibration_bin(F.col("p"), bins).alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg("y").alias("actual_rate"), rows().alias("n")
    )


def mean_gap(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg(F.abs(F.col("actual_rate") - F.col("mean_predicted"))).alias("mean_gap"))


def brier_score(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier_score"))
