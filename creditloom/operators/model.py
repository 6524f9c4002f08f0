"""Training, tuning, scoring, scaling, projections and calibration with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.risk import THRESHOLD, decision, prediction
from creditloom.operators.clean import impute
from creditloom.operators.explore import cells
from creditloom.operators.order_stats import medians
from creditloom.operators.sampling import stratified_folds

KEY, LABEL = "SK_ID_CURR", "TARGET"


# --- preparation ------------------------------------------------------------------


@dataclass(frozen=True)
class Preparation:
    """Medians of the training rows and the columns that get a missing flag."""

    medians: Mapping[str, float | None]
    flagged: Sequence[str]

    @property
    def features(self) -> list[str]:
        kept = [c for c, m in self.medians.items() if m is not None]
        return kept + [f"{c}_missing" for c in self.flagged]


def fit_preparation(df: DataFrame, columns: Sequence[str]) -> Preparation:
    """The learners take no missing values: fill with medians and say so in a flag."""
    middle = medians(df, columns)
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return Preparation(middle, [c for c in columns if middle[c] is not None and holes[c] > 0])


def prepare(df: DataFrame, prep: Preparation, keep: Sequence[str] = (KEY, LABEL)) -> DataFrame:
    """Key, label and complete double features."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in prep.flagged}
    filled = impute(df.withColumns(flags), prep.medians)
    return filled.select(*keep, *prep.features)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def with_balanced_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Weight n / (2 * n_class), so that both classes count the same."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.when(F.col(label) == 1, F.lit(total / (2 * n.get(1, 1)))).otherwise(F.lit(total / (2 * n.get(0, 1))))
    return df.withColumn("weight", weight)


# Rows of a task worth its start-up in every step of a fit: a tree step bins all features of a row, a linear one multiplies them.
TREE_ROWS, LINEAR_ROWS = 5_000, 100_000


def in_few_parts(df: DataFrame, rows: int, beside: int = 1) -> DataFrame:
    """``df`` in as few partitions as its size needs, ``rows`` rows or more in each.

    A fit runs hundreds of short jobs over the same rows, so on small tables the
    start of its tasks is most of the time. No core is left idle for it on a table
    that has work for all, and partitions of about LINEAR_ROWS rows are not joined further.
    Where ``beside`` fits run at a time they share the cores: two tasks a core keep all
    busy when some fits end before the others.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    share = min(ceil(2 * cores / beside), cores)
    return df.coalesce(max(ceil(n / LINEAR_ROWS), min(ceil(n / rows), share), 1))


# --- scaling ----------------------------------------------------------------------


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a constant column keeps its scale."""
    found = cells(df, columns).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    of_column = {r["at"]: (r["m"], r["s"] or 1.0) for r in found}
    return {c: of_column.get(i, (None, 1.0)) for i, c in enumerate(columns)}


def scale(df: DataFrame, scaling: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaling.items()})


# --- comparison and tuning --------------------------------------------------------


def evaluator(label: str = LABEL) -> BinaryClassificationEvaluator:
    """Exact area under the curve; the default of 1000 bins only estimates it."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0)


def learners(trees: int = 100, rounds: int = 200, depth: int = 5, rate: float = 0.05, seed: int = 42) -> dict[str, Estimator]:
    """The three model families with balanced classes."""
    common = {"labelCol": LABEL, "featuresCol": "features", "weightCol": "weight"}
    return {
        "Logistic Regression": LogisticRegression(maxIter=100, **common),
        "Random Forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
        "Gradient Boosting": GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **common),
    }


def _cross_validator(estimator: Estimator, grid: list, folds: int, parallelism: int) -> CrossValidator:
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator(),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )


def cross_validate(
    df: DataFrame, estimators: Mapping[str, Estimator], folds: int = 5, parallelism: int = 4
) -> DataFrame:
    """Mean and deviation of the ROC-AUC over stratified folds, best model first."""
    data = with_balanced_weight(df).withColumn("fold", stratified_folds(df, folds, key=KEY))
    out = []
    for name, estimator in estimators.items():
        fitted = _cross_validator(estimator, ParamGridBuilder().build(), folds, parallelism).fit(data)
        out.append((name, float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])))
    table = df.sparkSession.createDataFrame(out, "model string, roc_auc_mean double, roc_auc_std double")
    return table.orderBy(F.desc("roc_auc_mean"))


# The grid of the search.
BOOSTING_GRID = {"maxDepth": [4, 6, 8], "stepSize": [0.03, 0.05, 0.1], "maxIter": [200, 400]}
DRAWS, SEARCH_FOLDS = 6, 3


def random_draws(estimator: Estimator, grid: Mapping[str, Sequence], draws: int = DRAWS, seed: int = 42) -> list:
    """``draws`` different parameter settings out of the grid."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    every = builder.build()
    return random.Random(seed).sample(every, min(draws, len(every)))


def random_search(
    df: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence] = BOOSTING_GRID,
    draws: int = DRAWS,
    folds: int = SEARCH_FOLDS,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[Model, DataFrame]:
    """Best model of a seeded random search and the table of all draws."""
    data = with_balanced_weight(df).withColumn("fold", stratified_folds(df, folds, key=KEY))
    settings = random_draws(estimator, grid, draws, seed)
    fitted = _cross_validator(estimator, settings, folds, parallelism).fit(data)
    rows = [
        (*[float(s[estimator.getParam(name)]) for name in grid], float(auc))
        for s, auc in zip(settings, fitted.avgMetrics, strict=True)
    ]
    schema = ", ".join(f"{name} double" for name in grid) + ", roc_auc double"
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("roc_auc"))


def refit_best(df: DataFrame, estimators: Mapping[str, Estimator], comparison: DataFrame, path: str | None = None) -> Model:
    """Train the best-compared model on all training rows and store it."""
    best = comparison.orderBy(F.desc("roc_auc_mean")).first()["model"]
    model = estimators[best].fit(with_balanced_weight(df))
    if path:
        model.write().save(path)
    return model


def score(model: Model, df: DataFrame, threshold: float = THRESHOLD, key: str = KEY) -> DataFrame:
    """Probability, prediction and decision for a whole table."""
    p = vector_to_array("probability")[1]
    return (
        model.transform(df)
        .select(F.col(key).alias("id"), p.alias("probability"))
        .withColumns(
            {
                "prediction": prediction(F.col("probability"), threshold),
                "decision": decision(F.col("probability"), threshold),
            }
        )
    )


# --- selection with models ----------------------------------------------------------


def tree_importance(df: DataFrame, features: Sequence[str], rounds: int = 200, depth: int = 5, seed: int = 42) -> DataFrame:
    """Importance of each feature in a boosted model."""
    gbt = GBTClassifier(labelCol=LABEL, maxIter=rounds, maxDepth=depth, stepSize=0.05, seed=seed)
    values = gbt.fit(in_few_parts(assemble(df, features).select(LABEL, "features"), TREE_ROWS)).featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(features, values, strict=True)], "feature string, importance double"
    )


def _regression(n: int, c: float, l1: float) -> LogisticRegression:
    """Penalty c over summed losses, written for Spark's mean loss."""
    return LogisticRegression(
        labelCol=LABEL,
        featuresCol="features",
        weightCol="weight",
        regParam=1.0 / (c * n),
        elasticNetParam=l1,
        standardization=False,
        maxIter=200,
    )


def _names_table(spark, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in names], "feature string")


def eliminate(df: DataFrame, features: Sequence[str], keep: int = 30, step: int = 15) -> DataFrame:
    """Drop the weakest features of a balanced linear model until ``keep`` are left.

    ``df`` holds scaled features. Each round is one distributed fit.
    """
    data = with_balanced_weight(df)
    n = df.count()
    left = list(features)
    while len(left) > keep:
        model = _regression(n, 1.0, 0.0).fit(assemble(data, left))
        weak = np.argsort(np.square(model.coefficients.toArray()), kind="stable")[: min(step, len(left) - keep)]
        left = [c for i, c in enumerate(left) if i not in set(weak.tolist())]
    return _names_table(df.sparkSession, left)


def elimination_rounds(data: DataFrame, features: Sequence[str], keep: int = 30, step: int = 15) -> list[dict[str, float]]:
    """Squared weights of the features left in every round of ``eliminate``; the last entry are the kept ones.

    ``data`` is a written table with the scaled vector of all ``features``;
    every round takes its columns out of that vector.
    """
    n = data.count()
    data = in_few_parts(with_balanced_weight(data), LINEAR_ROWS)
    left, rounds = list(range(len(features))), []
    while True:
        sliced = VectorSlicer(inputCol="features", outputCol="left", indices=left).transform(data)
        fitted = _regression(n, 1.0, 0.0).setFeaturesCol("left").fit(sliced)
        strength = np.square(fitted.coefficients.toArray())
        rounds.append({features[i]: float(w) for i, w in zip(left, strength, strict=True)})
        if len(left) <= keep:
            return rounds
        weak = set(np.argsort(strength, kind="stable")[: min(step, len(left) - keep)].tolist())
        left = [i for k, i in enumerate(left) if k not in weak]


def lasso_model(data: DataFrame, c: float = 0.05) -> tuple[LogisticRegressionModel, float]:
    """Balanced linear model with an L1 penalty over scaled feature vectors, and the penalty per unit of mean loss."""
    n = data.count()
    return _regression(n, c, 1.0).fit(in_few_parts(with_balanced_weight(data), LINEAR_ROWS)), 1.0 / (c * n)


def lasso_selected(df: DataFrame, features: Sequence[str], c: float = 0.05, minimum: float = 1e-4) -> DataFrame:
    """Features that keep a weight under an L1 penalty; ``df`` holds scaled features."""
    model = _regression(df.count(), c, 1.0).fit(assemble(with_balanced_weight(df), features))
    kept = [f for f, w in zip(features, model.coefficients.toArray(), strict=True) if abs(w) > minimum]
    return _names_table(df.sparkSession, kept)


# --- projections --------------------------------------------------------------------


def principal_components(df: DataFrame, features: Sequence[str], variance: float = 0.95) -> tuple[Model, DataFrame]:
    """Component table with the cumulative variance and whether it is needed for ``variance``.

    Spark's PCA does not centre what it projects, so ``df`` holds scaled features.
    """
    model = PCA(k=len(features), inputCol="features", outputCol="components").fit(assemble(df, features))
    share = np.asarray(model.explainedVariance.toArray())
    total = np.cumsum(share)
    needed = int(np.argmax(total >= variance - 1e-12)) + 1
    rows = [(i + 1, float(s), float(t), i < needed) for i, (s, t) in enumerate(zip(share, total, strict=True))]
    return model, df.sparkSession.createDataFrame(
        rows, "component int, explained double, cumulative double, needed boolean"
    )


def discriminant(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Weights of the two-class linear discriminant with unit within-class variance.

    The covariance comes from one distributed pass, the class means from
    another; the features-by-features system is solved on the driver. ``df``
    holds scaled features, so the correlation matrix is the covariance.
    """
    total = Correlation.corr(assemble(df, features).select("features"), "features").first()[0].toArray()
    groups = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in features]).collect()
    n = sum(g["n"] for g in groups)
    means = {g[LABEL]: np.array([g[c] for c in features]) for g in groups}
    between = sum(g["n"] / n * np.outer(means[g[LABEL]], means[g[LABEL]]) for g in groups)
    within = (np.nan_to_num(total) - between) * n / (n - len(groups))
    direction = np.linalg.lstsq(within, means[1] - means[0], rcond=None)[0]
    direction /= np.sqrt(direction @ within @ direction)
    return dict(zip(features, map(float, direction), strict=True))


def project(df: DataFrame, weights: Mapping[str, float], key: str = KEY) -> DataFrame:
    """One-dimensional projection as a column expression."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(w)
    return df.select(key, LABEL, total.alias("projection"))


# --- calibration --------------------------------------------------------------------


def margins(model: Model, df: DataFrame) -> DataFrame:
    """Log-odds of a fitted logistic or boosted classifier, with key and label.

    They are the model's raw score, twice that for boosting; a forest's votes are not log-odds.
    """
    if not isinstance(model, (GBTClassificationModel, LogisticRegressionModel)):
        raise TypeError(f"{type(model).__name__} has no log-odds")
    raw = vector_to_array("rawPrediction")[1]
    margin = raw * 2 if isinstance(model, GBTClassificationModel) else raw
    return model.transform(df).select(KEY, LABEL, margin.alias("margin"), vector_to_array("probability")[1].alias("p"))


def fit_platt(held_out: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the sigmoid on rows the model has not seen."""
    model = LogisticRegression(labelCol=LABEL, featuresCol="features", maxIter=200).fit(assemble(held_out, ["margin"]))
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(scored: DataFrame, slope: float, intercept: float) -> DataFrame:
    from creditloom.functions.risk import sigmoid

    return scored.withColumn("p_calibrated", sigmoid(F.lit(slope) * F.col("margin") + F.lit(intercept)))
