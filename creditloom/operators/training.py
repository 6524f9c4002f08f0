"""From assembled rows to a stored model: encoding, validation, search, refit, scoring.

``fit_design`` learns medians, missing flags and categories from training rows.
They become one SQL stage of a ``PipelineModel``, next to the vector assembler and
the classifier, so that the stored pipeline takes assembled rows as they are and
needs nothing of this package to be loaded. Every fit of a comparison reads one
written vector table; out-of-fold scores are written per model and fold, and a
repeated call goes on with the parts that are missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from math import prod
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.risk import THRESHOLD, decision, prediction
from creditloom.operators.clean import candidate_columns
from creditloom.operators.encode import CATEGORICAL, Baseline, align_with_baseline, categories, clean_name
from creditloom.operators.evaluate import roc_auc
from creditloom.operators.model import KEY, LABEL, TREE_ROWS, in_few_parts, random_draws, with_balanced_weight
from creditloom.operators.order_stats import medians
from creditloom.session import materialize

# --- encoding ---------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """What the encoding of assembled rows has learned."""

    medians: dict[str, float]
    flagged: list[str]
    categories: dict[str, list[str]]

    def expressions(self) -> dict[str, str]:
        """SQL expression of every feature over an assembled row."""
        out = {c: f"coalesce(cast(`{c}` as double), {m!r}D)" for c, m in self.medians.items()}
        out |= {f"{c}_missing": f"case when `{c}` is null then 1D else 0D end" for c in self.flagged}
        for c, values in self.categories.items():
            for v in values:
                literal = v.replace("\\", "\\\\").replace("'", "\\'")
                out[clean_name(f"{c}_{v}")] = f"case when cast(`{c}` as string) = '{literal}' then 1D else 0D end"
            out[clean_name(f"{c}_nan")] = f"case when `{c}` is null then 1D else 0D end"
        return out

    @property
    def features(self) -> list[str]:
        return list(self.expressions())

    @property
    def raw(self) -> list[str]:
        """Columns of an assembled row that the encoding reads."""
        return [*self.medians, *self.categories]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Design:
        return cls(**json.loads(text))


def fit_design(rows: DataFrame, key: str = KEY, label: str = LABEL) -> Design:
    """Exact medians, flags for columns with gaps, and categories; a column without any value is left out."""
    numbers = candidate_columns(rows, (key, label))
    kinds = [c for c in CATEGORICAL if c in rows.columns]
    middle = {c: float(m) for c, m in medians(rows, numbers).items() if m is not None}
    holes = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in middle]).first() if middle else {}
    known = categories(rows, kinds) if kinds else {}
    design = Design(middle, [c for c in middle if holes[c] > 0], known)
    names = [f"{c}_missing" for c in design.flagged] + [clean_name(f"{c}_{v}") for c, own in known.items() for v in (*own, "nan")]
    clash = sorted({n for n in names if names.count(n) > 1 or n in middle})
    if clash:
        raise ValueError(f"feature names collide: {clash}")
    return design


def encoding_stages(design: Design, features: Sequence[str] | None = None) -> list:
    """SQL stage that makes the features out of an assembled row, and the assembler of the wanted ones."""
    wanted = list(features or design.features)
    made = design.expressions()
    absent = [c for c in wanted if c not in made]
    if absent:
        raise ValueError(f"unknown features: {absent}")
    columns = ", ".join(f"{made[c]} AS `{c}`" for c in wanted)
    dropped = ", ".join(f"`{c}`" for c in design.raw)
    encode = SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}), {columns} FROM __THIS__")
    return [encode, VectorAssembler(inputCols=wanted, outputCol="features")]


def with_raw_columns(rows: DataFrame, design: Design) -> DataFrame:
    """Assembled rows with every column the encoding reads; an absent one is missing throughout."""
    absent = {c: F.lit(None).cast("string" if c in design.categories else "double") for c in design.raw if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def encoded(rows: DataFrame, design: Design, features: Sequence[str] | None = None, keep: Sequence[str] = (KEY, LABEL)) -> DataFrame:
    """``keep`` and the sparse feature vector of every row."""
    out = with_raw_columns(rows, design)
    for stage in encoding_stages(design, features):
        out = stage.transform(out)
    return out.select(*keep, "features")


def feature_rows(rows: DataFrame, design: Design, keep: Sequence[str] = (KEY, LABEL)) -> DataFrame:
    """``keep`` and one column per feature."""
    encode, _ = encoding_stages(design)
    return encode.transform(with_raw_columns(rows, design)).select(*keep, *design.features)


# --- work in parallel, kept part by part --------------------------------------------


def _done(spark, path: str) -> bool:
    """Whether a part was written to its end; the committer shows no file before."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def in_parallel(tasks: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Results of independent jobs, at most ``parallelism`` at a time."""
    if not tasks:
        return []
    pool = ThreadPool(min(parallelism, len(tasks)))
    try:
        return pool.map(lambda task: task(), tasks, chunksize=1)
    finally:
        pool.close()


def steps_of(estimator: Estimator) -> int:
    """Steps of a fit that wait for each other: levels of all rounds of boosting, levels of a forest, iterations of a linear fit."""
    return prod(estimator.getOrDefault(n) for n in ("maxIter", "maxDepth") if estimator.hasParam(n) and estimator.isDefined(n))


def margin_column(model: Model):
    """Score that orders rows like the probability: log-odds, or a forest's share of votes."""
    raw = vector_to_array("rawPrediction")[1]
    return raw * 2 if isinstance(model, GBTClassificationModel) else raw


def out_of_fold(
    data: DataFrame,
    estimators: Mapping[str, Estimator],
    path: str,
    folds: int = 5,
    parallelism: int = 4,
    key: str = KEY,
    label: str = LABEL,
) -> DataFrame:
    """model, fold, id, y, margin and p of every row, scored by a model that has not seen its fold.

    ``data`` is a written table with features, label and fold; each model and
    fold is one part below ``path``. Parts that are there already stay. The
    fits with the most steps begin first, so that the short ones run beside them.
    """
    spark = data.sparkSession

    def part(name: str, k: int) -> Callable[[], None]:
        at = f"{path}/model={name}/fold={k}"

        def run() -> None:
            if _done(spark, at):
                return
            fitted = estimators[name].fit(with_balanced_weight(data.where(F.col("fold") != k), label))
            scored = fitted.transform(data.where(F.col("fold") == k))
            columns = [F.col(key).alias("id"), F.col(label).alias("y"), margin_column(fitted).alias("margin")]
            scored.select(*columns, vector_to_array("probability")[1].alias("p")).write.mode("overwrite").parquet(at)

        return run

    longest = sorted(estimators, key=lambda name: -steps_of(estimators[name]))
    in_parallel([part(name, k) for name in longest for k in range(folds)], parallelism)
    schema = "id long, y int, margin double, p double, model string, fold int"
    return spark.read.schema(schema).parquet(path).where(F.col("model").isin(list(estimators)))


def fold_areas(scores: DataFrame, names: Sequence[str], folds: int = 5, parallelism: int = 4) -> DataFrame:
    """Exact area under the ROC curve of every model and fold."""

    def area(name: str, k: int) -> Callable[[], tuple]:
        own = scores.where((F.col("model") == name) & (F.col("fold") == k)).select("p", "y")
        return lambda: (name, k, roc_auc(own).first()["roc_auc"])

    rows = in_parallel([area(name, k) for name in names for k in range(folds)], parallelism)
    return scores.sparkSession.createDataFrame(rows, "model string, fold int, roc_auc double")


def comparison(areas: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds, best model first."""
    table = areas.groupBy("model").agg(F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_pop("roc_auc").alias("roc_auc_std"))
    return table.orderBy(F.desc("roc_auc_mean"), "model")


# --- search -----------------------------------------------------------------------


def draw_names(estimator: Estimator, grid: Mapping[str, Sequence], draws: int, seed: int = 42) -> dict[str, dict]:
    """Seeded draws out of the grid, by name."""
    settings = random_draws(estimator, grid, draws, seed)
    return {f"draw-{i}": {p.name: v for p, v in s.items()} for i, s in enumerate(settings)}


def search(
    data: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    path: str,
    draws: int = 6,
    folds: int = 3,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[DataFrame, dict[str, Estimator]]:
    """Table of all draws with their mean area, best first, and the estimator of each.

    Draws follow from the seed and their scores are written, so a search that is
    called again after its driver was lost goes on where it stopped.
    """
    settings = draw_names(estimator, grid, draws, seed)
    drawn = {name: estimator.copy({estimator.getParam(k): v for k, v in s.items()}) for name, s in settings.items()}
    areas = fold_areas(out_of_fold(data, drawn, path, folds, parallelism), list(drawn), folds, parallelism)
    means = {r["model"]: r["roc_auc_mean"] for r in comparison(areas).collect()}
    rows = [(name, *[float(s[c]) for c in grid], means[name]) for name, s in settings.items()]
    schema = "draw string, " + ", ".join(f"{c} double" for c in grid) + ", roc_auc double"
    return data.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("roc_auc"), "draw"), drawn


# --- the stored pipeline ------------------------------------------------------------


def fit_pipeline(
    rows: DataFrame, design: Design, estimator: Estimator, features: Sequence[str] | None = None, label: str = LABEL
) -> PipelineModel:
    """Encoding and a classifier fitted on all ``rows``, as one model over assembled rows.

    The vectors are written first: a fit reads its rows several times before it caches its own form of them.
    """
    data = materialize(encoded(rows, design, features, (label,)), "fit-vectors")
    fitted = estimator.fit(in_few_parts(with_balanced_weight(data, label), TREE_ROWS))
    return PipelineModel([*encoding_stages(design, features), fitted])


def save_scorer(path: str, pipeline: PipelineModel, design: Design, baseline: Baseline) -> None:
    """Pipeline, design and baseline below one folder."""
    pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    types = {c: t.simpleString() for c, t in baseline.types.items()}
    rows = [("design", design.to_json()), ("baseline", json.dumps({"means": dict(baseline.means), "types": types}))]
    spark.createDataFrame(rows, "name string, content string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_scorer(spark, path: str) -> tuple[PipelineModel, Design, Baseline]:
    """What ``save_scorer`` has stored, in any session."""
    content = {r["name"]: r["content"] for r in spark.read.parquet(f"{path}/settings").collect()}
    stored = json.loads(content["baseline"])
    types = {c: T._parse_datatype_string(t) for c, t in stored["types"].items()}
    return PipelineModel.load(f"{path}/pipeline"), Design.from_json(content["design"]), Baseline(stored["means"], types)


def classifier_of(pipeline: PipelineModel) -> Model:
    return pipeline.stages[-1]


def feature_names(pipeline: PipelineModel) -> list[str]:
    """Features of the stored pipeline, in the order of the vector."""
    return pipeline.stages[-2].getInputCols()


def _decided(scored: DataFrame, key: str, threshold: float, keep: Sequence[str]) -> DataFrame:
    p = vector_to_array("probability")[1]
    named = scored.select(F.col(key).alias("id"), *keep, p.alias("probability"))
    return named.withColumns(
        {"prediction": prediction(F.col("probability"), threshold), "decision": decision(F.col("probability"), threshold)}
    )


def score_rows(
    pipeline: PipelineModel, design: Design, rows: DataFrame, key: str = KEY, threshold: float = THRESHOLD, keep: Sequence[str] = ()
) -> DataFrame:
    """Probability, prediction and decision of assembled rows; gaps get the training medians and their flags."""
    return _decided(pipeline.transform(with_raw_columns(rows, design)), key, threshold, keep)


def score_batch(
    pipeline: PipelineModel, baseline: Baseline, batch: DataFrame, key: str = KEY, threshold: float = THRESHOLD, mode: str = "safe"
) -> DataFrame:
    """Probability, prediction and decision of a batch that holds any of the features by name.

    Absent features and gaps get the stored baseline; only the assembler and the
    classifier of the pipeline run.
    """
    aligned = align_with_baseline(batch, baseline, keep=[key], mode=mode)
    return _decided(PipelineModel(pipeline.stages[1:]).transform(aligned), key, threshold, ())


# --- optimality -------------------------------------------------------------------


def lasso_gaps(data: DataFrame, weights: np.ndarray, intercept: float, penalty: float, label: str = LABEL) -> np.ndarray:
    """How far each weight is from the optimality conditions of the penalised mean loss.

    At the optimum the loss gradient of a weight that is not 0 is minus the
    penalty times its sign, and that of a zero weight lies within the penalty.
    One aggregation over ``data`` (features, label, weight) gives all gradients.
    """
    width = len(weights)
    vector = vector_to_array("features")
    dot = F.aggregate(
        F.zip_with(vector, F.array(*map(F.lit, map(float, weights))), lambda x, w: x * w), F.lit(float(intercept)), lambda a, v: a + v
    )
    error = (1 / (1 + F.exp(-dot)) - F.col(label)) * F.col("weight")
    parts = data.select(vector.alias("x"), error.alias("e"), "weight")
    sums = parts.agg(F.sum("weight").alias("n"), *[F.sum(F.col("x")[i] * F.col("e")).alias(f"g{i}") for i in range(width)]).first()
    gradient = np.array([sums[f"g{i}"] for i in range(width)]) / sums["n"]
    return np.where(weights != 0, np.abs(gradient + penalty * np.sign(weights)), np.maximum(np.abs(gradient) - penalty, 0.0))
