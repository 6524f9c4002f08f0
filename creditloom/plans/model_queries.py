"""Selection, training, scoring and explanation on the assembled, encoded customer row.

What the steps hand on (assembled rows, encoding, voted feature list, out-of-fold
scores, the stored scorer) is written once per session and input folder, as a
training run would keep it, and read back by the next step.

Learned numbers have no SQL form. Each step therefore has two queries: one with the
numbers, and one that holds them against their definition (areas recomputed from
the written scores, contributions that add up, optimality conditions, a reloaded
model that scores alike) next to counts, which SQL takes from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.risk import sigmoid
from creditloom.operators import evaluate, model
from creditloom.operators import training as tr
from creditloom.operators.encode import fit_baseline
from creditloom.operators.explore import cumulative_importance
from creditloom.operators.order_stats import never_falls
from creditloom.operators.sampling import stratified_cut, stratified_folds, stratified_split
from creditloom.operators.selection import select_by_correlation, vote
from creditloom.operators.tree_explain import tree_contributions
from creditloom.plans.evaluate_queries import FOLD_HASH, FOLD_NUMBER, SAMPLE_CTE
from creditloom.plans.feature_queries import feature_rows
from creditloom.plans.registry import query as registered
from creditloom.plans.registry import with_views
from creditloom.session import is_there, materialize, scratch_path
from creditloom.sources.tables import read_feature_list
from creditloom.streaming.jobs import score_batches
from creditloom.streaming.tables import appended, run_to_table

FOLDS, TUNING = 5, 0.25
# Fits of the comparison at a time: the boosted ones of all folds, and room for the short fits beside them.
FITS = FOLDS + 3
SEARCH_FITS = 6
IMPORTANCE_DEPTH = 6
SEARCH_GRID = model.BOOSTING_GRID
BOOSTING = "Gradient Boosting"
KEYS, MARKS = ("SK_ID_CURR", "TARGET"), ("is_train", "tuning", "fold")


def query(covers: str, sql: str | None = None):
    return registered(covers, sql, trains=True)


_STORED: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Result of an earlier step of this session over the same folder; built when it is wanted first, or its files are gone."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STORED or not all(is_there(spark, path) for path in _files(_STORED[at])):
        _STORED[at] = build()
    return _STORED[at]


def _files(result) -> list[str]:
    """Folders that a stored result reads."""
    parts = result if isinstance(result, tuple) else (result,)
    named = [p for p in parts if isinstance(p, str)]
    return named + [p._scratch_path for p in parts if getattr(p, "_scratch_path", None)]


def _truth(spark: SparkSession, **checks) -> DataFrame:
    """One row of named results."""
    kinds = {bool: "boolean", int: "bigint"}
    plain = {c: bool(v) if isinstance(v, (bool, np.bool_)) else int(v) for c, v in checks.items()}
    schema = ", ".join(f"{c} {kinds[type(v)]}" for c, v in plain.items())
    return spark.createDataFrame([tuple(plain.values())], schema)


# --- rows, encoding, selection ------------------------------------------------------


def _rows(spark, sf_dir) -> DataFrame:
    """Assembled rows with ``is_train`` and, for every training row, ``fold``.

    ``tuning`` marks the rows that the SQL of two checks counts; every step works on all training rows.
    These rows and the others are dealt to the folds one after the other, so a fold holds its share of both.
    """

    def build() -> DataFrame:
        wide = materialize(feature_rows(spark, sf_dir), "assembled")
        split = stratified_split(wide)
        train = split.where("is_train").select(*KEYS)
        tuning = stratified_cut(train, TUNING)
        fold = F.when(tuning, stratified_folds(train.where(tuning), FOLDS)).otherwise(stratified_folds(train.where(~tuning), FOLDS))
        marks = {"tuning": F.col("is_train") & tuning, "fold": F.when(F.col("is_train"), fold)}
        return materialize(split.withColumns(marks), "model-rows")

    return stored(spark, sf_dir, "rows", build)


def _train(spark, sf_dir) -> DataFrame:
    return _rows(spark, sf_dir).where("is_train").drop(*MARKS)


def _tuning(spark, sf_dir) -> DataFrame:
    """Key and label of the rows that the SQL of two checks counts."""
    return _rows(spark, sf_dir).where("tuning").select(*KEYS)


def _design(spark, sf_dir) -> tr.Design:
    return stored(spark, sf_dir, "design", lambda: tr.fit_design(_train(spark, sf_dir)))


def _candidates(spark, sf_dir) -> DataFrame:
    """Every feature of the training rows as a column."""
    design, train = _design(spark, sf_dir), _train(spark, sf_dir)
    return stored(spark, sf_dir, "candidates", lambda: materialize(tr.feature_rows(train, design), "candidates"))


def _scaled(spark, sf_dir) -> DataFrame:
    """Scaled candidates, as columns and as one vector."""

    def build() -> DataFrame:
        rows, features = _candidates(spark, sf_dir), _design(spark, sf_dir).features
        return materialize(model.assemble(model.scale(rows, model.fit_scaling(rows, features)), features), "scaled")

    return stored(spark, sf_dir, "scaled", build)


def _importance(spark, sf_dir) -> DataFrame:
    features = _design(spark, sf_dir).features
    rows = _candidates(spark, sf_dir)
    return stored(
        spark, sf_dir, "importance", lambda: materialize(model.tree_importance(rows, features, depth=IMPORTANCE_DEPTH), "importance")
    )


def _rounds(spark, sf_dir) -> list[dict[str, float]]:
    features = _design(spark, sf_dir).features
    vectors = _scaled(spark, sf_dir).select(*KEYS, "features")
    return stored(spark, sf_dir, "rounds", lambda: model.elimination_rounds(vectors, features))


def _lasso(spark, sf_dir):
    return stored(spark, sf_dir, "lasso", lambda: model.lasso_model(_scaled(spark, sf_dir).select(*KEYS, "features")))


def _linear(spark, sf_dir) -> None:
    """Both linear selections, as soon as the scaled vectors they share are there."""
    _scaled(spark, sf_dir)
    _at_once(spark, sf_dir, _rounds, _lasso)


def _correlated(spark, sf_dir) -> DataFrame:
    features, rows = _design(spark, sf_dir).features, _candidates(spark, sf_dir)
    return stored(
        spark, sf_dir, "correlated", lambda: materialize(select_by_correlation(rows, features, "TARGET"), "correlated")
    )


def _names(spark, names) -> DataFrame:
    return spark.createDataFrame([(c,) for c in names], "feature string")


def _at_once(spark, sf_dir, *steps: Callable) -> None:
    """Builds steps that need nothing of each other side by side."""
    tr.in_parallel([lambda step=step: step(spark, sf_dir) for step in steps], len(steps))


def _votes(spark, sf_dir) -> DataFrame:
    def build() -> DataFrame:
        features = _design(spark, sf_dir).features
        _candidates(spark, sf_dir)
        _at_once(spark, sf_dir, _importance, _linear, _correlated)
        weights = _lasso(spark, sf_dir)[0].coefficients.toArray()
        chosen = {
            "correlation": _correlated(spark, sf_dir),
            "trees": cumulative_importance(_importance(spark, sf_dir)).where("selected"),
            "elimination": _names(spark, _rounds(spark, sf_dir)[-1]),
            "lasso": _names(spark, [f for f, w in zip(features, weights, strict=True) if abs(w) > 1e-4]),
        }
        return materialize(vote(_names(spark, features), chosen), "votes")

    return stored(spark, sf_dir, "votes", build)


def _feature_list(spark, sf_dir) -> list[str]:
    """The voted features, written as a JSON list and read back in its order."""

    def build() -> str:
        path = scratch_path(spark, "feature-list")
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "feature")))
        names = _votes(spark, sf_dir).where("selected").agg(F.to_json(F.transform(ordered, lambda r: r["feature"])).alias("value"))
        names.coalesce(1).write.text(path)
        return path

    rows = read_feature_list(spark, stored(spark, sf_dir, "feature-list", build)).orderBy("position").collect()
    return [r["feature"] for r in rows]


@query("M07, W04")
def tree_selection(spark, sf_dir):
    return cumulative_importance(_importance(spark, sf_dir))


@query("M07, W04", "select true as adds_up, true as falls, true as crossing_is_out")
def tree_selection_check(spark, sf_dir):
    """Importances are shares that fall with the rank; the first feature beyond the limit is out."""
    rows = tree_selection(spark, sf_dir).orderBy("rank").collect()
    values = [r["importance"] for r in rows]
    kept = sum(r["selected"] for r in rows)
    running = np.cumsum(values) / sum(values)
    return _truth(
        spark,
        adds_up=abs(sum(values) - 1) < 1e-9 and min(values) >= 0,
        falls=values == sorted(values, reverse=True),
        crossing_is_out=all(r["selected"] for r in rows[:kept]) and running[kept - 1] <= 0.9 + 1e-9 < running[kept] + 2e-9,
    )


@query("M08")
def elimination_selection(spark, sf_dir):
    """Squared weight of every feature in every round of the elimination."""
    rows = [(k, c, w) for k, left in enumerate(_rounds(spark, sf_dir)) for c, w in left.items()]
    return spark.createDataFrame(rows, "round int, feature string, strength double")


@query("M08", "select 30::bigint as kept, true as nested, true as steps_of_15, true as weakest_go")
def elimination_check(spark, sf_dir):
    """Every round is a subset of the one before and lost its 15 weakest, until 30 are left."""
    rounds = _rounds(spark, sf_dir)
    pairs = list(zip(rounds, rounds[1:], strict=False))
    gone = [{c: w for c, w in a.items() if c not in b} for a, b in pairs]
    return _truth(
        spark,
        kept=len(rounds[-1]),
        nested=all(b.keys() <= a.keys() for a, b in pairs),
        steps_of_15=all(len(g) == min(15, len(a) - 30) for g, (a, _) in zip(gone, pairs, strict=True)),
        weakest_go=all(max(g.values()) <= min(a[c] for c in b) for g, (a, b) in zip(gone, pairs, strict=True)),
    )


@query("M09")
def lasso_selection(spark, sf_dir):
    features, weights = _design(spark, sf_dir).features, _lasso(spark, sf_dir)[0].coefficients.toArray()
    rows = [(c, float(w), bool(abs(w) > 1e-4)) for c, w in zip(features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double, selected boolean")


@query("M09", "select true as some_are_out, true as some_are_in, true as optimal")
def lasso_check(spark, sf_dir):
    """The weights meet the optimality conditions of the penalised loss, recomputed by one aggregation."""
    fitted, penalty = _lasso(spark, sf_dir)
    weights = fitted.coefficients.toArray()
    data = model.with_balanced_weight(_scaled(spark, sf_dir).select(*KEYS, "features"))
    gaps = tr.lasso_gaps(data, weights, fitted.intercept, penalty)
    return _truth(
        spark, some_are_out=(weights == 0).any(), some_are_in=(np.abs(weights) > 1e-4).any(), optimal=gaps.max() < 0.05 * penalty
    )


@query("U02, S08, S13")
def feature_votes(spark, sf_dir):
    """All four selections and the features at least two of them keep."""
    return _votes(spark, sf_dir)


@query("U02, S13", "select true as votes_are_sums, true as two_suffice, true as list_is_selection, true as training_reads_list")
def feature_votes_check(spark, sf_dir):
    """Votes recomputed from the flags; the stored list, read back, is the selection in order of votes, and what training uses."""
    rows = _votes(spark, sf_dir).collect()
    methods = ("correlation", "trees", "elimination", "lasso")
    wanted = [r["feature"] for r in sorted(rows, key=lambda r: (-r["votes"], r["feature"])) if r["votes"] >= 2]
    listed = _feature_list(spark, sf_dir)
    stages = tr.encoding_stages(_design(spark, sf_dir), listed)
    return _truth(
        spark,
        votes_are_sums=all(r["votes"] == sum(r[m] for m in methods) for r in rows),
        two_suffice=all(r["selected"] == (r["votes"] >= 2) for r in rows),
        list_is_selection=listed == wanted and len(listed) > 0,
        training_reads_list=stages[1].getInputCols() == wanted,
    )


@query("M11")
def principal_component_table(spark, sf_dir):
    """Components of the voted features."""
    return model.principal_components(_scaled(spark, sf_dir).drop("features"), _feature_list(spark, sf_dir))[1]


@query("M11", "select true as adds_up, true as falls, true as least_number")
def principal_component_check(spark, sf_dir):
    rows = principal_component_table(spark, sf_dir).orderBy("component").collect()
    shares = [r["explained"] for r in rows]
    needed = [r["needed"] for r in rows]
    count = int(np.argmax(np.cumsum(shares) >= 0.95 - 1e-12)) + 1
    return _truth(
        spark,
        adds_up=abs(sum(shares) - 1) < 1e-9,
        falls=all(a >= b - 1e-12 for a, b in zip(shares, shares[1:], strict=False)),
        least_number=needed == [i < count for i in range(len(rows))],
    )


@query("M12")
def discriminant_projection(spark, sf_dir):
    scaled = _scaled(spark, sf_dir).drop("features")
    return model.project(scaled, model.discriminant(scaled, _feature_list(spark, sf_dir)))


SAMPLE_ROWS = [
    SAMPLE_CTE,
    f"sample as (select SK_ID_CURR, TARGET, {FOLD_HASH} as g from split where rn<=nt and rn<=round_even(25e-2*nt, 0))",
]


@query(
    "M12",
    with_views(
        ["application_train"],
        "select TARGET, count(*) as n, true as unit_spread, true as ordered from sample group by TARGET",
        SAMPLE_ROWS,
    ),
)
def discriminant_check(spark, sf_dir):
    """The projection of all training rows spreads by 1 within the classes, and the mean of class 1 is the larger one.

    The SQL counts the tuning rows, so n counts those among the projected ones.
    """
    projected = materialize(discriminant_projection(spark, sf_dir), "projection")
    parts = projected.groupBy("TARGET").agg(
        F.count(F.lit(1)).alias("n"), F.avg("projection").alias("m"), (F.var_pop("projection") * F.count(F.lit(1))).alias("ss")
    )
    rows = {r["TARGET"]: r for r in parts.collect()}
    spread = sum(r["ss"] for r in rows.values()) / (sum(r["n"] for r in rows.values()) - len(rows))
    counted = projected.join(_tuning(spark, sf_dir), list(KEYS), "left_semi").groupBy("TARGET").count().collect()
    out = [(r["TARGET"], r["count"], abs(spread - 1) < 1e-6, rows[1]["m"] > rows[0]["m"]) for r in counted]
    return spark.createDataFrame(out, "TARGET int, n bigint, unit_spread boolean, ordered boolean")


# --- comparison, search, refit ------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    """The training rows as one written table of voted feature vectors with folds, in as few files as the fits over it need tasks."""

    def build() -> DataFrame:
        train = _rows(spark, sf_dir).where("is_train")
        made = tr.encoded(train, _design(spark, sf_dir), _feature_list(spark, sf_dir), (*KEYS, "fold"))
        return materialize(model.in_few_parts(made, model.TREE_ROWS), "vectors")

    return stored(spark, sf_dir, "vectors", build)


def _fold_scores(spark, sf_dir) -> DataFrame:
    """Out-of-fold scores of the three families at the reference's settings."""

    def build() -> DataFrame:
        path = scratch_path(spark, "folds")
        folded = model.in_few_parts(_vectors(spark, sf_dir), model.TREE_ROWS, FITS)
        scores = tr.out_of_fold(folded, model.learners(), path, FOLDS, parallelism=FITS)
        scores._scratch_path = path
        return scores

    return stored(spark, sf_dir, "fold-scores", build)


def _fold_areas(spark, sf_dir) -> DataFrame:
    scores = _fold_scores(spark, sf_dir)
    return stored(spark, sf_dir, "fold-areas", lambda: materialize(tr.fold_areas(scores, list(model.learners()), FOLDS), "areas"))


@query("M02, S08")
def baseline_comparison(spark, sf_dir):
    """Logistic regression, forest and boosting over five stratified folds of the training rows."""
    return tr.comparison(_fold_areas(spark, sf_dir))


@query(
    "M02",
    with_views(
        ["application_train"],
        """select model, fold, count(*) as n, sum(TARGET)::bigint as positives, true as same_area
 from folded, (values ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) t(model) group by model, fold""",
        [*SAMPLE_ROWS, f"folded as (select *, cast({FOLD_NUMBER} as int) as fold from sample)"],
    ),
)
def baseline_folds(spark, sf_dir):
    """Whether the library's evaluator finds the exact area of every written fold; the SQL counts the tuning rows and defaults in it."""
    scores = _fold_scores(spark, sf_dir)
    exact = {(r["model"], r["fold"]): r["roc_auc"] for r in _fold_areas(spark, sf_dir).collect()}
    library = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0)

    def area(name, k):
        own = scores.where((F.col("model") == name) & (F.col("fold") == k))
        return lambda: (name, k, abs(library.evaluate(own) - exact[name, k]) < 1e-9)

    same = tr.in_parallel([area(*at) for at in exact], 4)
    tuning = _tuning(spark, sf_dir).toDF("id", "y")
    counts = scores.join(tuning, ["id", "y"], "left_semi").groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives")
    )
    return counts.join(spark.createDataFrame(same, "model string, fold int, same_area boolean"), ["model", "fold"])


def _search(spark, sf_dir) -> tuple[DataFrame, dict]:
    def build():
        folded = _vectors(spark, sf_dir)
        thirds = materialize(folded.withColumn("fold", stratified_folds(folded, model.SEARCH_FOLDS)), "thirds")
        thirds = model.in_few_parts(thirds, model.TREE_ROWS, SEARCH_FITS)
        table, drawn = tr.search(thirds, model.learners()[BOOSTING], SEARCH_GRID, scratch_path(spark, "search"), parallelism=SEARCH_FITS)
        return materialize(table, "draws"), drawn

    return stored(spark, sf_dir, "search", build)


@query("M03")
def tuned_draws(spark, sf_dir):
    return _search(spark, sf_dir)[0]


@query("M03", "select 6::bigint as draws, true as distinct_settings, true as inside_grid, true as best_is_first, true as proper_areas")
def tuned_draws_check(spark, sf_dir):
    """Six different settings out of the grid, ordered by their mean area."""
    rows = _search(spark, sf_dir)[0].collect()
    settings = [tuple(r[c] for c in SEARCH_GRID) for r in rows]
    best = _search(spark, sf_dir)[0].orderBy(F.desc("roc_auc"), "draw").first()["roc_auc"]
    return _truth(
        spark,
        draws=len(rows),
        distinct_settings=len(set(settings)) == len(rows),
        inside_grid=all(v in SEARCH_GRID[c] for s in settings for c, v in zip(SEARCH_GRID, s, strict=True)),
        best_is_first=best == max(r["roc_auc"] for r in rows),
        proper_areas=all(0 < r["roc_auc"] <= 1 for r in rows),
    )


def _fitted(spark, sf_dir, family: str):
    """Pipeline of one family over all training rows."""

    def build():
        return tr.fit_pipeline(_train(spark, sf_dir), _design(spark, sf_dir), model.learners()[family], _feature_list(spark, sf_dir))

    return stored(spark, sf_dir, f"fitted {family}", build)


def _folds_and_booster(spark, sf_dir) -> None:
    """Out-of-fold scores and the boosted refit side by side: both are chains of short jobs that leave most cores idle.

    Explanation and calibration want that refit whichever family compares best.
    """
    _vectors(spark, sf_dir)
    _at_once(spark, sf_dir, _fold_scores, lambda *at: _fitted(*at, BOOSTING))


def _best_family(spark, sf_dir) -> str:
    return tr.comparison(_fold_areas(spark, sf_dir)).first()["model"]


def _scorer(spark, sf_dir) -> str:
    """Folder of the best family's pipeline with its design and baseline."""

    def build() -> str:
        design, features = _design(spark, sf_dir), _feature_list(spark, sf_dir)
        made = tr.feature_rows(_train(spark, sf_dir), design)
        path = scratch_path(spark, "scorer")
        _folds_and_booster(spark, sf_dir)
        tr.save_scorer(path, _fitted(spark, sf_dir, _best_family(spark, sf_dir)), design, fit_baseline(made, features))
        return path

    return stored(spark, sf_dir, "scorer", build)


def _held_out(spark, sf_dir) -> DataFrame:
    return _rows(spark, sf_dir).where("not is_train").drop(*MARKS)


@query("M04, M05")
def best_model_scores(spark, sf_dir):
    """The best family, refitted on all training rows, stored, loaded and applied to rows it has not seen."""
    pipeline, design, _ = tr.load_scorer(spark, _scorer(spark, sf_dir))
    return tr.score_rows(pipeline, design, _held_out(spark, sf_dir))


@query(
    "M04, M05, C08, C09",
    with_views(
        ["application_train"],
        """select count(*) as n, count(distinct SK_ID_CURR) as ids, true as best_family, true as same_area, true as spread,
 true as reloaded_alike, true as aligned_alike from split where rn>nt""",
        [SAMPLE_CTE],
    ),
)
def stored_model_check(spark, sf_dir):
    """The scores of the loaded pipeline against the fitted one, the evaluator, and the aligned batch of the same rows."""
    held_out = _held_out(spark, sf_dir)
    path = _scorer(spark, sf_dir)
    pipeline, design, baseline = tr.load_scorer(spark.newSession(), path)
    scores = materialize(tr.score_rows(pipeline, design, held_out, keep=["TARGET"]), "held-out-scores")
    family = _best_family(spark, sf_dir)
    fitted = tr.score_rows(_fitted(spark, sf_dir, family), design, held_out).select("id", F.col("probability").alias("q"))
    # A batch of feature columns without gaps is scored like the rows it was made of.
    batch = tr.feature_rows(held_out, design, keep=["SK_ID_CURR"])
    aligned = tr.score_batch(pipeline, baseline, batch).select("id", F.col("probability").alias("b"))
    gaps = scores.join(fitted, "id").join(aligned, "id")
    gap = gaps.agg(F.max(F.abs(F.col("probability") - F.col("q"))).alias("q"), F.max(F.abs(F.col("probability") - F.col("b"))).alias("b")).first()
    row = scores.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("probability"), F.max("probability")).first()
    exact = evaluate.roc_auc(scores.select(F.col("probability").alias("p"), F.col("TARGET").alias("y"))).first()["roc_auc"]
    library = BinaryClassificationEvaluator(labelCol="TARGET", rawPredictionCol="probability", numBins=0).evaluate(scores)
    means = {r["model"]: r["roc_auc_mean"] for r in tr.comparison(_fold_areas(spark, sf_dir)).collect()}
    return _truth(
        spark,
        n=row["n"],
        ids=row["ids"],
        best_family=means[family] == max(means.values()),
        same_area=abs(exact - library) < 1e-9,
        spread=0 <= row[2] < row[3] <= 1,
        reloaded_alike=gap["q"] < 1e-12,
        aligned_alike=gap["b"] < 1e-9,
    )


# --- explanation ------------------------------------------------------------------


def _contributions(spark, sf_dir) -> tuple[DataFrame, float, list[str]]:
    """Contributions of the boosted pipeline for every applicant, with its log-odds."""
    pipeline = _fitted(spark, sf_dir, BOOSTING)
    names = tr.feature_names(pipeline)
    booster = tr.classifier_of(pipeline)

    def build():
        rows = tr.encoded(_rows(spark, sf_dir), _design(spark, sf_dir), names, ("SK_ID_CURR",))
        wide, base = tree_contributions(rows, booster, names, vector="features")
        return materialize(wide, "tree-contributions"), base

    return *stored(spark, sf_dir, "contributions", build), names


@query("M13")
def tree_shap_values(spark, sf_dir):
    wide, _, names = _contributions(spark, sf_dir)
    return wide.unpivot("SK_ID_CURR", names, "feature", "shap_value")


@query("M13, M15", with_views(["application_train"], "select SK_ID_CURR, true as additive from application_train"))
def tree_shap_sums(spark, sf_dir):
    """For every applicant: base and contributions make up the model's log-odds."""
    wide, base, names = _contributions(spark, sf_dir)
    total = F.aggregate(F.array(*names), F.lit(base), lambda a, x: a + x)
    pipeline = _fitted(spark, sf_dir, BOOSTING)
    scored = tr.encoded(_rows(spark, sf_dir), _design(spark, sf_dir), names, ("SK_ID_CURR",))
    raw = tr.classifier_of(pipeline).transform(scored).select("SK_ID_CURR", tr.margin_column(tr.classifier_of(pipeline)).alias("m"))
    return wide.select("SK_ID_CURR", total.alias("t")).join(raw, "SK_ID_CURR").select(
        "SK_ID_CURR", (F.abs(F.col("t") - F.col("m")) < 1e-6).alias("additive")
    )


@query("M15", "select 0e0 as max_gap, count(*) as n, true as spread from customer")
def additivity_gap(spark, sf_dir):
    """Largest distance between sigmoid(base + contributions) and the model's probability."""
    wide, base, names = _contributions(spark, sf_dir)
    total = F.aggregate(F.array(*names), F.lit(base), lambda a, x: a + x)
    rebuilt = wide.select(F.col("SK_ID_CURR").alias("id"), sigmoid(total).alias("rebuilt"))
    scored = tr.score_rows(_fitted(spark, sf_dir, BOOSTING), _design(spark, sf_dir), _rows(spark, sf_dir))
    gap = F.abs(F.col("rebuilt") - F.col("probability"))
    return rebuilt.join(scored, "id").agg(
        (F.floor(F.max(gap) * 1e6) / 1e6).alias("max_gap"),
        F.count(F.lit(1)).alias("n"),
        (F.max("probability") - F.min("probability") > 0.1).alias("spread"),
    )


# --- calibration ------------------------------------------------------------------


def _calibrated(spark, sf_dir) -> DataFrame:
    """Held-out rows with the boosted model's probability and the one of a sigmoid fitted on out-of-fold margins."""

    def build() -> DataFrame:
        _folds_and_booster(spark, sf_dir)
        own = _fold_scores(spark, sf_dir).where(F.col("model") == BOOSTING)
        slope, intercept = model.fit_platt(own.select("margin", F.col("y").alias("TARGET")))
        pipeline = _fitted(spark, sf_dir, BOOSTING)
        rows = tr.encoded(_held_out(spark, sf_dir), _design(spark, sf_dir), tr.feature_names(pipeline))
        return materialize(model.apply_platt(model.margins(tr.classifier_of(pipeline), rows), slope, intercept), "calibrated")

    return stored(spark, sf_dir, "calibrated", build)


def _brier(spark, sf_dir) -> dict[str, DataFrame]:
    tested = _calibrated(spark, sf_dir)
    stages = {"before": "p", "after": "p_calibrated"}
    return {s: evaluate.brier_score(tested.select(F.col(c).alias("p"), F.col("TARGET").alias("y"))) for s, c in stages.items()}


@query("M23")
def platt_calibration(spark, sf_dir):
    """Brier score of held-out rows before and after the sigmoid of the out-of-fold margins."""
    parts = [table.withColumn("stage", F.lit(s)) for s, table in _brier(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


@query(
    "M23, M22",
    with_views(
        ["application_train"],
        """select count(*) as n, sum(TARGET)::bigint as positives, true as before_agrees, true as after_agrees, true as rising
 from split where rn>nt""",
        [SAMPLE_CTE],
    ),
)
def platt_check(spark, sf_dir):
    """Both Brier scores against sums over the written rows; the sigmoid keeps the order of all scores."""
    tested = _calibrated(spark, sf_dir)
    square = lambda c: F.sum((F.col(c) - F.col("TARGET")) * (F.col(c) - F.col("TARGET")))
    row = tested.agg(
        F.count(F.lit(1)).alias("n"), F.sum("TARGET").alias("positives"), square("p").alias("p"), square("p_calibrated").alias("q")
    ).first()
    found = {s: table.first()["brier_score"] for s, table in _brier(spark, sf_dir).items()}
    return _truth(
        spark,
        n=row["n"],
        positives=row["positives"],
        before_agrees=abs(row["p"] / row["n"] - found["before"]) < 1e-12,
        after_agrees=abs(row["q"] / row["n"] - found["after"]) < 1e-12,
        rising=never_falls(tested, "p", "p_calibrated", 1e-12),
    )


# --- scoring of a stream ------------------------------------------------------------


@query(
    "T01, C09",
    with_views(["application_train"], "select SK_ID_CURR, true as as_in_batch, true as stable from split where rn>nt", [SAMPLE_CTE]),
)
def stored_scorer_stream(spark, sf_dir):
    """Held-out applicants arrive file by file with some features, and get what the stored scorer gives the whole batch.

    The stream runs twice over the same checkpoint and result table: the second run must change nothing.
    """
    path = _scorer(spark, sf_dir)
    pipeline, design, baseline = tr.load_scorer(spark, path)
    batch = tr.feature_rows(_held_out(spark, sf_dir), design, keep=["SK_ID_CURR"]).select("SK_ID_CURR", *list(baseline.types)[::2])
    arriving, checkpoint, table = (scratch_path(spark, f"applicants-{x}") for x in ("in", "checkpoint", "scores"))
    batch.repartition(4, "SK_ID_CURR").write.parquet(arriving)
    results = []
    for run in ("first", "second"):
        source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        run_to_table(source, "append", "applicants", table, checkpoint, transform=score_batches(spark, path))
        results.append(appended(spark, table).select(F.col("id").alias("SK_ID_CURR"), F.col("probability").alias(run)))
        results[-1] = materialize(results[-1], "stream-scores")
    whole = tr.score_batch(pipeline, baseline, batch).select(F.col("id").alias("SK_ID_CURR"), "probability")
    joined = whole.join(results[0], "SK_ID_CURR").join(results[1], "SK_ID_CURR")
    return joined.select(
        "SK_ID_CURR",
        (F.abs(F.col("first") - F.col("probability")) < 1e-12).alias("as_in_batch"),
        (F.col("first") == F.col("second")).alias("stable"),
    )
