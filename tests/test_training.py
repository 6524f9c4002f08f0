"""Encoding, stored pipeline, out-of-fold scores, search and optimality on hand-made rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditloom.operators import model
from creditloom.operators import training as tr
from creditloom.operators.encode import fit_baseline
from creditloom.operators.sampling import stratified_folds
from creditloom.session import materialize, scratch_path

ROWS = "SK_ID_CURR long, TARGET int, x double, n int, gone double, CODE_GENDER string"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [(1, 0, 1.0, 5, None, "M"), (2, 1, None, 7, None, "it's"), (3, 0, 4.0, 6, None, None), (4, 1, 2.0, 9, None, "a\\b")], ROWS
    )


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) * 0.7 > 0.4).astype(int)
    pdf = pd.DataFrame({"SK_ID_CURR": np.arange(n), "TARGET": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    pdf["NAME_INCOME_TYPE"] = np.where(x[:, 2] > 0, "up", "down")
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("SK_ID_CURR") % 7 > 0, F.col("b")))
    return materialize(df.withColumn("SK_ID_CURR", F.col("SK_ID_CURR").cast("long")).withColumn("TARGET", F.col("TARGET").cast("int")), "t")


def test_design_and_its_sql_stage(small):
    design = tr.fit_design(small)
    assert design.medians == {"x": 2.0, "n": 6.5} and design.flagged == ["x"]
    assert design.categories == {"CODE_GENDER": ["M", "a\\b", "it's"]}
    assert tr.Design.from_json(design.to_json()) == design
    rows = tr.feature_rows(small, design).orderBy("SK_ID_CURR").collect()
    assert [r["x"] for r in rows] == [1.0, 2.0, 4.0, 2.0] and [r["x_missing"] for r in rows] == [0, 1, 0, 0]
    kinds = ["CODE_GENDER_M", "CODE_GENDER_it_s", "CODE_GENDER_a_b", "CODE_GENDER_nan"]
    assert [[int(r[c]) for c in kinds] for r in rows] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]]


def test_absent_columns_and_unknown_categories(spark, small):
    design = tr.fit_design(small)
    got = tr.feature_rows(spark.createDataFrame([(9, 1, "new")], "SK_ID_CURR long, TARGET int, CODE_GENDER string"), design).first()
    assert (got["x"], got["x_missing"], got["n"], got["CODE_GENDER_M"], got["CODE_GENDER_nan"]) == (2.0, 1.0, 6.5, 0.0, 0.0)


def test_colliding_names_and_unknown_features_are_errors(spark, small):
    rows = small.withColumn("CODE_GENDER", F.when(F.col("SK_ID_CURR") == 1, "a b").otherwise("a-b"))
    with pytest.raises(ValueError, match="collide"):
        tr.fit_design(rows)
    with pytest.raises(ValueError, match="unknown"):
        tr.encoding_stages(tr.fit_design(small), ["x", "nothing"])


def test_stored_scorer_in_a_fresh_session(spark, training):
    design = tr.fit_design(training)
    features = [c for c in design.features if c != "c"]
    pipeline = tr.fit_pipeline(training, design, model.learners()["Logistic Regression"], features)
    path = scratch_path(spark, "scorer")
    baseline = fit_baseline(tr.feature_rows(training, design), features)
    tr.save_scorer(path, pipeline, design, baseline)
    other = spark.newSession()
    loaded, design_back, baseline_back = tr.load_scorer(other, path)
    assert design_back == design and baseline_back == baseline and tr.feature_names(loaded) == features
    a = {r["id"]: r["probability"] for r in tr.score_rows(pipeline, design, training).collect()}
    b = {r["id"]: r["probability"] for r in tr.score_rows(loaded, design_back, training).collect()}
    assert a == b and len(a) == 400
    # A batch with some features and gaps: the rest comes from the baseline.
    batch = tr.feature_rows(training, design, ["SK_ID_CURR"]).select("SK_ID_CURR", "a", F.lit(None).cast("double").alias("b"))
    full = batch.select("SK_ID_CURR", "a", *[F.lit(baseline.means[c]).alias(c) for c in features if c != "a"])
    got = {r["id"]: r["probability"] for r in tr.score_batch(loaded, baseline_back, batch).collect()}
    want = {r["id"]: r["probability"] for r in tr.score_batch(loaded, baseline_back, full).collect()}
    assert got == want
    scored = tr.score_rows(loaded, design, training)
    assert scored.where("prediction != cast(probability >= 0.15 as int)").isEmpty()


def _folded(training):
    design = tr.fit_design(training)
    rows = training.withColumn("fold", stratified_folds(training, 3))
    return materialize(tr.encoded(rows, design, keep=("SK_ID_CURR", "TARGET", "fold")), "folded"), design


def test_out_of_fold_scores_come_from_models_that_have_not_seen_the_fold(spark, training):
    data, _ = _folded(training)
    common = {"labelCol": "TARGET", "featuresCol": "features", "weightCol": "weight"}
    tree = {"tree": DecisionTreeClassifier(maxDepth=3, seed=1, **common)}
    scores = tr.out_of_fold(data, tree, scratch_path(spark, "oof"), 3)
    assert scores.count() == 400 and scores.select("id").distinct().count() == 400
    for k in range(3):
        fitted = tree["tree"].fit(model.with_balanced_weight(data.where(F.col("fold") != k)))
        p = fitted.transform(data.where(F.col("fold") == k)).select("SK_ID_CURR", vector_to_array("probability")[1].alias("q"))
        own = scores.where(F.col("fold") == k).join(p, F.col("id") == F.col("SK_ID_CURR"))
        assert own.where("p != q").isEmpty() and own.count() == data.where(F.col("fold") == k).count()
    areas = tr.fold_areas(scores, ["tree"], 3).collect()
    for r in areas:
        own = scores.where(F.col("fold") == r["fold"]).toPandas()
        pos, neg = own.p[own.y == 1].to_numpy()[:, None], own.p[own.y == 0].to_numpy()[None]
        assert r["roc_auc"] == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean())


class Refusing(LogisticRegression):
    """A learner that must not be asked."""

    def _fit(self, dataset):
        raise AssertionError("fitted again")


def test_a_repeated_call_keeps_finished_parts(spark, training):
    data, _ = _folded(training)
    path = scratch_path(spark, "oof")
    first = tr.out_of_fold(data, {"lr": model.learners()["Logistic Regression"]}, path, 3).agg(F.sum("p")).first()[0]
    again = tr.out_of_fold(data, {"lr": Refusing()}, path, 3).agg(F.sum("p")).first()[0]
    assert first == again
    with pytest.raises(AssertionError):
        tr.out_of_fold(data, {"other": Refusing()}, path, 3)


def test_fits_with_the_most_steps_begin_first(spark, training, monkeypatch):
    data, _ = _folded(training)
    families = model.learners(trees=2, rounds=3, depth=2)
    families["Logistic Regression"].setMaxIter(2)
    begun = []
    own = GBTClassifier.fit, LogisticRegression.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: (begun.append("boosting"), own[0](self, df))[1])
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: (begun.append("linear"), own[1](self, df))[1])
    scores = tr.out_of_fold(data, families, scratch_path(spark, "oof"), 3, parallelism=1)
    assert begun == ["boosting"] * 3 + ["linear"] * 3
    assert {r["model"]: r["count"] for r in scores.groupBy("model").count().collect()} == dict.fromkeys(families, 400)
    steps = {name: tr.steps_of(e) for name, e in model.learners(rounds=200, depth=5).items()}
    assert steps == {"Logistic Regression": 100, "Random Forest": 5, "Gradient Boosting": 1000}


def test_search_is_seeded_and_ordered(spark, training):
    data, _ = _folded(training)
    grid = {"maxDepth": [1, 2], "stepSize": [0.1, 0.3], "maxIter": [2]}
    gbt = GBTClassifier(labelCol="TARGET", featuresCol="features", weightCol="weight", seed=1)
    table, drawn = tr.search(data, gbt, grid, scratch_path(spark, "search"), draws=3, folds=3)
    rows = table.collect()
    assert [r["roc_auc"] for r in rows] == sorted((r["roc_auc"] for r in rows), reverse=True)
    assert len({(r["maxDepth"], r["stepSize"]) for r in rows}) == 3
    for r in rows:
        own = drawn[r["draw"]]
        assert (own.getMaxDepth(), own.getStepSize(), own.getMaxIter()) == (r["maxDepth"], r["stepSize"], 2)
    assert tr.draw_names(gbt, grid, 3) == tr.draw_names(gbt, grid, 3)


def test_lasso_meets_its_conditions_and_other_weights_do_not(spark, training):
    design = tr.fit_design(training)
    names = design.features
    rows = tr.feature_rows(training, design)
    data = model.assemble(model.scale(rows, model.fit_scaling(rows, names)), names)
    fitted, penalty = model.lasso_model(data, c=0.05)
    weights = fitted.coefficients.toArray()
    balanced = model.with_balanced_weight(data)
    assert tr.lasso_gaps(balanced, weights, fitted.intercept, penalty).max() < 0.02 * penalty
    assert tr.lasso_gaps(balanced, weights + 0.1, fitted.intercept, penalty).max() > 0.1 * penalty


def test_elimination_rounds(spark, training):
    design = tr.fit_design(training)
    names = design.features
    rows = tr.feature_rows(training, design)
    scaled = model.scale(rows, model.fit_scaling(rows, names))
    rounds = model.elimination_rounds(model.assemble(scaled, names), names, keep=2, step=2)
    assert [len(r) for r in rounds] == [len(names) - 2 * k for k in range(len(rounds) - 1)] + [2]
    kept = {r["feature"] for r in model.eliminate(scaled, names, keep=2, step=2).collect()}
    assert set(rounds[-1]) == kept


def test_empty_and_single_jobs():
    assert tr.in_parallel([], 4) == [] and tr.in_parallel([lambda: 1, lambda: 2], 1) == [1, 2]


def test_fits_run_on_as_few_partitions_as_the_rows_need(spark, training, monkeypatch):
    """Every step of a fit starts one task per partition: a small table in many parts must not pay for them."""
    wide = training.repartition(16)
    assert model.in_few_parts(wide, model.TREE_ROWS).rdd.getNumPartitions() == 1
    assert model.in_few_parts(wide, 100).rdd.getNumPartitions() == 4
    assert model.in_few_parts(wide.limit(0), 100).rdd.getNumPartitions() == 1
    # Work for all cores keeps them, and very large tables keep parts of LINEAR_ROWS rows.
    assert model.in_few_parts(wide, 1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(model, "LINEAR_ROWS", 30)
    assert model.in_few_parts(wide, 400).rdd.getNumPartitions() == 14
    monkeypatch.undo()

    used = []

    class Watching(LogisticRegression):
        def _fit(self, dataset):
            used.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    monkeypatch.setattr(model, "LogisticRegression", Watching)
    design = tr.fit_design(training)
    rows = tr.feature_rows(training, design)
    parts = model.assemble(rows, design.features).select("SK_ID_CURR", "TARGET", "features").repartition(16)
    model.lasso_model(parts)
    model.elimination_rounds(parts, design.features, keep=len(design.features) - 1, step=1)
    tr.fit_pipeline(training.repartition(16), design, Watching(labelCol="TARGET", weightCol="weight", maxIter=2))
    assert used == [1] * 4


def test_importances_of_many_parts_are_fitted_in_few(spark, training, monkeypatch):
    used = []

    class Watching(GBTClassifier):
        def _fit(self, dataset):
            used.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    monkeypatch.setattr(model, "GBTClassifier", Watching)
    rows = training.select("SK_ID_CURR", "TARGET", "a", "c").repartition(16)
    got = {r["feature"]: r["importance"] for r in model.tree_importance(rows, ["a", "c"], rounds=2, depth=2).collect()}
    assert used == [1] and got["a"] > got["c"]


def test_the_registered_search_draws_from_the_whole_grid(spark):
    """Rounds included; the draws are made before any fit."""
    from creditloom.plans import model_queries

    assert model_queries.SEARCH_GRID == model.BOOSTING_GRID
    drawn = tr.draw_names(model.learners()[model_queries.BOOSTING], model_queries.SEARCH_GRID, model.DRAWS)
    assert len(drawn) == 6 and {s["maxIter"] for s in drawn.values()} == {200, 400}


def test_large_tables_keep_their_parts_however_many_fits_run(spark, training, monkeypatch):
    wide, cores = training.repartition(16), spark.sparkContext.defaultParallelism
    assert [model.in_few_parts(wide, 1, beside=k).rdd.getNumPartitions() for k in (1, 2, cores, 100)] == [cores, cores, 2, 1]
    monkeypatch.setattr(model, "LINEAR_ROWS", 30)
    assert model.in_few_parts(wide, 1, beside=100).rdd.getNumPartitions() == 14
