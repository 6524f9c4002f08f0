"""The model queries with small learners: oracles, rows, and the steps that hand results on."""

import threading

import oracle
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from creditloom.operators import model
from creditloom.operators import training as tr
from creditloom.plans import QUERIES, model_queries

TRAINS = [n for n, q in QUERIES.items() if q.trains]


@pytest.fixture(scope="module", autouse=True)
def small_learners():
    """Few trees and rounds; everything else is as registered."""
    patch = pytest.MonkeyPatch()
    learners, importance = model.learners, model.tree_importance
    patch.setattr(model, "learners", lambda **k: learners(**({"trees": 8, "rounds": 4, "depth": 3} | k)))
    patch.setattr(model, "tree_importance", lambda rows, features, depth=3, **k: importance(rows, features, rounds=4, depth=3))
    patch.setattr(model_queries, "SEARCH_GRID", {"maxDepth": [2, 3, 4], "stepSize": [0.1, 0.3], "maxIter": [2, 3]})
    model_queries._STORED.clear()
    yield
    model_queries._STORED.clear()
    patch.undo()


@pytest.mark.parametrize("name", [n for n in TRAINS if QUERIES[n].sql is not None])
def test_matches_oracle(spark, sf001, name):
    assert oracle.compare(QUERIES[name].build(spark, sf001), oracle.connect(sf001), QUERIES[name].sql) == []


@pytest.mark.parametrize("name", [n for n in TRAINS if QUERIES[n].sql is None])
def test_has_rows(spark, sf001, name):
    assert QUERIES[name].build(spark, sf001).count() > 0


def test_every_number_has_a_check():
    numbers = [q.covers for n, q in QUERIES.items() if q.trains and q.sql is not None]
    covered = {c.strip() for covers in numbers for c in covers.split(",")}
    for n, q in QUERIES.items():
        if q.trains and q.sql is None:
            assert {c.strip() for c in q.covers.split(",")} & covered, n


def test_rows_are_assembled_once(spark, sf001):
    before = model_queries._rows(spark, sf001)
    assert model_queries._rows(spark, sf001) is before
    assert before.where("is_train and fold is not null").count() == before.where("fold is not null").count()


def test_results_whose_files_are_gone_are_built_again(spark, sf001):
    from creditloom.session import discard

    first = model_queries._votes(spark, sf001)
    wanted = sorted(map(tuple, first.collect()))
    path = first._scratch_path
    discard(first)
    first._scratch_path = path
    assert sorted(map(tuple, model_queries._votes(spark, sf001).collect())) == wanted


def test_boosted_refit_runs_beside_the_folds(spark, sf001, monkeypatch):
    later = {"fold-scores", "fold-areas", "scorer", f"fitted {model_queries.BOOSTING}"}
    monkeypatch.setattr(model_queries, "_STORED", {at: v for at, v in model_queries._STORED.items() if at[2] not in later})
    both, folds, refit = threading.Barrier(2), tr.out_of_fold, tr.fit_pipeline

    def folds_wait(*args, **kwargs):
        both.wait(60)
        return folds(*args, **kwargs)

    def refit_waits(rows, design, estimator, *args, **kwargs):
        if isinstance(estimator, GBTClassifier):
            both.wait(60)
        return refit(rows, design, estimator, *args, **kwargs)

    monkeypatch.setattr(tr, "out_of_fold", folds_wait)
    monkeypatch.setattr(tr, "fit_pipeline", refit_waits)
    assert tr.load_scorer(spark, model_queries._scorer(spark, sf001))[1].features
    assert not both.broken


def test_scaling_and_correlations_run_beside_the_importances(spark, sf001, monkeypatch):
    later = {"scaled", "importance", "rounds", "lasso", "correlated", "votes"}
    monkeypatch.setattr(model_queries, "_STORED", {at: v for at, v in model_queries._STORED.items() if at[2] not in later})
    all_three = threading.Barrier(3)

    def waiting(work):
        def run(*args, **kwargs):
            all_three.wait(60)
            return work(*args, **kwargs)

        return run

    monkeypatch.setattr(model, "tree_importance", waiting(model.tree_importance))
    monkeypatch.setattr(model, "fit_scaling", waiting(model.fit_scaling))
    monkeypatch.setattr(model_queries, "select_by_correlation", waiting(model_queries.select_by_correlation))
    assert model_queries._votes(spark, sf001).count() == len(model_queries._design(spark, sf001).features)
    assert not all_three.broken


def _keys(df):
    return sorted(r[0] for r in df.select("SK_ID_CURR").collect())


def test_selection_works_on_all_training_rows(spark, sf001):
    wanted = _keys(model_queries._train(spark, sf001))
    assert len(wanted) == round(0.8 * model_queries._rows(spark, sf001).count())
    for rows in (model_queries._candidates, model_queries._scaled, model_queries._vectors):
        assert _keys(rows(spark, sf001)) == wanted, rows.__name__
    assert _keys(QUERIES["discriminant_projection"].build(spark, sf001)) == wanted


def test_families_and_calibration_learn_from_all_training_rows(spark, sf001, monkeypatch):
    train = {tuple(r) for r in model_queries._train(spark, sf001).select("SK_ID_CURR", "TARGET").collect()}
    scores = model_queries._fold_scores(spark, sf001).select("model", "id", "y").collect()
    for name in model.learners():
        own = [(r["id"], r["y"]) for r in scores if r["model"] == name]
        assert len(own) == len(train) and set(own) == train, name
    seen, fit = [], model.fit_platt
    monkeypatch.setattr(model, "fit_platt", lambda rows: (seen.append(rows.count()), fit(rows))[1])
    monkeypatch.setattr(model_queries, "_STORED", {at: v for at, v in model_queries._STORED.items() if at[2] != "calibrated"})
    model_queries._calibrated(spark, sf001)
    assert seen == [len(train)]


def test_folds_are_even_in_the_tuning_rows_and_in_all(spark, sf001):
    rows = model_queries._rows(spark, sf001)
    assert rows.where("fold is not null and not is_train or fold is null and is_train").isEmpty()
    for part in (rows.where("tuning"), rows.where("is_train and not tuning")):
        for target in (0, 1):
            sizes = [r["count"] for r in part.where(F.col("TARGET") == target).groupBy("fold").count().collect()]
            assert len(sizes) == model_queries.FOLDS and max(sizes) - min(sizes) <= 1


def test_the_order_of_all_calibrated_scores_is_checked(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.col("id").alias("SK_ID_CURR"), (F.col("id") % 2).cast("int").alias("TARGET"), (F.col("id") / 3000).alias("p")
    )

    def rising(tested):
        monkeypatch.setattr(model_queries, "_calibrated", lambda *at: tested)
        return QUERIES["platt_check"].build(spark, "unused").first()["rising"]

    kept = rows.withColumn("p_calibrated", F.col("p") / 2)
    assert rising(kept)
    assert not rising(kept.withColumn("p_calibrated", F.when(F.col("SK_ID_CURR") != 2900, F.col("p_calibrated")).otherwise(0.1)))


def test_fits_at_the_same_time_share_the_cores(spark, sf001, monkeypatch):
    """Many rows in a few tasks of each fit: two tasks a core in all, not one task a core for every fit."""
    cores, used = spark.sparkContext.defaultParallelism, {}
    monkeypatch.setattr(model, "TREE_ROWS", 10)
    later = {"vectors", "fold-scores", "fold-areas", "search"}
    monkeypatch.setattr(model_queries, "_STORED", {at: v for at, v in model_queries._STORED.items() if at[2] not in later})

    class Seen(Exception):
        pass

    def watch(data, estimators, path, folds, parallelism):
        used[parallelism] = data.rdd.getNumPartitions()
        raise Seen

    monkeypatch.setattr(tr, "out_of_fold", watch)
    for step in (model_queries._fold_scores, model_queries._search):
        with pytest.raises(Seen):
            step(spark, sf001)
    assert set(used) == {model_queries.FITS, model_queries.SEARCH_FITS}
    assert all(n * fits <= 2 * cores + fits and n < cores for fits, n in used.items())
