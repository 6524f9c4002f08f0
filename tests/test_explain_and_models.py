"""Contributions, rankings, learners, projections and the tree explainer."""

from itertools import combinations
from math import exp, factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from creditloom.operators import explain, model
from creditloom.operators.explore import correlations_with
from creditloom.operators.selection import select_by_correlation, vote
from creditloom.operators.tree_explain import base_value, contributions, leaf_contributions, leaves_of, tree_contributions

MODEL = explain.LinearModel(0.5, {"a": 2.0, "b": -1.0, "c": 0.25}, {"a": 1.0, "b": 3.0, "c": 0.0})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 2.0, 3.0, 4.0), (2, None, 0.0, 0.0)], "SK_ID_CURR long, a double, b double, c double")


def test_linear_additivity(rows):
    for r in explain.explain(rows, MODEL).collect():
        margin = r["base_value"] + sum(f["shap_value"] for f in r["explanation"])
        assert r["probability"] == pytest.approx(1 / (1 + exp(-margin)))
        strength = [abs(f["shap_value"]) for f in r["explanation"]]
        assert strength == sorted(strength, reverse=True)


def test_missing_value_contributes_nothing(rows):
    second = explain.explain(rows, MODEL).where("SK_ID_CURR = 2").first()["explanation"]
    entry = [f for f in second if f["feature"] == "a"][0]
    assert entry["shap_value"] == 0 and entry["feature_value"] is None
    assert [f["feature"] for f in second] == ["b", "a", "c"]  # equal strength keeps column order


def test_stored_ranking_equals_row_ranking(rows):
    explained = explain.explain(rows, MODEL)
    long = explain.factors_long(explained)
    stored = explain.top_factors_stored(long.drop("rank"), 2)
    key = lambda df: sorted((r["SK_ID_CURR"], r["rank"], r["feature"]) for r in df.where("SK_ID_CURR = 1").collect())
    assert key(stored) == key(explain.factors_long(explained, top=2))


def test_waterfall_reaches_the_log_odds(rows):
    steps = explain.waterfall(explain.explain(rows, MODEL), top=2).where("SK_ID_CURR = 1").orderBy("step").collect()
    assert [s["type"] for s in steps] == ["base", "contrib", "contrib", "final"]  # the rest is exactly 0
    assert all(a["end"] == pytest.approx(b["start"]) for a, b in zip(steps[:-2], steps[1:-1], strict=True))
    assert steps[-1]["start"] == 0 and steps[-1]["end"] == pytest.approx(steps[-2]["end"])
    one = explain.waterfall(explain.explain(rows, MODEL), top=1).where("SK_ID_CURR = 1").collect()
    assert [s["feature"] for s in one] == ["BASE_VALUE", "a", "OTHER_FEATURES", "FINAL_PREDICTION"]


def test_normalized_values(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 5.0, None), (2, 4.0, 5.0, None), (3, None, 5.0, None)],
        "SK_ID_CURR long, x double, same double, none double",
    )
    got = {(r[0], r[1]): r[3] for r in explain.normalized_values(df, ["x", "same", "none"]).collect()}
    assert got == {(1, "x"): 0.0, (2, "x"): 1.0, (3, "x"): 0.5, (1, "same"): 0.0, (2, "same"): 0.0, (3, "same"): 0.0}


def test_glossary_finds_by_name(spark):
    features = spark.createDataFrame([("EXT_SOURCE_2",), ("DAYS_ID_PUBLISH",), ("AMT_CREDIT",)], "feature string")
    assert [r["feature"] for r in explain.glossary(features, "CREDIT").collect()] == ["EXT_SOURCE_2", "AMT_CREDIT"]
    assert [r["display_name"] for r in explain.glossary(features, "publish").collect()] == ["Days Id Publish"]


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n) * 0.5 > 0.5).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(SK_ID_CURR=np.arange(n), TARGET=y)
    return pdf, spark.createDataFrame(pdf).select(F.col("SK_ID_CURR").cast("long"), F.col("TARGET").cast("int"), *"abcd")


@pytest.fixture(scope="module")
def boosted(training):
    _, df = training
    gbt = GBTClassifier(labelCol="TARGET", maxIter=4, maxDepth=2, stepSize=0.3, seed=1)
    return gbt.fit(model.assemble(df, list("abcd")))


def test_tree_additivity(spark, training, boosted):
    _, df = training
    wide, base = tree_contributions(df, boosted, list("abcd"))
    total = sum((F.col(c) for c in "abcd"), F.lit(base))
    rebuilt = wide.select(F.col("SK_ID_CURR").alias("id"), (1 / (1 + F.exp(-total))).alias("q"))
    scored = model.score(boosted, model.assemble(df, list("abcd")))
    worst = rebuilt.join(scored, "id").agg(F.max(F.abs(F.col("q") - F.col("probability"))), F.count("id")).first()
    assert worst[0] < 1e-9 and worst[1] == 600


def test_tree_contributions_are_shapley_values(spark, training, boosted):
    """Against the definition: all subsets, unknown features weighted by the training shares."""
    pdf, _ = training
    leaves = leaves_of(spark, boosted)
    x = pdf[list("abcd")].to_numpy()[:25]

    def value(row, known):
        total = 0.0
        for v, features, low, high, share in leaves:
            factor = v
            for k, f in enumerate(features):
                factor *= float(low[k] < row[f] <= high[k]) if f in known else share[k]
            total += factor
        return total

    got = contributions(x, leaves)
    for r, row in enumerate(x):
        assert value(row, set()) == pytest.approx(base_value(leaves))
        for i in range(4):
            others = [j for j in range(4) if j != i]
            phi = sum(
                factorial(k) * factorial(3 - k) / factorial(4) * (value(row, {*s, i}) - value(row, set(s)))
                for k in range(4)
                for s in combinations(others, k)
            )
            assert got[r, i] == pytest.approx(phi, abs=1e-10)


def test_weights_equal_enumeration_of_all_coalitions():
    """EXTEND and UNWIND against the sum over all coalitions, for every pattern of a path of three and of six features."""
    rng = np.random.default_rng(5)
    for d in (1, 3, 6):
        share = rng.uniform(0.05, 0.95, d)
        inside = ((np.arange(2**d)[:, None] >> np.arange(d)) & 1).astype(float)
        got = leaf_contributions(2.5, inside, share)
        for p, row in enumerate(inside):
            for i in range(d):
                others = [j for j in range(d) if j != i]
                want = sum(
                    factorial(k) * factorial(d - 1 - k) / factorial(d)
                    * np.prod([row[j] if j in s else share[j] for j in others])
                    for k in range(d)
                    for s in combinations(others, k)
                ) * (row[i] - share[i]) * 2.5
                assert got[p, i] == pytest.approx(want, abs=1e-12)


def test_patterns_of_few_features_are_found_without_sorting(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[rng.random(x.shape) < 0.1] = np.nan
    leaves = [
        (float(rng.normal()), tuple(rng.choice(6, k, replace=False).tolist()), rng.normal(size=k) - 1, rng.normal(size=k) + 1, rng.random(k))
        for k in (1, 3, 5, 5, 0)
    ]
    wanted = np.zeros_like(x)
    for value, features, low, high, share in leaves:
        at = list(features)
        for row, own in enumerate(x) if at else ():
            inside = ((own[at] > low) & (own[at] <= high)).astype(float)
            wanted[row, at] += leaf_contributions(value, inside[None], share)[0]
    few = contributions(x[:20], leaves)  # more patterns than rows: sorted
    monkeypatch.setattr(np, "unique", None)
    found = contributions(x, leaves)
    assert np.allclose(found, wanted, rtol=0, atol=1e-12)
    assert np.array_equal(found[:20], few)
    assert contributions(x[:0], leaves[-1:]).shape == (0, 6)


def test_deep_trees_and_forests_are_additive(spark, training):
    pdf, df = training
    data = model.assemble(df, list("abcd"))
    deep = GBTClassifier(labelCol="TARGET", maxIter=6, maxDepth=9, stepSize=0.3, seed=1).fit(data)
    wide, base = tree_contributions(data, deep, list("abcd"), vector="features")
    total = sum((F.col(c) for c in "abcd"), F.lit(base))
    rebuilt = wide.select(F.col("SK_ID_CURR").alias("id"), (1 / (1 + F.exp(-total))).alias("q"))
    assert rebuilt.join(model.score(deep, data), "id").where("abs(q - probability) > 1e-9").isEmpty()
    forest = RandomForestClassifier(labelCol="TARGET", numTrees=7, maxDepth=6, seed=2).fit(data)
    wide, base = tree_contributions(df, forest, list("abcd"))
    rebuilt = wide.select(F.col("SK_ID_CURR").alias("id"), sum((F.col(c) for c in "abcd"), F.lit(base)).alias("q"))
    assert rebuilt.join(model.score(forest, data), "id").where("abs(q - probability) > 1e-9").isEmpty()


def test_preparation_fills_and_flags(spark):
    df = spark.createDataFrame(
        [(1, 0, 1.0, None), (2, 1, None, None), (3, 0, 3.0, None)],
        "SK_ID_CURR long, TARGET int, x double, gone double",
    )
    prep = model.fit_preparation(df, ["x", "gone"])
    assert prep.features == ["x", "x_missing"]
    got = model.prepare(df, prep).orderBy("SK_ID_CURR").collect()
    assert [(r["x"], r["x_missing"]) for r in got] == [(1.0, 0.0), (2.0, 1.0), (3.0, 0.0)]


def test_scaling_uses_population_deviation(training):
    pdf, df = training
    scaled = model.scale(df, model.fit_scaling(df, list("abcd"))).toPandas()
    want = (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)
    assert scaled.sort_values("SK_ID_CURR").a.to_numpy() == pytest.approx(want.to_numpy(), abs=1e-12)


def test_scaling_of_gaps_constants_and_no_rows(spark):
    rows = spark.createDataFrame([(1.0, 2, None), (None, 2, None), (4.0, 2, None)], "a double, b int, c double")
    assert model.fit_scaling(rows, list("cab")) == {"c": (None, 1.0), "a": (2.5, 1.5), "b": (2.0, 1.0)}
    assert model.fit_scaling(rows.where("b > 2"), ["a"]) == {"a": (None, 1.0)}


def test_selection_by_correlation_is_one_aggregate_for_any_number_of_columns(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame(rng.normal(size=(200, 120)), columns=[f"c{i}" for i in range(120)])
    table["y"] = (table["c5"] + rng.normal(size=200) > 0).astype(int)
    table["c6"], table["c7"] = 1.0, table["c7"].where(rng.random(200) < 0.7)
    names = [f"c{i}" for i in range(120)]
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), ", ".join(f"{c} double" for c in names) + ", y int")
    chosen = select_by_correlation(df, names, "y")
    wanted = {r["feature"]: r["corr"] for r in correlations_with(df, names, "y").where("abs(corr) >= 0.02").collect()}
    assert {r["feature"]: r["corr"] for r in chosen.collect()} == pytest.approx(wanted, abs=1e-12)
    assert "c5" in wanted and "c6" not in wanted
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("covar_pop(") == 1
    assert select_by_correlation(df.where("y > 1"), names, "y").count() == 0


def test_balanced_weights(training):
    pdf, df = training
    weights = model.with_balanced_weight(df).groupBy("TARGET").agg(F.sum("weight").alias("w"))
    sums = {r["TARGET"]: r["w"] for r in weights.collect()}
    assert sums[0] == pytest.approx(300) and sums[1] == pytest.approx(300)


def test_selection_by_models(training):
    _, df = training
    scaled = model.scale(df, model.fit_scaling(df, list("abcd")))
    kept = {r["feature"] for r in model.eliminate(scaled, list("abcd"), keep=2, step=1).collect()}
    assert kept == {"a", "b"}
    strong = {r["feature"] for r in model.lasso_selected(scaled, list("abcd"), c=0.01).collect()}
    assert "a" in strong
    importance = model.tree_importance(df, list("abcd"), rounds=3, depth=2)
    assert importance.orderBy(F.desc("importance")).first()["feature"] == "a"


def test_votes(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "feature string")
    got = vote(names("a", "b", "c"), {"one": names("a", "b"), "two": names("b"), "three": names("b", "a")})
    assert {r["feature"]: (r["votes"], r["selected"]) for r in got.collect()} == {"a": (2, True), "b": (3, True), "c": (0, False)}


def test_principal_components(training):
    pdf, df = training
    scaled = model.scale(df, model.fit_scaling(df, list("abcd")))
    _, table = model.principal_components(scaled, list("abcd"))
    got = table.orderBy("component").toPandas()
    z = ((pdf[list("abcd")] - pdf[list("abcd")].mean()) / pdf[list("abcd")].std(ddof=0)).to_numpy()
    share = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert got.explained.to_numpy() == pytest.approx(share / share.sum(), abs=1e-9)
    assert got.cumulative.iloc[-1] == pytest.approx(1)
    assert got.needed.sum() == int(np.argmax(np.cumsum(share / share.sum()) >= 0.95)) + 1


def test_discriminant(training):
    pdf, df = training
    scaled = model.scale(df, model.fit_scaling(df, list("abcd")))
    weights = model.discriminant(scaled, list("abcd"))
    z = ((pdf[list("abcd")] - pdf[list("abcd")].mean()) / pdf[list("abcd")].std(ddof=0)).to_numpy()
    y = pdf.TARGET.to_numpy()
    within = sum(np.cov(z[y == c].T, ddof=0) * (y == c).sum() for c in (0, 1)) / (len(y) - 2)
    w = np.linalg.solve(within, z[y == 1].mean(0) - z[y == 0].mean(0))
    assert list(weights.values()) == pytest.approx(w / np.sqrt(w @ within @ w), abs=1e-8)
    projected = model.project(scaled, weights).toPandas()
    spread = sum(((g.projection - g.projection.mean()) ** 2).sum() for _, g in projected.groupby("TARGET"))
    assert spread / (len(y) - 2) == pytest.approx(1)


def test_platt_on_held_out_rows(training, boosted):
    _, df = training
    scored = model.margins(boosted, model.assemble(df, list("abcd")))
    assert scored.where("abs(1 / (1 + exp(-margin)) - p) > 1e-9").isEmpty()
    slope, intercept = model.fit_platt(scored)
    row = model.apply_platt(scored, slope, intercept).agg(F.avg("p_calibrated"), F.avg("TARGET")).first()
    assert slope > 0 and row[0] == pytest.approx(row[1], abs=1e-4)


def test_draws_are_seeded_and_different():
    gbt = GBTClassifier()
    grid = model.BOOSTING_GRID
    one, two = (model.random_draws(gbt, grid, 6, 42) for _ in range(2))
    key = lambda draws: [tuple(sorted((p.name, v) for p, v in d.items())) for d in draws]
    assert key(one) == key(two) and len(set(key(one))) == 6


def test_compare_refit_and_reload(spark, training):
    from creditloom.session import scratch_path

    _, df = training
    data = model.assemble(df, list("abcd"))
    candidates = {k: v for k, v in model.learners(trees=3, depth=2).items() if k != "Gradient Boosting"}
    table = model.cross_validate(data, candidates, folds=2)
    assert table.count() == 2 and table.where("roc_auc_mean between 0.5 and 1").count() == 2
    path = scratch_path(spark, "test-model")
    best = model.refit_best(data, candidates, table, path)
    again = type(best).load(path)
    a, b = (model.score(m, data).agg(F.sum("probability")).first()[0] for m in (best, again))
    assert a == pytest.approx(b)
