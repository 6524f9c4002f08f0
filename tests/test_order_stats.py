"""Exact ranks and running totals against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators.order_stats import exact_quantiles, exact_ranks, never_falls, ranks, running_totals
from creditloom.operators.sampling import (
    sample_rows,
    shuffle_key,
    split_and_folds,
    stratified_cut,
    stratified_folds,
    stratified_split,
)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    n = 20_000
    hot = np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n) * 10)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "hot": hot, "steps": rng.integers(0, 4, n).astype(float)})
    holes = pdf["a"].where(rng.random(n) > 0.1)
    pdf["holes"] = holes
    df = spark.createDataFrame(pdf).withColumn("holes", F.when(~F.isnan("holes"), F.col("holes")))
    return pdf, df.withColumn("empty", F.lit(None).cast("double"))


@pytest.mark.parametrize("small", [100_000, 200])
def test_quantiles(numbers, small):
    pdf, df = numbers
    probs = (0.25, 0.5, 0.75, 0.999)
    got = exact_quantiles(df, ["a", "hot", "steps", "holes", "empty"], probs, small=small)
    for c in ("a", "hot", "steps", "holes"):
        assert got[c] == pytest.approx(pdf[c].quantile(list(probs)).tolist(), abs=1e-12), c
    assert got["empty"] == [None] * 4


def test_extreme_ranks(numbers):
    pdf, df = numbers
    got = exact_ranks(df, {"a": F.col("a")}, lambda n: [0, n - 1], small=200)["a"]
    assert got == [pdf.a.min(), pdf.a.max()]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 11).alias("v"))
    got = running_totals(df, "k", {"s": F.col("v"), "n": F.lit(1)}, descending, buckets=37).toPandas()
    pdf = df.toPandas().sort_values("k", ascending=not descending)
    want = pdf.assign(s=pdf.v.cumsum(), n=range(1, len(pdf) + 1)).sort_values("k")
    got = got.sort_values("k")
    assert got.s.tolist() == want.s.tolist()
    assert got.n.tolist() == want.n.tolist()


def test_running_totals_of_one_key(spark):
    assert running_totals(spark.range(1), "id", {"n": F.lit(1)}).first()["n"] == 1
    assert running_totals(spark.range(0), "id", {"n": F.lit(1)}).count() == 0


def test_split_is_exact_even_when_hashes_collide(spark):
    # Keys a multiple of the modulus apart share their hash.
    far = spark.range(300).select((F.col("id") * 2147483647 + 5).alias("SK_ID_CURR"), F.lit(1).alias("TARGET"))
    near = spark.range(1000).select(F.col("id").alias("SK_ID_CURR"), F.lit(0).alias("TARGET"))
    split = stratified_split(far.union(near)).groupBy("TARGET", "is_train").count().collect()
    assert {(r[0], r[1]): r[2] for r in split} == {(1, True): 240, (1, False): 60, (0, True): 800, (0, False): 200}


def test_split_of_tiny_class(spark):
    df = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 12)], "SK_ID_CURR long, TARGET int")
    got = {(r[0], r[1]): r[2] for r in stratified_split(df).groupBy("TARGET", "is_train").count().collect()}
    assert got == {(1, True): 1, (0, True): 8, (0, False): 2}


def test_sample_size(spark):
    df = spark.range(1000).withColumnRenamed("id", "SK_ID_CURR")
    assert sample_rows(df, 100).distinct().count() == 100
    assert sample_rows(df, 5000).count() == 1000


def _spearman(low, high, spark):
    keys = spark.range(low, high).select("id", shuffle_key("id").alias("h")).orderBy("h").toPandas()["id"]
    return abs(np.corrcoef(np.arange(len(keys)), keys)[0, 1])


def test_hash_order_is_not_key_order(spark):
    assert _spearman(0, 15_000, spark) < 0.03
    assert _spearman(100_001, 456_256, spark) < 0.02


def test_folds_are_stratified_and_independent_of_the_split(spark):
    df = spark.range(3000).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 25 == 0).cast("int").alias("TARGET"))
    rows = df.withColumn("fold", stratified_folds(df)).withColumn("train", stratified_cut(df, 0.8)).collect()
    for label, size in ((0, 576), (1, 24)):
        assert [sum(r.fold == k and r.TARGET == label for r in rows) for k in range(5)] == [size] * 5
    shares = [np.mean([r.train for r in rows if r.fold == k]) for k in range(5)]
    assert max(shares) - min(shares) < 0.1


def test_ends_that_no_sketch_parts(spark):
    """Almost all rows at two values, many distinct ones between: the ends are cut off by counts."""
    between = np.random.default_rng(3).normal(size=40)
    values = np.sort(np.concatenate([np.full(150_000, -50.0), between, np.full(149_000, 50.0)]))
    df = spark.createDataFrame(pd.DataFrame({"a": values}))
    spots = [0, 149_999, 149_999.5, 150_000, 150_017.25, 150_039, 150_039.5, 150_040, len(values) - 1]
    got = exact_ranks(df, {"a": F.col("a")}, lambda n: spots, small=10)["a"]
    assert got == pytest.approx(np.interp(spots, np.arange(len(values)), values).tolist(), abs=1e-12)


def test_counts_around_a_rank(numbers):
    pdf, df = numbers
    (found,) = ranks(df, {"steps": F.col("steps")}, {"steps": lambda n: [n // 2]}, small=50)["steps"]
    assert found.below == int((pdf.steps < found.value).sum()) and found.at == int((pdf.steps == found.value).sum())
    assert found.n == len(pdf)


def _jobs(spark, build):
    group = f"jobs-{id(build)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        build().write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_split_and_folds_share_their_passes(spark):
    df = spark.range(3000).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 25 == 0).cast("int").alias("TARGET"))
    assert _jobs(spark, lambda: split_and_folds(df)) <= 8
    both = split_and_folds(df).collect()
    apart = {r.SK_ID_CURR: (r.is_train, r.fold) for r in stratified_split(df).withColumn("fold", stratified_folds(df)).collect()}
    assert {r.SK_ID_CURR: (r.is_train, r.fold) for r in both} == apart


def test_a_fall_is_found_wherever_it_is(spark):
    rising = spark.range(5000).select((F.col("id") % 4000 / 4000).alias("p"), (F.col("id") % 4000 * 1.0).alias("v"))
    assert never_falls(rising, "p", "v") and never_falls(rising, "p", "v", buckets=37)
    for at in (1, 2500, 3999):
        broken = rising.withColumn("v", F.when(F.col("v") != at, F.col("v")).otherwise(at - 1.5))
        assert not never_falls(broken, "p", "v", buckets=37) and not never_falls(broken, "p", "v", buckets=1)
        assert never_falls(broken, "p", "v", slack=0.5, buckets=37)


def test_falls_between_ranges_and_in_tables_without_pairs(spark):
    steps = spark.createDataFrame([(0.1, 3.0), (0.2, 2.0), (0.2, 1.0), (0.9, 0.5)], "p double, v double")
    assert not never_falls(steps, "p", "v", buckets=50) and never_falls(steps, "p", "v", slack=2.0, buckets=50)
    assert never_falls(steps.limit(1), "p", "v") and never_falls(steps.limit(0), "p", "v")
