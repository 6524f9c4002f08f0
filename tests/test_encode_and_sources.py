"""Encoding, alignment, overrides, readers and writers."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from creditloom.functions.nulls import nan_to_null
from creditloom.operators import clean, encode
from creditloom.sources import tables


def test_one_hot_always_has_a_missing_column(spark):
    df = spark.createDataFrame([(1, "x y", "k"), (2, "z", "k"), (3, None, "k")], "id long, a string, b string")
    got = encode.one_hot(df, ["a", "b"])
    assert got.columns == ["id", "a_x_y", "a_z", "a_nan", "b_k", "b_nan"]
    assert [tuple(r)[1:4] for r in got.orderBy("id").collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_too_many_categories_is_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("a"))
    with pytest.raises(ValueError, match="categories"):
        encode.categories(df, ["a"], limit=49)


def test_colliding_names_are_an_error(spark):
    with pytest.raises(ValueError, match="a_b"):
        encode.clean_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_align_to_feature_list(spark):
    got = encode.align_to(spark.createDataFrame([(1, 2)], "b int, extra int"), ["a", "b"])
    assert got.columns == ["a", "b"] and tuple(got.first()) == (0, 1)


def test_baseline_modes(spark):
    train = spark.createDataFrame([(i == 0, 2 + (i > 2), 0.5) for i in range(25)], "flag boolean, n int, x double")
    baseline = encode.fit_baseline(train, ["flag", "n", "x"])
    batch = spark.createDataFrame([(1, None)], "id int, x double")
    safe = encode.align_with_baseline(batch, baseline, ["id"]).first()
    parity = encode.align_with_baseline(batch, baseline, ["id"], mode="parity").first()
    assert (safe["flag"], parity["flag"]) == (False, True)
    assert safe["n"] == parity["n"] == 2 and safe["x"] == 0.5
    with pytest.raises(ValueError):
        encode.align_with_baseline(batch, baseline, mode="other")


def test_overrides(spark):
    base = spark.createDataFrame([(1, 5, 1.0, "t")], "SK_ID_CURR long, n int, x double, s string")
    rows = spark.createDataFrame(
        [(1, {"n": 7.9, "x": None, "nope": 1.0}), (2, {"n": 1.0})], "SK_ID_CURR long, updates map<string,double>"
    )
    assert tuple(encode.apply_overrides(base, rows).first()) == (1, 7, 1.0, "t")
    assert tuple(encode.apply_overrides(base, rows, missing="set").first()) == (1, 7, None, "t")


def test_cleaning_rules(spark):
    df = spark.createDataFrame([(365243, None), (-10, 4.0), (-30, 8.0)], "DAYS_EMPLOYED int, AMT_CREDIT double")
    got = clean.clean_application(df).orderBy("DAYS_EMPLOYED").collect()
    assert [r["DAYS_EMPLOYED"] for r in got] == [-30.0, -20.0, -10.0]
    assert [r["DAYS_EMPLOYED_ANOM"] for r in got] == [0, 1, 0]
    assert got[1]["AMT_CREDIT"] == 6.0


def test_nan_becomes_missing(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int"))
    assert df.agg(F.count("x"), F.max("x")).first() == (1, 2.0)


def test_candidates_are_numeric_without_key_and_target(spark):
    df = spark.createDataFrame([(1, 0, 1.0, "a", True)], "SK_ID_CURR long, TARGET int, x double, s string, b boolean")
    assert clean.candidate_columns(df) == ["x"]


def test_empty_columns_go(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert clean.drop_empty_columns(df, ["a", "b"]).columns == ["a"]


def test_row_positions_over_several_files(spark, tmp_path):
    for part, lo, hi in (("c", 40, 41), ("a", 0, 25), ("b", 25, 40)):
        (tmp_path / f"{part}.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(lo, hi)))
    got = tables.read_batch(spark, str(tmp_path), "v int").collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(i, i) for i in range(41)]


def test_row_positions_in_split_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = tables.read_batch(spark, str(tmp_path / "big.csv"), "v long")
        assert spark.read.csv(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 1
        assert got.where("id <> v").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_id_column_is_the_first_known_name():
    assert tables.find_id_column(["x", "Applicant_ID", "ID"]) == "Applicant_ID"
    assert tables.find_id_column(["x", "uid"]) is None


def test_wanted_columns_reach_the_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,x,2.5\n3,y,\n")
    df = tables.read_wanted(spark, str(tmp_path / "t.csv"), ["c", "a", "zz"], {"a": "int", "c": "double"})
    assert [tuple(r) for r in df.collect()] == [(1, 2.5), (3, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int,c:double>" in plan


@pytest.mark.parametrize(
    ("low", "high", "kind"),
    [
        (0, 254, "u8"),
        (0, 255, "u16"),
        (0, 65534, "u16"),
        (0, 65535, "u32"),
        (-127, 126, "i8"),
        (-128, 0, "i16"),
        (-1, 127, "i16"),
        (-32768, 0, "i32"),
        (-1, 2147483647, "i64"),
        (-2147483649, 0, "i64"),
        (0, 4294967295, "u64"),
    ],
)
def test_narrow_limits(low, high, kind):
    assert tables.narrow_type(low, high) == kind


def test_narrow_keeps_values(spark):
    df = spark.createDataFrame([(1, -5, 70000, 0.5, "s"), (200, 3, 1, 1.5, "t")], "a long, b long, c long, d double, e string")
    got = tables.narrow(df)
    assert dict(got.dtypes) == {"a": "smallint", "b": "tinyint", "c": "bigint", "d": "float", "e": "string"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_narrow_keeps_values_beyond_32_bits(spark):
    df = spark.createDataFrame([(-(2**40), 2**40), (5, 0)], "a long, b long")
    assert sorted(map(tuple, tables.narrow(df).collect())) == sorted(map(tuple, df.collect()))


def test_table_definition_follows_types(spark):
    df = spark.createDataFrame([(1, 2, 0.5, True, "x")], "id long, n int, x double, b boolean, s string")
    assert tables.create_table_ddl("t", df, "id") == (
        "CREATE TABLE t (`id` INTEGER PRIMARY KEY, `n` INTEGER, `x` REAL, `b` TEXT, `s` TEXT)"
    )


def test_feature_list_file(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(["B", "A"]))
    assert [tuple(r) for r in tables.read_feature_list(spark, str(tmp_path / "f.json")).collect()] == [(0, "B"), (1, "A")]


def test_missing_result_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.read_calibration(spark, str(tmp_path / "absent.json"))


# A published pair of calibration curves.
PUBLISHED = {
    "before": {
        "mean_predicted": [
            0.04329628002926306,
            0.13885347956971292,
            0.24189704004587254,
            0.342948349831925,
            0.4414412188044152,
            0.543252539647152,
            0.6415686050325369,
            0.739443270495738,
            0.8577998566924048,
        ],
        "actual_default_rate": [
            0.03966421372925613,
            0.15108546841384707,
            0.2519659239842726,
            0.3801580333625988,
            0.4436936936936937,
            0.5679611650485437,
            0.6547619047619048,
            0.8333333333333334,
            1.0,
        ],
    },
    "after": {
        "mean_predicted": [
            0.049604686296517285,
            0.13668452207698176,
            0.24451003439271665,
            0.34413143867135476,
            0.44758199086821054,
            0.5459333240402512,
            0.6484373470275748,
            0.751096025471771,
            0.8502891416687318,
            0.9340300713625457,
        ],
        "actual_default_rate": [
            0.04935933362966971,
            0.17803289924605895,
            0.27080820265379973,
            0.3299620733249052,
            0.3772819472616633,
            0.40672782874617736,
            0.4476987447698745,
            0.4970414201183432,
            0.5786163522012578,
            0.6818181818181818,
        ],
    },
    "brier_score_before": 0.06611722764412134,
    "brier_score_after": 0.06737865359080067,
}


def test_published_calibration_gap(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(PUBLISHED, indent=2))
    rows = tables.read_calibration(spark, str(tmp_path / "c.json"))
    gap = F.avg(F.abs(F.col("mean_predicted") - F.col("actual_default_rate"))).alias("gap")
    got = {r["stage"]: r["gap"] for r in rows.groupBy("stage").agg(gap).collect()}
    assert got["before"] == pytest.approx(0.037710, abs=5e-7)
    assert got["after"] == pytest.approx(0.127024, abs=5e-7)


def test_one_hot_with_stored_categories(spark):
    past = spark.createDataFrame([("x", "p"), ("y", None)], "a string, b string")
    known = encode.categories(past, ["a", "b"])
    new = spark.createDataFrame([("z", "p"), ("y", "q"), (None, None)], "a string, b string")
    got = encode.one_hot(new, known=known)
    assert got.columns == ["a_x", "a_y", "a_nan", "b_p", "b_nan"]
    assert [tuple(r) for r in got.collect()] == [(0, 0, 0, 1, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 1)]


def test_category_limit_is_per_column(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q")], "a string, b string")
    assert encode.categories(df, ["a", "b"], limit=2) == {"a": ["x", "y"], "b": ["p", "q"]}
    with pytest.raises(ValueError, match="more than 1 categories"):
        encode.categories(df, ["a", "b"], limit=1)


def test_typed_table_takes_appends_by_name(spark):
    from creditloom.session import scratch_path

    first = spark.createDataFrame([(1, 2, 0.5, True)], "id int, n int, x float, flag boolean")
    name = "typed_appends"
    tables.create_typed_table(first, name, "id", scratch_path(spark, name))
    try:
        tables.append_rows(first, name)
        tables.append_rows(spark.createDataFrame([(0.25, 2)], "x double, id long"), name)
        assert spark.table(name).dtypes == [("id", "bigint"), ("n", "bigint"), ("x", "double"), ("flag", "string")]
        rows = sorted(map(tuple, spark.table(name).collect()))
        assert rows == [(1, 2, 0.5, "true"), (2, None, 0.25, None)]
        with pytest.raises(ValueError, match="no columns"):
            tables.append_rows(spark.createDataFrame([(1, 2)], "id long, other int"), name)
    finally:
        spark.sql(f"drop table {name}")


def test_safe_search_takes_wildcards_literally(spark):
    from creditloom.operators.audit import search_applicants

    rows = spark.createDataFrame([(1, "a_b", 0), (2, "acb", 0), (3, "50% off", 1)], "SK_ID_CURR long, name string, TARGET int")
    names = lambda text, mode: [r["name"] for r in search_applicants(rows, text, mode=mode).collect()]
    assert names("a_b", "parity") == ["a_b", "acb"] and names("a_b", "safe") == ["a_b"]
    assert names("0%", "safe") == ["50% off"] and names("%", "safe") == ["50% off"]
