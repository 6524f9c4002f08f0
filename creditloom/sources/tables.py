"""Reading and writing the raw tables, batch uploads and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.nulls import nan_to_null

ID_NAMES = ("sk_id_curr", "id", "applicant_id")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give a schema where it is known: inference reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in file order."""
    return spark.read.option("header", True).csv(path).columns


def read_wanted(spark: SparkSession, path: str, wanted: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """Only those of the wanted columns that the file has; the reader skips the rest."""
    header = csv_header(spark, path)
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(types.get(c, "string"))) for c in header])
    return read_csv(spark, path, schema).select(*[c for c in header if c in wanted])


def read_parquet_rows(spark: SparkSession, path: str, columns: Sequence[str], ids: DataFrame, key: str) -> DataFrame:
    """Projection plus an id list of any length, as a semi-join."""
    return spark.read.parquet(path).select(*columns).join(ids.select(key), key, "left_semi")


def find_id_column(columns: Sequence[str]) -> str | None:
    """First column whose name, in any case, is a known id name."""
    return next((c for c in columns if c.lower() in ID_NAMES), None)


def with_row_position(df: DataFrame) -> DataFrame:
    """Add ``id``, the 0-based position of the row over all files.

    Within one block of a file, rows come in file order; each block is no longer
    than a read split. The start of each block is the number of rows before it.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    # One row per block of the input, not per row of data.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_file", "_block").orderBy("_seen")
    return (
        placed.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, ["_file", "_block"])
        .withColumn("id", (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_file", "_block", "_seen", "_at", "_start")
    )


def read_batch(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """An uploaded batch with its ``id``: from an id column if there is one, else the row position."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    name = find_id_column(df.columns)
    if name is None:
        return nan_to_null(with_row_position(df))
    others = [F.col(c) for c in df.columns if c != name]
    return nan_to_null(df.select(F.col(name).cast("long").alias("id"), *others))


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Limits of the narrowed integer types, (strict upper bound, type).
UNSIGNED = [(255, "u8"), (65535, "u16"), (4294967295, "u32"), (None, "u64")]
SIGNED = [(127, 128, "i8"), (32767, 32768, "i16"), (2147483647, 2147483648, "i32"), (None, None, "i64")]
SPARK_TYPE = {
    "u8": "short",
    "u16": "int",
    "u32": "long",
    "u64": "long",
    "i8": "byte",
    "i16": "short",
    "i32": "int",
    "i64": "long",
    "f32": "float",
}


def narrow_type(low: int, high: int) -> str:
    """Smallest type for integers between low and high."""
    if low >= 0:
        return next(name for top, name in UNSIGNED if top is None or high < top)
    return next(name for top, bottom, name in SIGNED if top is None or (high < top and low > -bottom))


def narrow_plan(df: DataFrame) -> dict[str, str]:
    """Narrow type per numeric column; all integer ranges come from one pass."""
    plan = {f.name: "f32" for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    if ints:
        seen = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in ints]).first()
        plan |= {c: narrow_type(seen[c]["lo"], seen[c]["hi"]) for c in ints if seen[c]["lo"] is not None}
    return {c: plan[c] for c in df.columns if c in plan}


def narrow(df: DataFrame) -> DataFrame:
    """Cast every numeric column to its narrow type; text is left to the dictionary encoding of parquet."""
    plan = narrow_plan(df)
    return df.select(*[F.col(c).cast(SPARK_TYPE[plan[c]]).alias(c) if c in plan else F.col(c) for c in df.columns])


def narrow_report(df: DataFrame) -> DataFrame:
    """The chosen type of every numeric column."""
    rows = [(c, t, SPARK_TYPE[t]) for c, t in narrow_plan(df).items()]
    return df.sparkSession.createDataFrame(rows, "column string, narrow_type string, spark_type string")


def declared_sql_type(kind: T.DataType) -> str:
    """Column type of the relational log for a DataFrame type; flags and the rest become text."""
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "REAL"
    return "TEXT"


def create_table_ddl(name: str, df: DataFrame, key: str) -> str:
    """CREATE TABLE text whose columns follow the DataFrame's types."""
    columns = [f"`{f.name}` {declared_sql_type(f.dataType)}" for f in df.schema if f.name != key]
    return f"CREATE TABLE {name} (`{key}` INTEGER PRIMARY KEY, {', '.join(columns)})"


# The declared types as Spark names them.
_SPARK_SQL = {"INTEGER": "BIGINT", "REAL": "DOUBLE", "TEXT": "STRING"}


def create_typed_table(df: DataFrame, name: str, key: str, path: str) -> None:
    """Catalog table over ``path`` with the key first and the declared type of every column; no row is written."""
    columns = [f"`{key}` BIGINT"]
    columns += [f"`{f.name}` {_SPARK_SQL[declared_sql_type(f.dataType)]}" for f in df.schema if f.name != key]
    df.sparkSession.sql(f"CREATE TABLE {name} ({', '.join(columns)}) USING parquet LOCATION '{path}'")


def append_rows(df: DataFrame, name: str) -> None:
    """Append rows to a catalog table, matched by name and cast to its types; what is there stays as it is.

    Columns the table does not have are an error, columns that ``df`` lacks become NULL.
    """
    target = df.sparkSession.table(name).schema
    unknown = [c for c in df.columns if c not in target.names]
    if unknown:
        raise ValueError(f"{name} has no columns {unknown}")
    have = set(df.columns)
    row = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target]
    df.select(*row).write.insertInto(name)


def create_and_append(df: DataFrame, path: str, bucket_key: str | None = None, buckets: int = 64) -> None:
    """Append rows to a parquet table laid out by hash bucket of the key, creating it when absent."""
    writer = df
    partition = []
    if bucket_key:
        writer = df.withColumn("bucket", F.pmod(F.xxhash64(bucket_key), F.lit(buckets)))
        writer = writer.repartition("bucket", spread(bucket_key))
        partition = ["bucket"]
    writer.write.mode("append").partitionBy(*partition).parquet(path)


def spread(key: str, parts: int = 8) -> Column:
    """A second hash of the key, so that one bucket is written by several tasks."""
    return F.pmod(F.hash(key), F.lit(parts))


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a history table bucketed by its join key and return it as a table.

    Aggregations and joins on the key then need no shuffle. One bucket is read
    by one task, so keep tables with a very frequent key in plain parquet.
    """
    writer = df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_small_json(df: DataFrame, path: str) -> None:
    """One file; only for results as small as a metrics table or a feature list."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of names as rows with their position."""
    text = spark.read.option("wholetext", True).text(path)
    names = F.from_json("value", "array<string>")
    return text.select(F.posexplode(names).alias("position", "feature"))


CALIBRATION_SCHEMA = (
    "before struct<mean_predicted: array<double>, actual_default_rate: array<double>>,"
    " after struct<mean_predicted: array<double>, actual_default_rate: array<double>>,"
    " brier_score_before double, brier_score_after double"
)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Stored calibration arrays as rows; a missing file is an error."""
    stored = spark.read.schema(CALIBRATION_SCHEMA).option("multiLine", True).json(path)
    parts = []
    for stage in ("before", "after"):
        pairs = F.arrays_zip(F.col(f"{stage}.mean_predicted"), F.col(f"{stage}.actual_default_rate"))
        parts.append(
            stored.select(F.lit(stage).alias("stage"), F.posexplode(pairs).alias("point", "pair")).select(
                "stage", "point", "pair.mean_predicted", "pair.actual_default_rate"
            )
        )
    return parts[0].unionByName(parts[1])


def calibration_document(curves: Mapping[str, DataFrame], brier: Mapping[str, DataFrame]) -> DataFrame:
    """The one-row document with both curves and both Brier scores."""

    def arrays(curve: DataFrame) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("bin", "mean_predicted", "actual_rate")))
        return curve.agg(
            F.struct(
                F.transform(ordered, lambda r: r["mean_predicted"]).alias("mean_predicted"),
                F.transform(ordered, lambda r: r["actual_rate"]).alias("actual_default_rate"),
            )
        ).scalar()

    spark = next(iter(curves.values())).sparkSession
    return spark.range(1).select(
        arrays(curves["before"]).alias("before"),
        arrays(curves["after"]).alias("after"),
        brier["before"].scalar().alias("brier_score_before"),
        brier["after"].scalar().alias("brier_score_after"),
    )
