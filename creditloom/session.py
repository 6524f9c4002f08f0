"""Session settings and the shared folder used for tables that outlive one job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UNION_BY_KEY = "spark.sql.unionOutputPartitioning"
# Runtime settings every job relies on. They are SQL settings, so they can be
# applied to a session that somebody else has built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot contract or customer is split even where this costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins that are put together stay tasks of their own; one task for all of them sorts its part of each.
    UNION_BY_KEY: "false",
}


# Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "8", app: str = "creditloom", shuffle_partitions: int = 8, scratch: str | None = None
) -> SparkSession:
    """A single-JVM session for tests and the benchmark, with its own scratch folder."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", scratch or tempfile.mkdtemp(prefix="creditloom-"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Without the Python call site of every column expression, wide plans build several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. A local session that names
    none gets one folder of its own, a single machine being all there is; on a
    cluster that is an error, because an executor cannot see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="creditloom-")
        _OWN[context.applicationId] = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark)}/creditloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Used where one intermediate result feeds several jobs. The written table
    survives the loss of an executor and cuts the lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the store that the path names."""
    files, at = _located(spark, path)
    return files.exists(at)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            files, at = _located(df.sparkSession, path)
            files.delete(at, True)
            df._scratch_path = None
