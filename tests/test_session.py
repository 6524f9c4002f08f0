"""The settings fit a session that somebody else has built."""

import subprocess
import sys
from pathlib import Path

from creditloom.session import RUNTIME_CONF, configure, scratch_dir

ROOT = Path(__file__).resolve().parents[1]

FOREIGN_SESSION = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "Asia/Tokyo").getOrCreate())
sys.path.insert(0, sys.argv[1])
from creditloom.operators import model
from creditloom.plans import QUERIES
learners, importance = model.learners, model.tree_importance
model.learners = lambda: learners(trees=3, rounds=3, depth=3)
model.tree_importance = lambda rows, features, depth=3: importance(rows, features, rounds=3, depth=3)
print("rows", QUERIES["tree_shap_values"].build(spark, "/root/testdata/sf0.001").count())
print("rows", QUERIES["officer_windows_stream"].build(spark, "/root/testdata/sf0.001").count())
"""


def test_every_setting_can_be_changed_at_run_time(spark):
    assert all(spark.conf.isModifiable(key) for key in RUNTIME_CONF)


def test_configure_repairs_a_setting(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    assert configure(spark).conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == (named or scratch_dir(spark)).rstrip("/")


def test_queries_run_in_a_foreign_session(tmp_path):
    """A session with other settings, a working folder without the package on its path."""
    done = subprocess.run(
        [sys.executable, "-c", FOREIGN_SESSION, str(ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.count("rows") == 2, done.stderr[-2000:]


def test_discarded_tables_are_gone(spark):
    from pathlib import Path

    from creditloom.session import discard, materialize

    kept, gone = (materialize(spark.range(5), "tmp") for _ in range(2))
    folder = Path(gone._scratch_path.removeprefix("file:"))
    assert folder.exists()
    discard(gone, spark.range(3))
    discard(gone)
    assert not folder.exists() and kept.count() == 5
