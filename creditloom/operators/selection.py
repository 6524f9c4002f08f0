"""Feature selection: correlation here, model-based methods next to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.explore import correlations_of_cells

MIN_CORRELATION = 0.02
MIN_VOTES = 2


def select_by_correlation(
    df: DataFrame, columns: Sequence[str], target: str, minimum: float = MIN_CORRELATION
) -> DataFrame:
    """Features whose correlation with the target is at least ``minimum`` in size."""
    return correlations_of_cells(df, columns, target).where(F.abs("corr") >= minimum)


def vote(candidates: DataFrame, chosen: dict[str, DataFrame], minimum: int = MIN_VOTES) -> DataFrame:
    """Flag per method, number of votes and the final choice for every candidate feature."""
    votes = None
    for method, table in chosen.items():
        part = table.select("feature", F.lit(method).alias("method"))
        votes = part if votes is None else votes.unionByName(part)
    flags = votes.groupBy("feature").agg(
        *[F.max((F.col("method") == m).cast("int")).alias(m) for m in chosen],
    )
    joined = candidates.select("feature").join(flags, "feature", "left").na.fill(0, list(chosen))
    total = sum((F.col(m) for m in chosen), F.lit(0))
    return joined.withColumn("votes", total).withColumn("selected", F.col("votes") >= minimum)
