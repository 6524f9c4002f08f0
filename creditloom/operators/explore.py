"""Exploration: counts, missing values, moments, correlations, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.nulls import rows
from creditloom.operators.order_stats import exact_quantiles


def one_row_to_rows(row_df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn a one-row aggregate into (name, value) rows."""
    return row_df.unpivot([], list(columns), name, value)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their percentage; the total sums the few counts, not the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(rows().alias("count"))
    total = df.agg(rows().alias("n")).scalar()
    return counts.withColumn("percentage", F.bround(F.col("count") * 100 / total, 2))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column in one pass."""
    names = df.columns
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null_count"))
                for c in names
            ]
        ).alias("all"),
        rows().alias("n"),
    )
    return counted.select(F.inline("all"), "n").select(
        "column", "null_count", F.bround(F.col("null_count") * 100 / F.col("n"), 2).alias("null_pct")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max, one row per column."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    entries = []
    for c in columns:
        v = F.col(c).cast("double")
        q = [F.lit(x).cast("double") for x in quartiles[c]]
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                q[0].alias("p25"),
                q[1].alias("p50"),
                q[2].alias("p75"),
                F.max(v).alias("max"),
            )
        )
    return df.agg(F.array(*entries).alias("all")).select(F.inline("all"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, sample variance and sample deviation, one row per column."""
    middle = exact_quantiles(df, columns)
    entries = []
    for c in columns:
        v = F.col(c).cast("double")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.avg(v).alias("mean"),
                F.lit(middle[c][0]).cast("double").alias("median"),
                F.var_samp(v).alias("variance"),
                F.stddev_samp(v).alias("std"),
            )
        )
    return df.agg(F.array(*entries).alias("all")).select(F.inline("all"))


def frequency_order(df: DataFrame, column: str) -> DataFrame:
    """Values by falling frequency; the first one is the mode."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(rows().alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )


def count_by_condition(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.groupBy(F.coalesce(condition, F.lit(False)).alias(name)).agg(rows().alias("count"))


def means_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Group means; rows without a key are left out, as in the source analysis."""
    seen = df.dropna(subset=list(keys))
    return seen.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])


def counts_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(rows().alias("count"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts per (row, column value); absent cells are 0."""
    return df.dropna(subset=[row, column]).groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values]
    )


def pairwise_corr(x: Column, y: Column) -> Column:
    """Pearson over rows where both are present; NULL when one side is constant.

    The built-in ``corr`` divides by zero for a constant column, which is an
    error in ANSI mode, so the quotient is taken here. The running deviation of
    equal values is exactly 0.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations_with(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target, all in one pass."""
    entries = [
        F.struct(F.lit(c).alias("feature"), pairwise_corr(F.col(c), F.col(target)).alias("corr")) for c in columns
    ]
    return df.agg(F.array(*entries).alias("all")).select(F.inline("all"))


def cells(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """Each value of ``columns`` as a row: the column's position ``at``, the value ``x`` as a double, and ``keep``.

    Aggregates over hundreds of columns side by side outgrow what Spark compiles;
    grouped by ``at`` they are one short aggregate, summed up before its shuffle.
    """
    each = [F.struct(F.lit(i).alias("at"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]
    return df.select(*keep, F.inline(F.array(*each)))


def correlations_of_cells(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``correlations_with`` for many columns; without rows there are no correlations either."""
    names = F.array(*map(F.lit, columns))
    found = cells(df, columns, F.col(target).alias("y")).groupBy("at").agg(pairwise_corr(F.col("x"), F.col("y")).alias("corr"))
    return found.select(F.get(names, F.col("at")).alias("feature"), "corr")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one pass; each unordered pair is computed once."""
    aggs = {
        (a, b): pairwise_corr(F.col(a), F.col(b)).alias(f"{i}_{j}")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    }
    wide = df.agg(*aggs.values())
    entries = [
        F.struct(
            F.lit(a).alias("feature_x"),
            F.lit(b).alias("feature_y"),
            F.col(f"{min(i, j)}_{max(i, j)}").alias("corr"),
        )
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, mean, median of named features; absent names are reported as not found."""
    there = [c for c in columns if c in df.columns]
    middle = exact_quantiles(df, there)
    entries = []
    for c in columns:
        v = F.col(c).cast("double") if c in there else F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(c in there).alias("found"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                F.lit(middle[c][0] if c in there else None).cast("double").alias("median"),
            )
        )
    return df.agg(F.array(*entries).alias("all")).select(F.inline("all"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins kept."""
    v = F.col(column).cast("double")
    edge = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(index.alias("bin")).agg(rows().alias("count"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("bin_end"),
    )
    return edges.join(counts, "bin", "left").select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count"))


def class_ratio(df: DataFrame, target: str = "TARGET") -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    y = F.col(target)
    neg, pos = F.count_if(y == 0), F.count_if(y == 1)
    return df.agg(neg.alias("negatives"), pos.alias("positives"), F.try_divide(neg, pos).alias("ratio"))


def cumulative_importance(importances: DataFrame, share: float = 0.90) -> DataFrame:
    """Features by falling importance with their running share and whether it stays within ``share``.

    One row per feature: the table is as long as the schema is wide, so one
    window over it is small.
    """
    order = Window.orderBy(F.desc("importance"), F.asc("feature"))
    running = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return importances.select(
        "feature",
        "importance",
        F.row_number().over(order).alias("rank"),
        F.try_divide(running, total).alias("cumulative"),
    ).withColumn("selected", F.coalesce(F.round("cumulative", 9) <= share, F.lit(False)))
