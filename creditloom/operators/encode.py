"""One-hot columns, column alignment, baselines and what-if overrides."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The categorical application columns.
CATEGORICAL = [
    "NAME_CONTRACT_TYPE",
    "CODE_GENDER",
    "FLAG_OWN_CAR",
    "FLAG_OWN_REALTY",
    "NAME_TYPE_SUITE",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS",
    "NAME_HOUSING_TYPE",
    "OCCUPATION_TYPE",
    "WEEKDAY_APPR_PROCESS_START",
    "ORGANIZATION_TYPE",
    "FONDKAPREMONT_MODE",
    "HOUSETYPE_MODE",
    "WALLSMATERIAL_MODE",
    "EMERGENCYSTATE_MODE",
]
MAX_CATEGORIES = 10_000


def clean_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", name)


def clean_names(df: DataFrame) -> DataFrame:
    """Replace special characters in column names; two equal results are an error."""
    names = [clean_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after cleaning: {clash}")
    return df.toDF(*names)


def categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values of each column, found in one pass.

    They become column names, so their number must fit a schema: more than
    ``limit`` values of one column is an error, never a silent cut.
    """
    found = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .distinct()
        .limit(limit * len(columns) + 1)
        .collect()
    )
    known = {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}
    wide = [c for c in columns if len(known[c]) > limit]
    if wide:
        raise ValueError(f"more than {limit} categories in {wide}")
    return known


def one_hot(
    df: DataFrame, columns: Sequence[str] | None = None, known: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """0/1 column per category plus one for a missing value, names cleaned.

    ``known`` is a stored result of ``categories``: then no job runs, and a
    value outside it has 0 everywhere.
    """
    columns = [c for c in (columns or known or CATEGORICAL) if c in df.columns]
    if known is None:
        known = categories(df, columns) if columns else {}
    kept = [F.col(c) for c in df.columns if c not in columns]
    dummies = []
    for c in columns:
        for value in known[c]:
            dummies.append(F.when(F.col(c).cast("string") == value, 1).otherwise(0).alias(f"{c}_{value}"))
        dummies.append(F.when(F.col(c).isNull(), 1).otherwise(0).alias(f"{c}_nan"))
    return clean_names(df.select(*kept, *dummies))


def align_to(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the wanted features in order; absent ones are 0."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in features])


@dataclass(frozen=True)
class Baseline:
    """Mean and type of every training column; one number per column."""

    means: Mapping[str, float | None]
    types: Mapping[str, T.DataType]


def baseline_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean of each column."""
    booleans = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    return df.agg(*[F.avg(F.col(c).cast("int") if c in booleans else F.col(c)).alias(c) for c in columns])


def fit_baseline(df: DataFrame, columns: Sequence[str]) -> Baseline:
    return Baseline(baseline_means(df, columns).first().asDict(), {c: df.schema[c].dataType for c in columns})


def _default(mean: float | None, kind: T.DataType, mode: str) -> Column:
    if mean is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(mean != 0 if mode == "parity" else mean >= 0.5)
    if isinstance(kind, T.IntegralType):
        return F.lit(int(mean)).cast(kind)
    return F.lit(mean).cast(kind)


def align_with_baseline(df: DataFrame, baseline: Baseline, keep: Sequence[str] = (), mode: str = "safe") -> DataFrame:
    """Fill absent columns and missing values from the baseline, in training order and type.

    ``mode="parity"`` turns the mean of a flag into TRUE unless it is 0, so a
    batch without the flags gets all of them; ``"safe"`` uses the commoner value.
    """
    if mode not in ("safe", "parity"):
        raise ValueError(f"unknown mode {mode!r}")
    out = []
    for c, kind in baseline.types.items():
        default = _default(baseline.means[c], kind, mode)
        value = F.coalesce(F.col(c).cast(kind), default) if c in df.columns else default
        out.append(value.alias(c))
    return df.select(*keep, *out)


def apply_overrides(
    df: DataFrame,
    scenarios: DataFrame,
    key: str = "SK_ID_CURR",
    keep: Sequence[str] = (),
    missing: str = "ignore",
) -> DataFrame:
    """What-if rows: ``scenarios`` carries the key and ``updates map<string,double>``.

    Updates to unknown columns are ignored. A NULL update is ignored too, or
    sets the column to NULL with ``missing="set"``. Values are cast back to the
    column's type; derived ratios are not recomputed.
    """
    joined = df.join(scenarios, key)
    out = []
    for field in df.schema:
        c = F.col(field.name)
        if field.name == key or not isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            out.append(c)
            continue
        update = F.try_element_at(F.col("updates"), F.lit(field.name)).cast(field.dataType)
        if missing == "set":
            value = F.when(F.map_contains_key("updates", F.lit(field.name)), update).otherwise(c)
        else:
            value = F.coalesce(update, c)
        out.append(value.alias(field.name))
    return joined.select(*out, *keep)
