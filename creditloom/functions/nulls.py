"""Column helpers that carry the missing-value rules of the feature definitions.

A sum over nothing is 0, a maximum or mean over nothing stays NULL, a flag of a
missing comparison is 0, and ratios carry the small term EPS in the denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum0(x: Column | str) -> Column:
    """Sum that skips missing values and is 0 when none is left."""
    return F.coalesce(F.sum(_col(x)), F.lit(0))


def rows() -> Column:
    return F.count(F.lit(1))


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or missing."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(EPS))


def mean_seen(x: Column | str) -> Column:
    """Mean of the values seen, 0 when there is none."""
    x = _col(x)
    return ratio(sum0(x), F.count(x))


def mean_over_rows(x: Column | str) -> Column:
    """Sum of the values seen over all rows, missing ones included."""
    return ratio(sum0(x), rows())


def slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Least-squares slope from five sums."""
    mx, my = sx / n, sy / n
    return (sxy / n - mx * my) / (sxx / n - mx * mx + F.lit(EPS))


def slope_of(x: Column | str, y: Column | str) -> Column:
    """Aggregate: slope of Y over integer X, 0 below two rows.

    A missing Y adds nothing to its sums. When all X are equal the exact
    variance is 0 and the quotient would be rounding noise over EPS, so that
    case is recognised by min = max and is 0.
    """
    x = _col(x).cast("long")
    y = _col(y)
    value = slope(rows(), sum0(x), sum0(y), sum0(x * y), sum0(x * x))
    return F.when((rows() < 2) | (F.min(x) == F.max(x)), F.lit(0.0)).otherwise(value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; done once where data enters."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order of additions does not show.

    The rounding is one multiplication, addition, floor and division, which
    give the same bits in every engine; built-in rounding differs on halves.
    """
    scale = float(10**digits)
    return df.select(
        *[
            (F.floor(F.col(f.name) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
