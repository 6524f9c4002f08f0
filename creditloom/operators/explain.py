"""Per-applicant contributions of a linear model, rankings and summaries over them.

Contributions stay in the applicant's row as one array until a caller needs long
rows, so ranking, narration and waterfalls need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.catalog import DESCRIPTIONS, DISPLAY_NAMES, display_name
from creditloom.functions.risk import sigmoid
from creditloom.functions.text import factor_line

KEY = "SK_ID_CURR"
OTHER = "OTHER_FEATURES"


@dataclass(frozen=True)
class LinearModel:
    """Log-odds = intercept + sum of coefficient * value; means are the explanation baseline."""

    intercept: float
    coefficients: Mapping[str, float]
    means: Mapping[str, float]

    @property
    def base_value(self) -> float:
        return self.intercept + sum(b * self.means[c] for c, b in self.coefficients.items())


def contribution(model: LinearModel, feature: str) -> Column:
    """coefficient * (value - mean); a missing value contributes nothing."""
    x = F.col(feature).cast("double")
    return F.coalesce(F.lit(model.coefficients[feature]) * (x - F.lit(model.means[feature])), F.lit(0.0))


def probability(model: LinearModel) -> Column:
    """Probability of a row; its features are columns of that row."""
    margin = F.lit(model.base_value)
    for c in model.coefficients:
        margin = margin + contribution(model, c)
    return sigmoid(margin)


def contribution_columns(df: DataFrame, model: LinearModel, key: str = KEY) -> DataFrame:
    """Wide form: one contribution column per feature."""
    return df.select(key, *[contribution(model, c).alias(c) for c in model.coefficients])


def explain(df: DataFrame, model: LinearModel, key: str = KEY, keep: Sequence[str] = ()) -> DataFrame:
    """Base value, probability and the factors sorted by strength, one row per applicant."""
    factors = F.array(
        *[
            F.struct(
                (-F.abs(contribution(model, c))).alias("order"),
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                F.lit(display_name(c)).alias("display_name"),
                contribution(model, c).alias("shap_value"),
                F.col(c).cast("double").alias("feature_value"),
            )
            for i, c in enumerate(model.coefficients)
        ]
    )
    ranked = F.transform(
        F.array_sort(factors),
        lambda f: F.struct(f["feature"], f["display_name"], f["shap_value"], f["feature_value"]),
    )
    margin = F.lit(model.base_value) + F.aggregate("explanation", F.lit(0.0), lambda a, f: a + f["shap_value"])
    return (
        df.select(key, *keep, ranked.alias("explanation"))
        .withColumn("base_value", F.lit(model.base_value))
        .withColumn("probability", sigmoid(margin))
    )


def factors_long(explained: DataFrame, top: int | None = None, key: str = KEY) -> DataFrame:
    """One row per applicant and factor with its rank; ``top`` keeps the strongest."""
    factors = F.slice("explanation", 1, top) if top else F.col("explanation")
    return explained.select(key, F.posexplode(factors).alias("pos", "f")).select(
        key, (F.col("pos") + 1).alias("rank"), "f.*"
    )


def top_factors_stored(long: DataFrame, top: int, key: str = KEY) -> DataFrame:
    """The same ranking over a stored long table."""
    order = Window.partitionBy(key).orderBy(F.abs("shap_value").desc(), F.asc("feature"))
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def factor_lines(explained: DataFrame, top: int = 6, key: str = KEY) -> DataFrame:
    """The strongest factors as text lines."""
    return explained.select(key, F.posexplode(F.slice("explanation", 1, top)).alias("pos", "f")).select(
        key, (F.col("pos") + 1).alias("rank"), factor_line(F.col("f")).alias("line")
    )


def shap_map(explained: Column | str = "explanation", digits: int | None = None) -> Column:
    """Feature -> contribution, as stored with a prediction."""

    def value(f: Column) -> Column:
        return F.round(f["shap_value"], digits) if digits is not None else f["shap_value"]

    return F.map_from_entries(F.transform(explained, lambda f: F.struct(f["feature"], value(f))))


def global_importance(contributions: DataFrame, features: Sequence[str], top: int | None = 30) -> DataFrame:
    """Mean absolute contribution per feature, from the wide form in one pass."""
    entries = [F.struct(F.lit(c).alias("feature"), F.avg(F.abs(F.col(c))).alias("importance")) for c in features]
    table = contributions.agg(F.array(*entries).alias("all")).select(F.inline("all"))
    ordered = table.orderBy(F.desc("importance"), F.asc("feature"))
    return ordered.limit(top) if top else ordered


def impact_summary(contributions: DataFrame, features: Sequence[str], near_zero: float = 1e-4) -> DataFrame:
    """Share of applicants whose risk a feature raises, lowers or leaves."""
    n = F.count(F.lit(1))
    entries = []
    for c in features:
        up, down = F.count_if(F.col(c) > near_zero), F.count_if(F.col(c) < -near_zero)
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.try_divide(up * 100, n).alias("increased_pct"),
                F.try_divide(down * 100, n).alias("decreased_pct"),
                F.try_divide((n - up - down) * 100, n).alias("neutral_pct"),
            )
        )
    return contributions.agg(F.array(*entries).alias("all")).select(F.inline("all"))


def normalized_values(df: DataFrame, features: Sequence[str], key: str = KEY) -> DataFrame:
    """Each value scaled to its column's range: missing 0.5, a constant column 0.

    The ranges are two numbers per column, read once; the scaling is then a
    projection before the unpivot, instead of a window over a whole feature.
    A column without any value has no points.
    """
    number = {c: F.col(c).cast("double") for c in features}
    edge = df.agg(*[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(c) for c, x in number.items()]).first()
    entries = []
    for c in features:
        lo, hi = edge[c]["lo"], edge[c]["hi"]
        if lo is None:
            continue
        width = hi - lo if hi != lo else 1.0
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                number[c].alias("feature_value"),
                F.coalesce((number[c] - F.lit(lo)) / F.lit(width), F.lit(0.5)).alias("normalized_value"),
            )
        )
    return df.select(key, F.inline(F.array(*entries)))


def waterfall(explained: DataFrame, top: int = 6, key: str = KEY) -> DataFrame:
    """Steps from the base value over the strongest factors to the final log-odds."""
    shap = F.transform("explanation", lambda f: f["shap_value"])
    rest = F.aggregate(F.slice(shap, top + 1, F.greatest(F.size("explanation"), F.lit(1))), F.lit(0.0), lambda a, x: a + x)

    def step(kind: str, name: Column, label: Column, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), name.alias("feature"), label.alias("label"), value.alias("value")
        )

    main = F.transform(
        F.slice("explanation", 1, top),
        lambda f: step("contrib", f["feature"], f["display_name"], f["shap_value"]),
    )
    base = step("base", F.lit("BASE_VALUE"), F.lit("Baseline (Average Risk)"), F.col("base_value"))
    other = step("contrib", F.lit(OTHER), F.lit("Other Factors"), F.col("rest"))
    steps = F.concat(F.array(base), F.col("main"), F.when(F.col("rest") != 0, F.array(other)).otherwise(F.array()))
    total = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["value"])
    final = step("final", F.lit("FINAL_PREDICTION"), F.lit("Final Score Prediction"), total)
    before = F.aggregate(F.slice("steps", 1, F.col("pos")), F.lit(0.0), lambda a, s: a + s["value"])
    start = F.when(F.col("s.type") == "contrib", before).otherwise(0.0)
    return (
        explained.select(key, "base_value", main.alias("main"), rest.alias("rest"))
        .select(key, steps.alias("steps"))
        .select(key, "steps", F.posexplode(F.concat("steps", F.array(final))).alias("pos", "s"))
        .select(
            key,
            F.col("pos").alias("step"),
            "s.type",
            "s.feature",
            "s.label",
            start.alias("start"),
            (start + F.col("s.value")).alias("end"),
            "s.value",
        )
    )


def feature_dictionary(spark) -> DataFrame:
    """The documented features as a table."""
    rows = [(f, n, DESCRIPTIONS[f]) for f, n in DISPLAY_NAMES.items()]
    return spark.createDataFrame(rows, "feature string, display_name string, description string")


def with_display_names(df: DataFrame) -> DataFrame:
    """Join the dictionary; an undocumented feature gets its name in words."""
    words = F.initcap(F.lower(F.replace(F.col("feature"), F.lit("_"), F.lit(" "))))
    named = df.join(feature_dictionary(df.sparkSession), "feature", "left")
    name = F.coalesce("display_name", words)
    text = F.coalesce("description", F.format_string("SHAP explanation factor for %s.", name))
    return named.withColumns({"display_name": name, "description": text})


def glossary(features: DataFrame, search: str = "") -> DataFrame:
    """Features whose display or column name contains the text, by display name."""
    wanted = search.lower()
    named = with_display_names(features)
    hit = F.lower("display_name").contains(wanted) | F.lower("feature").contains(wanted)
    return named.where(hit).orderBy("display_name", "feature")


