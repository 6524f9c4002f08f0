"""Sentences about a prediction, built from column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.risk import risk_band

# Letters of the bureau scores and the words that pick a prefix.
SCORE_LETTERS = {"EXT_SOURCE_2": "A", "EXT_SOURCE_3": "B", "EXT_SOURCE_1": "C"}
HIGH_LOW_WORDS = ["RATIO", "RATE", "DELAY", "AMT", "COUNT", "AGE"]
MONEY_WORDS = ["PRICE", "CREDIT", "ANNUITY", "INCOME"]


def _has(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def half_even(x: Column, digits: int) -> Column:
    """Nearest decimal with ``digits`` places to the exact binary value, ties to even.

    The value is split in two halves whose products with the scale are exact, so
    0.145, stored a little lower, gives 0.14. The built-in rounding works on
    the printed digits and gives 0.15.
    """
    scale = float(10**digits)
    a = F.abs(x)
    wide = a * F.lit(134217729.0)
    high = wide - (wide - a)
    n = F.floor(a * F.lit(scale))
    over = (high * F.lit(scale) - (n + F.lit(0.5))) + (a - high) * F.lit(scale)
    up = (over > 0) | ((over == 0) & (n % 2 == 1))
    return F.signum(x) * (n + up.cast("int")) / F.lit(scale)


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", half_even(x, digits))


def value_text(feature: Column, value: Column) -> Column:
    """Value as shown to a reader; the tests on the name apply in this order."""
    return (
        F.when(value.isNull(), "N/A")
        .when(_has(feature, ["RATIO", "RATE"]), F.concat(_fixed(value * 100, 1), F.lit("%")))
        .when(
            feature.contains("DAYS_EMPLOYED"),
            F.when(
                value < 0, F.concat(F.abs(value.cast("long")).cast("string"), F.lit(" days of employment"))
            ).otherwise("unemployed"),
        )
        .when(_has(feature, MONEY_WORDS), F.concat(F.lit("$"), F.format_number(half_even(value, 2), 2)))
        .otherwise(_fixed(value, 2))
    )


def factor_line(factor: Column) -> Column:
    """One line on one factor; ``factor`` has feature, display_name, shap_value, feature_value."""
    shap = factor["shap_value"]
    direction = F.when(shap > 0, "increases risk").otherwise("decreases risk")
    return F.concat(
        F.lit("- "),
        factor["display_name"],
        F.lit(" = "),
        value_text(factor["feature"], factor["feature_value"]),
        F.lit(" ("),
        direction,
        F.lit(" by "),
        _fixed(F.abs(shap), 4),
        F.lit(")"),
    )


def _named_factor(factor: Column) -> Column:
    name, up = factor["feature"], factor["shap_value"] > 0
    prefix = (
        F.when(_has(name, HIGH_LOW_WORDS), F.when(up, "high ").otherwise("low "))
        .when(name.contains("DAYS_EMPLOYED"), F.when(up, "short ").otherwise("stable "))
        .when(name.contains("Married"), F.when(up, "unfavorable ").otherwise("favorable "))
        .otherwise(F.when(up, "high ").otherwise("low "))
    )
    return F.concat(F.lit("a "), prefix, factor["display_name"])


def _score_phrase(scores: Column) -> Column:
    """The bureau scores among the factors as one phrase; a positive mean contribution reads 'low'."""
    letter = F.create_map(*[F.lit(x) for pair in SCORE_LETTERS.items() for x in pair])
    letters = F.array_sort(F.transform(scores, lambda s: F.try_element_at(letter, s["feature"])))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["shap_value"])
    prefix = F.when(total > 0, "low ").otherwise("high ")
    n = F.size(scores)
    names = (
        F.when(n == 1, F.concat(F.lit("Credit Bureau Score "), F.get(letters, 0)))
        .when(n == 2, F.concat(F.lit("Credit Bureau Scores "), F.array_join(letters, " and ")))
        .otherwise("Credit Bureau Scores A, B and C")
    )
    return F.when(n > 0, F.concat(prefix, names))


def narration(probability: Column, explanation: Column) -> Column:
    """Two sentences: probability with its band, then the three strongest factors."""
    top = F.slice(explanation, 1, 3)
    in_scores = lambda f: f["feature"].isin(*SCORE_LETTERS)
    others = F.transform(F.filter(top, lambda f: ~in_scores(f)), _named_factor)
    drivers = F.array_compact(F.concat(F.array(_score_phrase(F.filter(top, in_scores))), others))
    first = F.concat(
        F.lit("This applicant has a "),
        _fixed(probability * 100, 1),
        F.lit("% predicted default probability, placing them in the "),
        risk_band(probability, "report"),
        F.lit(" category."),
    )
    n = F.size(drivers)
    second = (
        F.when(n == 0, "There are no significant risk factors identified.")
        .when(n == 1, F.concat(F.lit("The primary driver is "), F.get(drivers, 0), F.lit(".")))
        .when(
            n == 2,
            F.concat(
                F.lit("The primary drivers are "), F.get(drivers, 0), F.lit(", and "), F.get(drivers, 1), F.lit(".")
            ),
        )
        .otherwise(
            F.concat(
                F.lit("The primary drivers are "),
                F.get(drivers, 0),
                F.lit(", "),
                F.get(drivers, 1),
                F.lit(", and "),
                F.get(drivers, 2),
                F.lit("."),
            )
        )
    )
    return F.concat(first, F.lit(" "), second)
