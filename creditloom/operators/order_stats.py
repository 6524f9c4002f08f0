"""Exact order statistics and running totals without a single-task sort.

A global window sorts a whole table in one task, and the exact ``percentile``
aggregate keeps every distinct value in one. Here the range that holds the
wanted rank is narrowed with mergeable sketches first, and running totals are
taken per range bucket and shifted by the totals of the buckets before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
BRACKET = 200_000


@dataclass
class _Target:
    """Position ``pos`` (0-based, maybe fractional) of a column inside [lo, hi]."""

    column: Column
    n: int
    pos: float
    lo: float
    hi: float
    lowest: float
    highest: float
    below: int = 0
    inside: int = 0
    settled: bool = False

    @property
    def first(self) -> int:
        return int(self.pos)

    @property
    def last(self) -> int:
        return min(self.first + (self.pos > self.first), self.n - 1)

    def holds(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside

    def blend(self, a: float, b: float) -> float:
        return a if a == b else a + (b - a) * (self.pos - self.first)


@dataclass(frozen=True)
class Rank:
    """Exact value at a position, and how many of the column's n values lie below its first value or equal it."""

    value: float
    below: int
    at: int
    n: int


def exact_ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    position: Callable[[int], Sequence[float]],
    small: int = BRACKET,
) -> dict[str, list[float | None]]:
    """Exact values at the positions ``position(n)`` of each column's n non-NULL values.

    Fractional positions interpolate linearly. The bracket around each position
    shrinks until it holds at most ``small`` rows or two values at most; the
    values inside are grouped and ranked.
    """
    found = ranks(df, columns, dict.fromkeys(columns, position), small)
    return {c: [None if r is None else r.value for r in of_column] for c, of_column in found.items()}


def ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    positions: Mapping[str, Callable[[int], Sequence[float]]],
    small: int = BRACKET,
) -> dict[str, list[Rank | None]]:
    """Like ``exact_ranks`` with positions of their own for each column, and the counts around each value.

    All positions of all columns share their passes: one for the sizes, two for
    every round of narrowing (none where a column has at most ``small`` rows), one for the values.
    """
    names = list(columns)
    value = {c: columns[c].cast("double") for c in names}
    head = df.agg(
        *[
            F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"s{i}")
            for i, v in enumerate(value.values())
        ]
    ).first()
    stats = {c: head[f"s{i}"] for i, c in enumerate(names)}
    wanted = {c: list(positions[c](stats[c]["n"])) if stats[c]["n"] else [] for c in names}
    found: dict[str, list[Rank | None]] = {c: [None] * len(positions[c](1)) for c in names}

    targets = {
        (c, j): _Target(value[c], s["n"], pos, s["lo"], s["hi"], s["lo"], s["hi"], 0, s["n"])
        for c, s in stats.items()
        for j, pos in enumerate(wanted[c])
    }
    if targets:
        _narrow(df, list(targets.values()), small)
        for (c, j), x in zip(targets, _pick(df, list(targets.values())), strict=True):
            found[c][j] = x
    return found


def _narrow(df: DataFrame, targets: list[_Target], small: int) -> None:
    """Shrink the brackets until each holds few rows or two values at most.

    A sketch cannot part a bracket whose ends are very frequent; then the ends
    are cut off by their exact counts, so every round shrinks each wide bracket.
    """
    while wide := [t for t in targets if t.inside > small and not t.settled]:
        sketches = []
        for i, t in enumerate(wide):
            within = F.when(t.column.between(t.lo, t.hi), t.column)
            low = max((t.first - t.below) / t.inside - 2 / SKETCH_ACCURACY, 0.0)
            high = min((t.last + 1 - t.below) / t.inside + 2 / SKETCH_ACCURACY, 1.0)
            sketches.append(
                F.approx_percentile(within, F.array(F.lit(low), F.lit(high)), SKETCH_ACCURACY).alias(f"q{i}")
            )
        bounds = df.agg(*sketches).first()
        tried = [(t, float(bounds[f"q{i}"][0]), float(bounds[f"q{i}"][1])) for i, t in enumerate(wide)]
        counts = df.agg(
            *[
                F.struct(
                    F.count_if(t.column < lo).alias("below"), F.count_if(t.column.between(lo, hi)).alias("inside")
                ).alias(f"c{i}")
                for i, (t, lo, hi) in enumerate(tried)
            ]
        ).first()
        stuck = []
        for i, (t, lo, hi) in enumerate(tried):
            before = (t.lo, t.hi, t.below, t.inside)
            t.lo, t.hi, t.below, t.inside = lo, hi, counts[f"c{i}"]["below"], counts[f"c{i}"]["inside"]
            if not t.holds():  # the sketch missed: keep the bracket known to hold the rank
                t.lo, t.hi, t.below, t.inside = before
            if t.lo == t.hi:
                t.settled = True
            elif (t.lo, t.hi) == before[:2]:
                stuck.append(t)
        if stuck:
            _cut_ends(df, stuck)


def _cut_ends(df: DataFrame, targets: list[_Target]) -> None:
    """Take the ends of each bracket apart from what lies between them."""
    parts = df.agg(
        *[
            F.struct(
                F.count_if(t.column == t.lo).alias("lows"),
                F.count_if(t.column == t.hi).alias("highs"),
                F.min(F.when(t.column > t.lo, t.column)).alias("above"),
                F.max(F.when(t.column < t.hi, t.column)).alias("under"),
            ).alias(f"e{i}")
            for i, t in enumerate(targets)
        ]
    ).first()
    straddling = []
    for i, t in enumerate(targets):
        e = parts[f"e{i}"]
        between = t.inside - e["lows"] - e["highs"]
        first, last = t.first - t.below, t.last - t.below
        if last < e["lows"]:
            t.hi, t.inside, t.settled = t.lo, e["lows"], True
        elif first < e["lows"]:  # the last copy of the low end and the value above it
            t.hi, t.settled = e["above"], True
        elif first >= e["lows"] + between:
            t.lo, t.below, t.inside, t.settled = t.hi, t.below + e["lows"] + between, e["highs"], True
        elif last >= e["lows"] + between:  # the value below the high end and its first copy
            straddling.append((t, e["under"], t.below + e["lows"] + between))
        else:
            t.lo, t.hi, t.below, t.inside = e["above"], e["under"], t.below + e["lows"], between
    if straddling:
        copies = df.agg(*[F.count_if(t.column == under).alias(f"u{i}") for i, (t, under, _) in enumerate(straddling)]).first()
        for i, (t, under, before_hi) in enumerate(straddling):
            t.lo, t.below, t.settled = under, before_hi - copies[f"u{i}"], True


def _pick(df: DataFrame, targets: list[_Target]) -> list[Rank]:
    """Rank the grouped values inside each bracket and read the wanted one or two."""
    slots: dict[tuple, int] = {}
    for t in targets:  # positions of one column often share their bracket
        slots.setdefault((id(t.column), t.lo, t.hi), len(slots))
    column = {slots[id(t.column), t.lo, t.hi]: t for t in targets}
    inside = [
        F.when(t.column.between(t.lo, t.hi), F.struct(F.lit(i).alias("slot"), t.column.alias("value")))
        for i, t in sorted(column.items())
    ]
    grouped = (
        df.select(F.inline(F.array_compact(F.array(*inside)))).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(
        Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    spans: dict[int, list[tuple[int, int]]] = {}
    for t in targets:
        spans.setdefault(slots[id(t.column), t.lo, t.hi], []).append((t.first - t.below, t.last - t.below))
    want = F.array(
        *[F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(set(spans[i]))]) for i in sorted(spans)]
    )
    hit = F.exists(
        F.element_at(want, F.col("slot") + 1), lambda w: (F.col("upto") > w["a"]) & (F.col("upto") - F.col("n") <= w["b"])
    )
    hits: dict[int, list] = {}
    for r in grouped.withColumn("upto", upto).where(hit).collect():
        hits.setdefault(r["slot"], []).append((r["value"], r["upto"] - r["n"], r["n"]))
    out = []
    for t in targets:
        a, b = t.first - t.below, t.last - t.below
        own = sorted(h for h in hits[slots[id(t.column), t.lo, t.hi]] if h[1] <= b and h[1] + h[2] > a)
        out.append(Rank(t.blend(own[0][0], own[-1][0]), t.below + own[0][1], own[0][2], t.n))
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), small: int = BRACKET
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of many columns; None for an empty column."""
    return exact_ranks(df, {c: F.col(c) for c in columns}, lambda n: [(n - 1) * p for p in probs], small)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns).items()}


def _in_ranges(df: DataFrame, key: str, buckets: int | None) -> DataFrame:
    """``df`` with ``_key``, the numeric key as a double, and ``_bucket``, the number of its range of about equal size."""
    buckets = buckets or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(key).cast("double")
    cuts = [k / buckets for k in range(1, buckets)]
    sketch = df.agg(F.approx_percentile(value, F.array(*map(F.lit, cuts)), 10 * buckets).alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted(set(sketch)), float("inf")]
    keyed = df.withColumn("_key", value)
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(keyed)
        return keyed.withColumn("_bucket", F.col("_bucket").cast("int"))
    return keyed.withColumn("_bucket", F.lit(0))


def never_falls(df: DataFrame, key: str, value: str, slack: float = 0.0, buckets: int | None = None) -> bool:
    """Whether ``value`` falls by no more than ``slack`` from any row to the next in the order of the numeric ``key``.

    All rows are compared, range by range; one row per range comes to the driver. Rows of one key stand in the order of their values.
    """
    at = F.struct("_key", value)
    fall = F.lag(value).over(Window.partitionBy("_bucket").orderBy("_key", value)) - F.col(value)
    parts = _in_ranges(df.select(key, value), key, buckets).withColumn("_fall", fall).groupBy("_bucket")
    found = parts.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("_fall").alias("fall")).orderBy("_bucket").collect()
    inside = all(r["fall"] is None or r["fall"] <= slack for r in found)
    return inside and all(a["last"][value] - b["first"][value] <= slack for a, b in zip(found, found[1:], strict=False))


def running_totals(
    df: DataFrame, key: str, totals: Mapping[str, Column], descending: bool = False, buckets: int | None = None
) -> DataFrame:
    """Inclusive running totals in the order of ``key``, computed range by range.

    ``key`` must be numeric and unique (group by it first), so that no bucket can
    grow beyond its share. There are twice as many buckets as shuffle
    partitions unless ``buckets`` says otherwise; what lies before each comes from
    a window over one row per bucket and is joined.
    """
    keyed = _in_ranges(df, key, buckets)
    sums = keyed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_before_{n}") for n, c in totals.items()])
    ordered = Window.orderBy(F.desc("_bucket") if descending else F.asc("_bucket"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", *[F.coalesce(F.sum(f"_before_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals])
    sort = F.col(key).desc() if descending else F.col(key).asc()
    window = Window.partitionBy("_bucket").orderBy(sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.withColumns({n: F.sum(c).over(window) for n, c in totals.items()}).join(offsets, "_bucket")
    return run.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in totals}).drop("_key", *offsets.columns)
