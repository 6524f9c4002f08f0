"""Deterministic samples and exact stratified splits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.order_stats import ranks

# Salts: samples and splits take one, folds another, so that neither follows from the other.
SPLIT, FOLD = "split:", "fold:"
PARTS = 1_000_000


def shuffle_key(key: str | Column, salt: str = SPLIT) -> Column:
    """40 bits of a salted digest of the key, unrelated to its order; few enough that a double holds order statistics of them exactly."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 10), 16, 10).cast("long")


def sample_fraction(df: DataFrame, fraction: float, key: str = "SK_ID_CURR") -> DataFrame:
    """About ``fraction`` of the rows, the same ones in every run; no shuffle."""
    return df.where(shuffle_key(key) % PARTS < round(fraction * PARTS))


def sample_rows(df: DataFrame, n: int, key: str = "SK_ID_CURR") -> DataFrame:
    """Exactly n rows (or all): those up to the n-th hash, so that even a large sample is never gathered in one place."""
    return df.where(_firsts_by_hash(df, {"all": shuffle_key(key)}, {"all": [lambda have: min(n, have)]}, key)["all"][0])


def stratified_folds(
    df: DataFrame, folds: int = 5, label: str = "TARGET", key: str = "SK_ID_CURR", classes: tuple = (0, 1)
) -> Column:
    """Fold number of every row; each class is dealt out so that its folds differ by one row at most."""
    of_class = _class_hashes(label, key, classes, FOLD)
    return _fold_number(_firsts_by_hash(df, of_class, dict.fromkeys(of_class, _fold_sizes(folds)), key))


def _class_hashes(label: str, key: str, classes: tuple, salt: str) -> dict[str, Column]:
    return {f"{salt}{c}": F.when(F.col(label) == c, shuffle_key(key, salt)) for c in classes}


def _fold_sizes(folds: int) -> list[Callable[[int], int]]:
    return [lambda n, k=k: round(n * k / folds) for k in range(1, folds)]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def _fold_number(of_class: Mapping[str, Sequence[Column]]) -> Column:
    beyond = [~_any(inside) for inside in zip(*of_class.values(), strict=True)]
    return sum((b.cast("int") for b in beyond), F.lit(0)).cast("int")


def _firsts_by_hash(
    df: DataFrame, hashes: Mapping[str, Column], takes: Mapping[str, Sequence[Callable[[int], int]]], key: str
) -> dict[str, list[Column]]:
    """For each hash column, conditions for the first ``take(n)`` of the n rows that have it.

    A cut is one order statistic, found without sorting, and all of them share
    their passes; the conditions then need no shuffle at all.
    """
    spots = {c: (lambda n, own=own: [max(take(n) - 1, 0) for take in own]) for c, own in takes.items()}
    found = ranks(df, hashes, spots)
    out: dict[str, list[Column]] = {}
    for c, cuts in found.items():
        out[c] = []
        for take, cut in zip(takes[c], cuts, strict=True):
            inside = F.lit(False)
            if cut is not None:
                x = round(cut.value)
                room = take(cut.n) - cut.below
                inside = hashes[c] <= x if room == cut.at else hashes[c] < x
                if 0 < room < cut.at:  # keys that share the hash of the cut: order them by key
                    last = df.where(hashes[c] == x).orderBy(key).limit(room).agg(F.max(key)).first()[0]
                    inside = inside | ((hashes[c] == x) & (F.col(key) <= last))
            out[c].append(F.coalesce(inside, F.lit(False)))
    return out


def stratified_cut(
    df: DataFrame, fraction: float, label: str = "TARGET", key: str = "SK_ID_CURR", classes: tuple = (0, 1)
) -> Column:
    """Condition that holds for exactly round(fraction * n) rows of every class."""
    of_class = _class_hashes(label, key, classes, SPLIT)
    takes = dict.fromkeys(of_class, [lambda n: round(fraction * n)])
    return _any([inside for (inside,) in _firsts_by_hash(df, of_class, takes, key).values()])


def stratified_split(
    df: DataFrame, train_fraction: float = 0.8, label: str = "TARGET", key: str = "SK_ID_CURR"
) -> DataFrame:
    """Add ``is_train``: exact class shares on both sides."""
    return df.withColumn("is_train", stratified_cut(df, train_fraction, label, key))


def split_and_folds(
    df: DataFrame,
    train_fraction: float = 0.8,
    folds: int = 5,
    label: str = "TARGET",
    key: str = "SK_ID_CURR",
    classes: tuple = (0, 1),
) -> DataFrame:
    """``stratified_split`` and ``stratified_folds`` at once: the cuts of both salts share their passes."""
    split, fold = _class_hashes(label, key, classes, SPLIT), _class_hashes(label, key, classes, FOLD)
    takes = dict.fromkeys(split, [lambda n: round(train_fraction * n)]) | dict.fromkeys(fold, _fold_sizes(folds))
    found = _firsts_by_hash(df, split | fold, takes, key)
    is_train = _any([found[c][0] for c in split])
    return df.withColumn("is_train", is_train).withColumn("fold", _fold_number({c: found[c] for c in fold}))
