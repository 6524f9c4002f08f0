"""Importance resampling towards a target distribution, with hashed word features.

A feature is a run of one or two consecutive words joined by one space; its
bucket is the CRC-32 of its bytes modulo the number of buckets. CRC-32 is linear
up to a constant that depends on the length alone, so the checksum of a span is
the XOR of one table entry per byte, chosen by the byte and its distance from
the span's end. Entries of all spans of a piece of text are looked up at once and
folded with ``bitwise_xor.reduceat``. A span longer than the table is cut into
blocks from its end; a block's fold is then carried over the bytes behind it with
operators for 64, 128, 256, ... zero bytes.

Pass 1 counts buckets of corpus and target (one row per bucket and task goes
through the shuffle), pass 2 gives every document its weight and score, and
the highest scores are drawn. Ranks come from running totals over distinct
scores, and a window inside each score; nothing is sorted in one task.

Defined cases: a null or word-free text has no feature and weight 0; a null id
counts as an empty string in the hash and sorts first among ties; equal rows
have equal scores and get ranks of their own; long texts go through in pieces of
about a megabyte, long words as blocks; an empty corpus gives no rows, an empty
target the gains of T = 0. Only id and text are read from either table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.rows import long_ids, texts
from creditloom.operators.order_stats import running_totals
from creditloom.session import materialize

BUCKETS = 10_000
DISTANCES = 64  # bytes of a block; a power of two
PIECE = 1 << 20  # bytes of text handled at once
_ONES = np.uint32(0xFFFFFFFF)


# --- checksums of spans -----------------------------------------------------------


@cache
def position_table() -> np.ndarray:
    """Entry [d, b]: what a byte b with d bytes behind it adds to a checksum."""
    rows = [[zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(d + 1)) for b in range(256)] for d in range(DISTANCES)]
    return np.array(rows, dtype=np.uint32)


@cache
def _zeros_table() -> np.ndarray:
    """Checksums of 0 to DISTANCES zero bytes, the constant of each length."""
    return np.array([zlib.crc32(bytes(n)) for n in range(DISTANCES + 1)], dtype=np.uint32)


def _apply(operator: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = operator[0][state & 255]
    for k in range(1, 4):
        out = out ^ operator[k][(state >> np.uint32(8 * k)) & 255]
    return out


@cache
def _operator(power: int) -> np.ndarray:
    """Linear map of a state over DISTANCES * 2**power zero bytes, as one table per byte of the state."""
    units = np.arange(256, dtype=np.uint32)
    if power > 0:
        half = _operator(power - 1)
        return np.stack([_apply(half, _apply(half, units << np.uint32(8 * k))) for k in range(4)])
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    tables = [units << np.uint32(8 * k) for k in range(4)]
    for _ in range(DISTANCES):
        tables = [(t >> np.uint32(8)) ^ step[t & 255] for t in tables]
    return np.stack(tables)


def _carried(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States carried over ``blocks`` blocks of zero bytes."""
    state, power = state.copy(), 0
    while (blocks >> power).any():
        at = np.flatnonzero((blocks >> power) & 1)
        state[at] = _apply(_operator(power), state[at])
        power += 1
    return state


def _lengths_constant(length: np.ndarray) -> np.ndarray:
    whole, rest = np.divmod(length, DISTANCES)
    return _carried(_zeros_table()[rest] ^ _ONES, whole) ^ _ONES


def _folds(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XOR of the table entries of each span of at most DISTANCES bytes."""
    table, out = position_table().ravel(), np.empty(len(start), dtype=np.uint32)
    total = np.cumsum(length)
    at = 0
    while at < len(start):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PIECE, side="right")))
        size = length[at:to]
        ends = total[at:to] - before
        firsts = ends - size
        flat = np.arange(int(ends[-1]), dtype=np.int32)
        shift = np.repeat((start[at:to] - firsts).astype(np.int32), size)
        behind = np.repeat((ends - 1).astype(np.int32), size) - flat
        entries = table[(behind << 8) | data[flat + shift]]
        out[at:to] = np.bitwise_xor.reduceat(entries, firsts)
        at = to
    return out


def span_checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start : start + length]`` for every span; no span is empty."""
    if not len(start):
        return np.empty(0, dtype=np.uint32)
    if int(length.max()) <= DISTANCES:
        return _folds(data, start, length) ^ _zeros_table()[length]
    blocks = -(-length // DISTANCES)
    first = np.cumsum(blocks) - blocks
    behind = np.repeat(first + blocks - 1, blocks) - np.arange(int(blocks.sum()))
    end = np.repeat(start + length, blocks) - behind * DISTANCES
    begin = np.maximum(np.repeat(start, blocks), end - DISTANCES)
    parts = _carried(_folds(data, begin, end - begin), behind)
    return np.bitwise_xor.reduceat(parts, first) ^ _lengths_constant(length)


# --- features of texts ------------------------------------------------------------


def _classes() -> bytes:
    """Bytes with A-Z lowered; what belongs to no word becomes zero."""
    word = {*range(48, 58), *range(97, 123), *range(128, 256)}
    low = [b + 32 if 65 <= b < 91 else b for b in range(256)]
    return bytes(b if b in word else 0 for b in low)


CLASSES = _classes()


def _spans(owned: Sequence[tuple[int, bytes, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single bytes, and owner, start and length of every feature.

    ``owned`` holds (owner, folded bytes, whether the first word was counted before).
    """
    data = np.frombuffer(b"\0".join([b"", *(t for _, t, _ in owned), b""]), dtype=np.uint8)
    word = data != 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begins, ends = edge[0::2], edge[1::2]
    sizes = np.array([len(t) + 1 for _, t, _ in owned])
    unit = np.searchsorted(np.cumsum(sizes), begins, side="left")
    keep = word.copy()
    keep[ends] = True
    packed = data[keep]
    packed[packed == 0] = 32
    length = ends - begins
    start = np.cumsum(length + 1) - (length + 1)
    owner = np.array([o for o, _, _ in owned])[unit] if len(unit) else np.empty(0, dtype=np.int64)
    pair = np.flatnonzero(unit[1:] == unit[:-1])
    new = np.ones(len(begins), dtype=bool)
    if len(begins):
        seen = np.array([s for _, _, s in owned])[unit]
        new &= ~(seen & np.concatenate([[True], unit[1:] != unit[:-1]]))
    return (
        packed,
        np.concatenate([owner[new], owner[pair]]),
        np.concatenate([start[new], start[pair]]),
        np.concatenate([length[new], length[pair] + 1 + length[pair + 1]]),
    )


def _units(rows: Sequence[bytes | None]) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Texts gathered to about PIECE bytes; a longer one is cut between words, its last word repeated."""
    held, size = [], 0
    for i, text in enumerate(rows):
        folded, at, cut = (text or b"").translate(CLASSES), 0, -1
        if len(folded) > PIECE:
            folded = re.sub(rb"\0{2,}", b"\0", folded)
        while len(folded) - at > PIECE:
            end = folded.find(b"\0", max(at + PIECE, cut + 1))
            if end < 0:
                break
            yield [(i, folded[at:end], cut >= 0)]
            at, cut = folded.rfind(b"\0", 0, end) + 1, end
        held.append((i, folded[at:], cut >= 0))
        size += len(folded) - at
        if size > PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(rows: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row number and checksum of every feature of every text."""
    for unit in _units(rows):
        data, owner, start, length = _spans(unit)
        yield owner, span_checksums(data, start, length)


# --- counts, weights, draw --------------------------------------------------------


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> dict[int, int]:
    """Occurrences of features in each bucket that has any; at most ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, sums in features(texts(batch, text_col)):
                total += np.bincount(sums % buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    counted = df.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and corpus shares, rounded down."""
    big_s, big_t = sum(corpus.values()), sum(target.values())
    out = np.empty(buckets, dtype=np.int64)
    for b in range(buckets):
        above = float(target.get(b, 0) + 1) * float(big_s + buckets)
        below = float(corpus.get(b, 0) + 1) * float(big_t + buckets)
        out[b] = math.floor(1000.0 * math.log(above / below))
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_features and weight (floored mean gain) of every row; no exchange."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for owner, sums in features(texts(batch, text_col)):
                n += np.bincount(owner, minlength=len(n))
                # Sums of whole numbers far below 2**53: exact in doubles.
                total += np.bincount(owner, weights=gain[sums % buckets], minlength=len(n)).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [long_ids(batch, id_col), pa.array(n), pa.array(weight)], [id_col, "n_features", "weight"]
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(
        run, f"`{id_col}` long, n_features long, weight long"
    )


def noise(id_col: str, salt: int) -> Column:
    """Thousandths of a Gumbel deviate that follows from the id, rounded down."""
    key = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def draw(
    scored: DataFrame, least_features: int, percent: int, id_col: str = "doc_id", score_col: str = "score"
) -> DataFrame:
    """Add ``rank`` from 1 to the ``percent`` of the eligible rows with the highest scores, ties to the smaller id.

    ``scored`` is a written table: it is read for the counts and again for the ranks.
    """
    eligible = scored.filter(F.col("n_features") >= least_features)
    counts = eligible.groupBy(score_col).agg(F.count(F.lit(1)).alias("n"))
    wanted = eligible.count() * percent // 100
    upto = running_totals(counts, score_col, {"upto": F.col("n")}, descending=True)
    places = upto.select(F.col(score_col).alias("_score"), (F.col("upto") - F.col("n")).alias("_before"))
    in_score = Window.partitionBy("_score").orderBy(F.col(id_col).asc_nulls_first(), "n_features")
    drawn = eligible.join(places.filter(F.col("_before") < wanted), F.col(score_col) == F.col("_score"))
    place = (F.col("_before") + F.row_number().over(in_score)).cast("long")
    ranked = drawn.select(*scored.columns, place.alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = eligible.join(places.filter(F.col("_before") >= wanted), F.col(score_col) == F.col("_score"))
    short = scored.filter(F.col("n_features") < least_features)
    unranked = others.select(*scored.columns).union(short).withColumn("rank", F.lit(None).cast("long"))
    return ranked.union(unranked)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    salt: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets), buckets)
    weighed = weigh(docs, gain, id_col, text_col)
    scored = weighed.withColumn("score", F.col("weight") + noise(id_col, salt))
    # n words have 2n - 1 features.
    return draw(materialize(scored, "importance"), 2 * least_words - 1, percent, id_col)
