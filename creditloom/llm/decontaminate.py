"""Benchmark decontamination by q-gram lemma filtering.

A passage of a document that differs from a benchmark item of ``m`` characters
in at most ``k`` edits shares at least ``m - q + 1 - k*q`` character q-grams with
it, and all of them lie on diagonals (document place minus item place) at most
``k`` apart from the passage's own. Shared q-grams are counted per item in
overlapping bands of diagonals, each band twice as wide as the item's step; the
windows of the bands that reach the bound are merged and aligned, which yields
edits and spans.

``k`` is a tenth of the item's length (RATE), reduced where the bound would fall
below one q-gram. Letters of every script are case-folded one by one (a letter
whose folds are all longer than itself stays as it is) and white space characters count
as blanks on both sides; no character is added or taken away, so spans are
character offsets of the text.

Documents are read whole in Arrow batches, long ones in overlapping stretches;
no document moves. The items' index is sent to the tasks in blocks of at most
BLOCK_CHARS characters of items, each block one scan, so its size is bounded
however large the benchmark is.

Defined cases: null or empty texts and items match nothing; an item shorter than
a q-gram must occur unchanged; repeated items each yield their own matches; an
item found at several places yields a row for each: the place of fewest edits
first, then the best of what does not overlap the places taken.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.rows import long_ids, texts

Q = 8
RATE = 0.1
BLOCK_CHARS = 4_000_000
STRETCH = 1 << 18
PAIRS = 1 << 21
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier of the rolling hash
_BLANKS = "\t\n\r\x0b\x0c"


def _folds() -> np.ndarray:
    """The folded code point of every code point: Unicode's simple case folding."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x20000):  # fixed value: cased letters lie in the first two planes
        table[c] = ord(next(f for f in (chr(c).casefold(), chr(c).lower(), chr(c)) if len(f) == 1))
    table[[ord(c) for c in _BLANKS]] = ord(" ")
    return table


_FOLDS = _folds()


def codes(text: bytes | None) -> np.ndarray:
    """Code points, case-folded one by one, with white space as blanks."""
    chars = (text or b"").decode("utf-8", "replace").encode("utf-32-le")
    return _FOLDS[np.frombuffer(chars, dtype=np.uint32)]


def grams(chars: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at every place."""
    count = len(chars) - Q + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    wide = chars.astype(np.uint64)
    total = wide[:count].copy()
    for k in range(1, Q):
        total *= _BASE
        total += wide[k : k + count]
    return total ^ (total >> np.uint64(29))


def budget(length: int) -> int:
    return max(0, min(int(RATE * length), (length - Q) // Q))


class _Seen:
    """Where each q-gram of the index occurs in a text.

    A q-gram of a run of one character occurs at very many places of text and item;
    all pairs of them are never listed: a place of an item meets at most as many
    bands as the text has steps, and each of them is looked up.
    """

    def __init__(self, places: np.ndarray, count: np.ndarray, width: int):
        self.places, self.count, self.width = places, count, width
        self.first = np.cumsum(count) - count
        self.keys = np.repeat(np.arange(len(count)), count) * width + places

    def _reach(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.places[self.first[gram]], self.places[self.first[gram] + self.count[gram] - 1]

    def most_bands(self, gram: np.ndarray, step: np.ndarray) -> np.ndarray:
        low, high = self._reach(gram)
        return np.minimum(self.count[gram], (high - low) // step + 2)

    def bands(self, gram: np.ndarray, place: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, band): the bands of diagonals in which each row's q-gram occurs."""
        low, high = self._reach(gram)
        lowest, highest = (low - place) // step, (high - place) // step
        listed = self.count[gram] <= highest - lowest + 1
        rows, found = [], []
        row, nth = _expanded(np.flatnonzero(listed), self.count[gram[listed]])
        rows.append(row)
        found.append((self.places[self.first[gram[row]] + nth] - place[row]) // step[row])
        row, nth = _expanded(np.flatnonzero(~listed), (highest - lowest + 1)[~listed])
        band = lowest[row] + nth
        begin = np.maximum(place[row] + band * step[row], 0)
        own = gram[row] * self.width
        at = np.searchsorted(self.keys, own + begin)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] - own
        there = (at < len(self.keys)) & (hit < np.minimum(place[row] + (band + 1) * step[row], self.width)) & (hit >= begin)
        rows.append(row[there])
        found.append(band[there])
        return np.concatenate(rows), np.concatenate(found)


def _expanded(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as asked for, and the number of the repetition."""
    return np.repeat(rows, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


@dataclass
class Index:
    """Q-grams of a block of items: a bitmap, the sorted distinct hashes and their places."""

    ids: list[int]
    items: list[np.ndarray]
    times: list[int] | None = None  # how often each item stands in the benchmark; once if not given

    def __post_init__(self):
        sizes = [max(0, len(x) - Q + 1) for x in self.items]
        every = np.concatenate([grams(x) for x in self.items]) if self.items else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.items)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.hashes, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.owner, self.place = owner[order], place[order].astype(np.int64)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.hashes >> np.uint64(64 - _BITS)] = True
        self.length = np.array([len(x) for x in self.items], dtype=np.int64)
        self.budget = np.array([budget(n) for n in self.length], dtype=np.int64)
        self.bound = self.length - Q + 1 - self.budget * Q
        # Steps of twice the item's budget: any passage's diagonals fit into one band of two steps.
        self.step = 2 * self.budget + 1
        self.short = [(i, x) for i, x in enumerate(self.items) if 0 < len(x) < Q]

    @classmethod
    def of(cls, fields: dict) -> Index:
        """An index from the fields of another one, as they are sent to tasks."""
        made = cls.__new__(cls)
        made.__dict__.update(fields)
        return made

    def bands(self, chars: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of every band that reaches its item's bound."""
        own = grams(chars)
        at = np.flatnonzero(self.bitmap[own >> np.uint64(64 - _BITS)])
        if not len(at):
            return []
        slot = np.searchsorted(self.hashes, own[at])
        slot[slot == len(self.hashes)] = 0
        real = self.hashes[slot] == own[at]
        at, slot = at[real], slot[real]
        # Places of each shared q-gram in the text, by q-gram and ascending.
        slots, rank, count = np.unique(slot, return_inverse=True, return_counts=True)
        seen = _Seen(at[np.argsort(rank, kind="stable")], count, len(chars) + 1)
        many = self.starts[slots + 1] - self.starts[slots]
        entry = np.repeat(self.starts[slots] - np.cumsum(many) + many, many) + np.arange(many.sum())
        gram, item = np.repeat(np.arange(len(slots)), many), self.owner[entry]
        # An item with fewer places that occur anywhere in the text than its bound has no band.
        keep = (np.bincount(item, minlength=len(self.items)) >= self.bound)[item]
        order = np.flatnonzero(keep)[np.argsort(item[keep], kind="stable")]
        gram, item, place = gram[order], item[order], self.place[entry[order]]
        size = seen.most_bands(gram, self.step[item])
        out, begin = [], 0
        total = np.cumsum(size)
        ends = np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1 if len(item) else []
        for k, end in enumerate(ends):  # whole items, as many as fit into PAIRS
            after = ends[k + 1] if k + 1 < len(ends) else None
            if after is None or total[after - 1] - (total[begin - 1] if begin else 0) > PAIRS:
                out += self._bands_of(seen, gram[begin:end], item[begin:end], place[begin:end])
                begin = end
        return out

    def _bands_of(self, seen: _Seen, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """Bands of some items from all places of theirs that occur in the text."""
        step = self.step[item]
        row, band = seen.bands(gram, place, step)
        item, place = item[row], place[row]
        low = band.min(initial=0) - 1
        span = band.max(initial=0) - low + 2
        width = self.length.max(initial=0) + 1
        key = np.concatenate([item * span + band - low, item * span + band - 1 - low])
        key = np.unique(key * width + np.concatenate([place, place])) // width
        found, counts = np.unique(key, return_counts=True)
        owner = found // span
        good = counts >= self.bound[owner]
        owner, band = owner[good], found[good] % span + low
        return list(zip(owner.tolist(), (band * self.step[owner]).tolist(), strict=True))

    def windows(self, chars: np.ndarray) -> dict[int, list[list[int]]]:
        """Merged windows by item: a passage within the budget lies within one of them."""
        found: dict[int, list[tuple[int, int]]] = {}
        reach = int(self.length.max(initial=0) + self.budget.max(initial=0))
        for begin in range(0, max(1, len(chars)), STRETCH):
            shift = max(0, begin - reach)
            part = chars[shift : begin + STRETCH]
            for i, diagonal in self.bands(part):
                k, first = int(self.budget[i]), diagonal + shift
                # A band covers two steps of diagonals; the passage starts within k of them.
                high = first + 2 * int(self.step[i]) + k + int(self.length[i])
                found.setdefault(i, []).append((max(0, first - k), min(len(chars), high)))
            for i, x in self.short:
                places = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(part, len(x)).__eq__(x).all(axis=1)) if len(part) >= len(x) else []
                found.setdefault(i, []).extend((int(p) + shift, int(p) + shift + len(x)) for p in places)
        merged = {}
        for i, spans in sorted(found.items()):
            out: list[list[int]] = []
            for low, high in sorted(spans):
                # Windows that only touch share no passage.
                if out and low < out[-1][1]:
                    out[-1][1] = max(out[-1][1], high)
                else:
                    out.append([low, high])
            merged[i] = out
        return merged

    def matches(self, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of every verified place; of overlapping places of an item the best."""
        return [
            (i, start + low, end + low, edits)
            for i, spans in self.windows(chars).items()
            for low, high in spans
            for start, end, edits in places(self.items[i], chars[low:high], int(self.budget[i]))
        ]


def places(item: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the item's places in the text within ``k`` edits: the best, then the best beside those taken."""
    ends = _last_row(item, text, free_start=True)
    found, free = [], [(0, len(text))]
    while free:
        low, high = free.pop()
        end = low + int(ends[low : high + 1].argmin())
        edits = int(ends[end])
        if edits > k:
            continue
        back = _last_row(item[::-1], text[max(low, end - len(item) - k) : end][::-1], free_start=False)
        start = end - int(back.argmin())
        found.append((start, end, edits))
        # Places that end farther behind than this begin behind the taken one anyway.
        near = min(high, end + len(item) + k)
        ends[end : near + 1] = _last_row(item, text[end:near], free_start=True)
        free += [(low, start), (end, high)]
    return sorted(found)


def _last_row(item: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distances of the item to text passages by their end."""
    width = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64) if free_start else width.copy()
    for i, c in enumerate(item):
        above = row + 1
        above[1:] = np.minimum(above[1:], row[:-1] + (text != c))
        above[0] = i + 1
        row = np.minimum.accumulate(above - width) + width
    return row


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The items' indexes, one block after the other; a block holds about BLOCK_CHARS characters.

    Rows that repeat both id and text are one item with a count, so they cannot fill a block.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("length(text) > 0")
    items = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_CHARS))
    for b in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").collect()
        yield Index([r[0] for r in rows], [codes(r[1].encode()) for r in rows], [r[2] for r in rows])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``end``, ``edits``: every place where a document repeats an item."""
    names = ["doc_id", "item_id", "start", "end", "edits"]
    out = None
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value)
            for batch in batches:
                ids = long_ids(batch, "doc_id").to_pylist()
                rows = [
                    (doc, index.ids[i], start, end, edits)
                    for doc, text in zip(ids, texts(batch, "text"), strict=True)
                    for i, start, end, edits in index.matches(codes(text))
                    for _ in range(index.times[i])
                ]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, start long, `end` long, edits long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that repeat no item, with all their columns."""
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(codes(t)) for t in texts(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
