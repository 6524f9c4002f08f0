"""License scan: exact phrase places and fuzzy search for short notices.

Phrases are found where their words stand consecutively. Notices are found with
a bounded number of edits: a notice is split into ``edits + 1`` pieces, of which
at least one must occur unchanged (pigeonhole); every occurrence of a piece
opens a window, and only these windows go through the regex library's
bounded-error matching, which reports the span and the edits of the best match.
Matches are taken by their edits, and what they leave free of a window is searched again.

Whole texts are read, as UTF-8 bytes with A-Z lowered, in Arrow batches; no row
moves. A null text is an empty one: no words, no labels, score 0. Spans are
character offsets. A notice that several spans match yields every one of them;
of overlapping spans the best. Repeated rows are scanned each for itself, a text of
megabytes with a notice on every line takes time in proportion; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.rows import long_ids, texts

# Phrases of the contract with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices, their labels and how many edits they may have.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache-2.0", 4),
    ("released under the mit license", "mit", 3),
    ("licensed under the gnu general public license, version 3", "gpl", 5),
    ("licensed under cc by-nc 4.0", "cc-by-nc", 2),
    ("licensed under cc by-sa 4.0", "cc-by-sa", 2),
    ("licensed under cc by 4.0", "cc-by", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("this file is subject to the mozilla public license", "mpl", 4),
    ("all rights reserved", "reserved", 2),
)

_WORD = rb"0-9a-z\x80-\xff"
WORD = re.compile(rb"[" + _WORD + rb"]+")


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


def lowered(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


class PhraseFinder:
    """Places of word phrases; the start of a place counts in words."""

    def __init__(self, phrases: dict[str, str]):
        gap = rb"[^" + _WORD + rb"]+"
        self.phrases = [
            (re.compile(rb"(?<![" + _WORD + rb"])(?=" + gap.join(map(re.escape, p.encode().split())) + rb"(?![" + _WORD + rb"]))"), label)
            for p, label in phrases.items()
        ]

    def find(self, low: bytes) -> list[tuple[int, str]]:
        """(byte offset, label), by offset."""
        return sorted((m.start(), label) for pattern, label in self.phrases for m in pattern.finditer(low))


class NoticeFinder:
    def __init__(self, notices: tuple[tuple[str, str, int], ...]):
        self.notices = [Notice(*n) for n in notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}") for n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for at, piece in pieces(notice.text, notice.edits + 1):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        if seeds:
            self.seeds.make_automaton()

    def windows(self, low: str) -> dict[int, list[tuple[int, int]]]:
        """Window of every seed by notice: a match must lie within that of one of its seeds."""
        found: dict[int, set[tuple[int, int]]] = {}
        if not len(self.seeds):
            return {}
        for end, (length, places) in self.seeds.iter(low):
            for k, at in places:
                n = self.notices[k]
                begin = end + 1 - length - at
                found.setdefault(k, set()).add((max(0, begin - n.edits), min(len(low), begin + len(n.text) + n.edits)))
        return {k: sorted(spans) for k, spans in found.items()}

    def find(self, low: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of every verified match, by notice and place."""
        out = []
        for k, spans in self.windows(low).items():
            out += [(self.notices[k].label, start, end, edits) for start, end, edits in self._verified(k, spans, low)]
        return out

    def _verified(self, k: int, windows: list[tuple[int, int]], low: str) -> list[tuple[int, int, int]]:
        """Non-overlapping matches, those of fewest edits first, then from the left.

        Each window offers its best match; when that overlaps one already taken,
        the window's free parts are searched instead. A window holds few matches, so it is searched few times.
        """
        least = len(self.notices[k].text) - self.notices[k].edits
        offers: list[tuple[int, int, int, int, int]] = []

        def look(begin: int, end: int) -> None:
            m = self.patterns[k].search(low, begin, end) if end - begin >= max(least, 1) else None
            if m and m.end() > m.start():
                heapq.heappush(offers, (sum(m.fuzzy_counts), m.start(), m.end(), begin, end))

        for window in windows:
            look(*window)
        starts: list[int] = []
        taken: list[tuple[int, int, int]] = []
        while offers:
            edits, start, end, begin, stop = heapq.heappop(offers)
            # Taken matches do not overlap, so those that meet the window are neighbours in order.
            at = max(bisect.bisect_right(starts, begin) - 1, 0)
            inside = []
            while at < len(taken) and taken[at][0] < stop:
                if taken[at][1] > begin:
                    inside.append(taken[at])
                at += 1
            if all(e <= start or s >= end for s, e, _ in inside):
                where = bisect.bisect_right(starts, start)
                starts.insert(where, start)
                taken.insert(where, (start, end, edits))
                inside = sorted([*inside, (start, end, edits)])
            for s, e, _ in inside:
                look(begin, min(s, stop))
                begin = max(begin, e)
            look(begin, stop)
        return taken

    def score(self, label: str, edits: int) -> float:
        return max(1 - edits / len(n.text) for n in self.notices if n.label == label)


def pieces(text: str, count: int) -> list[tuple[int, str]]:
    """(offset, piece): ``count`` pieces of nearly the same length."""
    cuts = [len(text) * i // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, spans array<struct<label:string,start:long,`end`:long,edits:int>>, score double"
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: words, phrase places, labels, verified notice spans and a score.

    The score is 1 with a phrase place; else the largest share of unchanged
    characters (1 - edits / length) of a found notice; else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase_finder, notice_finder = PhraseFinder(phrases), NoticeFinder(tuple(notices))
        for batch in batches:
            rows = [_scan_one(lowered(t or b""), phrase_finder, notice_finder) for t in texts(batch, "text")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.list_(_SPAN), pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"]
            yield pa.RecordBatch.from_arrays(
                [long_ids(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _words_before(low: bytes, end: int) -> int:
    return sum(1 for _ in WORD.finditer(low, 0, end))


def _scan_one(low: bytes, phrases: PhraseFinder, notices: NoticeFinder) -> tuple:
    places = phrases.find(low)
    n_words = sum(1 for _ in WORD.finditer(low))
    first = _words_before(low, places[0][0]) if places else None
    last = _words_before(low, places[-1][0]) if places else None
    base = sorted({label for _, label in places})
    spans = notices.find(low.decode("utf-8", "replace"))
    labels = sorted({*base, *(s[0] for s in spans)})
    score = 1.0 if places else max((notices.score(s[0], s[3]) for s in spans), default=0.0)
    return n_words, len(places), first, last, base, labels, [dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in spans], score
