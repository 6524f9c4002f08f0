"""SentencePiece encoding and decoding.

Pieces stand in an Aho-Corasick automaton. One pass over a stretch of text
follows the output links at each position, that is every piece that ends there,
and relaxes the best score of that position (Viterbi). A character that no piece
covers becomes the byte pieces of its UTF-8 form, at a score below every piece.

No piece continues after a word into the next blank, so the best path of a text
is that of its stretches (blanks and the word after them) put together; paths of
common stretches are remembered, CACHE of them at most, by all tasks of a worker. A vocabulary where a
piece crosses such a border is refused.

Blanks are written as the blank sign, with one in front of the text. The blank
sign itself, if a text holds it, and control pieces' names are spelled in bytes
or ordinary pieces, so decoding gives back exactly the text.

Whole texts are read in Arrow batches; no row moves. A null text has null ids and
decodes to null; an empty text has no ids. Repeated rows are encoded each for
itself; a column that already has the name of the result is replaced, all others stay.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import inf

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.rows import texts

BLANK = "▁"
_LITERAL = "▁"  # a blank sign of the text itself, held apart while encoding
CACHE = 300_000
PENALTY = 10.0
STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
BORDER = re.compile(f"(?<=[^{BLANK}]){BLANK}")
SPAN = 1 << 20  # characters whose stretches are listed at a time
_BYTES = (1, -1, 0.0)  # one character, spelled


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, int, float], ...]  # text, id, score
    byte_ids: tuple[int, ...]


def load_vocabulary(path: str) -> Vocabulary:
    """Ordinary and byte pieces of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    names = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
    return Vocabulary(
        tuple((model.id_to_piece(i), i, model.get_score(i)) for i in plain), tuple(names[f"<0x{b:02X}>"] for b in range(256))
    )


class Paths(dict):
    """Ids of stretches met so far, as the bytes of an int array; a stretch that is not there is worked out.

    Of two halves of CACHE the older one goes when the newer one is full; what is met again moves to the newer one.
    """

    def __init__(self, best_path: Callable[[str], Sequence[int]]):
        self.best_path, self.older = best_path, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.older.pop(stretch, None)
        if found is None:
            found = array("i", self.best_path(stretch)).tobytes()
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[stretch] = found
        return found


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        crossing = [p for p, _, _ in vocabulary.pieces if re.search(f"[^{BLANK}]{BLANK}", p)]
        if crossing:
            raise ValueError(f"pieces cross a word border: {crossing[:5]}")
        self.vocabulary, self.byte_ids = vocabulary, vocabulary.byte_ids
        self.unknown = min((s for _, _, s in vocabulary.pieces), default=0.0) - PENALTY
        self.table = {i: p.replace(BLANK, " ").encode() for p, i, _ in vocabulary.pieces}
        self.table |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self.known = Paths(self.best_path)
        self.blank = array("i", self.spelled(BLANK))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for piece, number, score in self.vocabulary.pieces:
            automaton.add_word(piece, (len(piece), number, score))
        if self.vocabulary.pieces:
            automaton.make_automaton()
        return automaton

    def best_path(self, stretch: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equal ones the one with the longest last pieces."""
        size, unknown = len(stretch), self.unknown
        best = [0.0] + [-inf] * size
        came = [_BYTES] * (size + 1)
        reached = 0  # positions up to here are settled: the character before them as bytes, if no piece reaches them with more
        for end, piece in self.automaton.iter(stretch) if len(self.automaton) else ():
            while reached < end:
                total = best[reached] + unknown
                reached += 1
                if total > best[reached]:
                    best[reached], came[reached] = total, _BYTES
            end += 1
            total = best[end - piece[0]] + piece[2]
            if total > best[end]:
                best[end], came[end] = total, piece
        while reached < size:
            total = best[reached] + unknown
            reached += 1
            if total > best[reached]:
                best[reached], came[reached] = total, _BYTES
        out, at = [], size
        while at:
            length, number, _ = came[at]
            if number >= 0:
                out.append(number)
            else:
                out += reversed(self.spelled(" " if stretch[at - 1] == BLANK else stretch[at - 1]))
            at -= length
        out.reverse()
        return out

    def spelled(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()]

    def encode(self, text: str) -> array:
        ids = array("i")
        if not text:
            return ids
        path = self.known.__getitem__
        for n, part in enumerate(text.split(BLANK)):
            if n:  # the blank sign itself
                ids.extend(self.blank)
            marked = ("" if n else BLANK) + part.replace(" ", BLANK)
            at = 0
            while at < len(marked):
                border = BORDER.search(marked, at + SPAN) if len(marked) - at > SPAN else None
                until = border.start() if border else len(marked)
                ids.frombytes(b"".join(map(path, STRETCH.findall(marked, at, until))))
                at = until
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _codec(pieces: tuple, byte_ids: tuple) -> Codec:
    """The codec of a worker; its tasks over the same vocabulary share the paths met so far."""
    return Codec(Vocabulary(pieces, byte_ids))


def _ids_array(rows: list[array | None]) -> pa.Array:
    ends, flat = [0], array("i")
    for ids in rows:
        flat.extend(ids or ())
        ends.append(len(flat))
    values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
    mask = pa.array([ids is None for ids in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns but the text, which gives way to its ids."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_ids))
    others = [c for c in docs.columns if c not in (text_col, out_col)]
    kind = T.StructType([docs.schema[c] for c in others]).add(out_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            ids = [None if t is None else codec.encode(t.decode("utf-8", "replace")) for t in texts(batch, text_col)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, _ids_array(ids)], [*others, out_col])

    return docs.select(*(f"`{c}`" for c in others), f"`{text_col}`").mapInArrow(run, kind)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All columns, and the text that the ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_ids))
    kept = [c for c in encoded.columns if c != out_col]
    kind = T.StructType([encoded.schema[c] for c in kept]).add(out_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids_col))
            out = [None if not r.is_valid else codec.decode(r.values.to_numpy(zero_copy_only=False).tolist()) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*kept, out_col])

    return encoded.select(*(f"`{c}`" for c in kept)).mapInArrow(run, kind)
