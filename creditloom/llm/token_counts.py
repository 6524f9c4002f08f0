"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. A failure link of a node says where matching goes on
when no child fits; following it pops the pieces that are then certain, of which
only the number is stored. One walk over a word's characters, plus popping, gives
the number of pieces of greedy longest-match-first segmentation, without
building a piece.

A text is lowered as the vocabulary is, split at white space and between letters,
digits and other signs; each of these words is counted, and the counts of common
words are remembered up to CACHE words. A word that has no segmentation counts
as one unknown token. Whole texts are read in Arrow batches; no row moves. Null
and empty texts have no words and no tokens; repeated rows are counted each for
itself, other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.rows import long_ids, texts

WORD = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
CACHE = 200_000
END = "</w>"
_NONE, _ROOT = -1, 0


class Automaton:
    """Trie with failure links and popped-piece counts over strings."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        final = [False]
        for piece in sorted(set(pieces)):
            node = _ROOT
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][c]
            if node:
                final[node] = True
        self.fail = [_NONE] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([_ROOT])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if final[node]:  # the whole path is one piece
                    self.fail[node], self.pops[node] = _ROOT, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at != _NONE and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != _NONE:
                    self.fail[node], self.pops[node] = self.next[at][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; one if it has no segmentation, none if it is empty."""
        node, total = _ROOT, 0
        for c in word:
            while c not in self.next[node]:
                total += self.pops[node]
                node = self.fail[node]
                if node == _NONE:
                    return 1
            node = self.next[node][c]
        while node != _ROOT:
            total += self.pops[node]
            node = self.fail[node]
            if node == _NONE:
                return 1
        return total


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


def load_pieces(path: str) -> list[str]:
    """Pieces of a byte-level vocabulary file; the word-end sign is cut off, special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {t["content"] for t in vocabulary.get("added_tokens", [])}
    return sorted({p.removesuffix(END) for p in vocabulary["model"]["vocab"] if p not in special} - {""})


class Counter:
    """Counts tokens of whole texts with one automaton."""

    def __init__(self, pieces: list[str]):
        self.automaton = Automaton(pieces)
        self.letters = byte_letters()
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        known = self.known.get(word)
        if known is None:
            known = self.automaton.count("".join([self.letters[b] for b in word.encode()]))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = known
        return known

    def of_text(self, text: str) -> tuple[int, int]:
        """(words, tokens)"""
        words = tokens = 0
        for m in WORD.finditer(text.lower()):
            words += 1
            tokens += self.of_word(m[0])
        return words, tokens


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.of_text((t or b"").decode("utf-8", "replace")) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [long_ids(batch, "doc_id"), pa.array([w for w, _ in counts], pa.int64()), pa.array([n for _, n in counts], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
