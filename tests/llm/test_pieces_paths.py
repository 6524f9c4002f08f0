"""Paths of stretches are worked out once, as long as they keep coming, and texts longer than a span keep theirs."""

import pytest

from creditloom.llm import pieces
from creditloom.llm.queries import vocabulary_file


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(vocabulary_file("piece_bpe_32k.model"))


def test_a_common_stretch_stays_known_while_rare_ones_come_and_go(vocabulary, monkeypatch):
    worked = []
    path = pieces.Codec.best_path
    monkeypatch.setattr(pieces.Codec, "best_path", lambda self, stretch: worked.append(stretch) or path(self, stretch))
    monkeypatch.setattr(pieces, "CACHE", 8)
    codec = pieces.Codec(vocabulary)
    for i in range(60):
        codec.encode(f"the rare{i}")
    assert worked.count("▁the") == 1 and len(worked) == 61
    assert len(codec.known) + len(codec.known.older) <= 8


def test_tasks_of_a_worker_share_their_paths(vocabulary):
    first = pieces._codec(vocabulary.pieces, vocabulary.byte_ids)
    assert pieces._codec(vocabulary.pieces, vocabulary.byte_ids) is first


def test_long_texts_are_encoded_span_by_span(vocabulary, monkeypatch):
    texts = ["one  two\nthree " * 20, "x" * 300, "▁a ▁▁ b" * 30, " " * 200, "😀 ü\t" * 40]
    wanted = [pieces.Codec(vocabulary).encode(t) for t in texts]
    monkeypatch.setattr(pieces, "SPAN", 7)
    codec = pieces.Codec(vocabulary)
    assert [codec.encode(t) for t in texts] == wanted
    assert [codec.decode(ids) for ids in wanted] == texts


def test_without_pieces_every_character_is_spelled():
    codec = pieces.Codec(pieces.Vocabulary((), tuple(range(256))))
    assert codec.encode("é a").tolist() == list(" é a".encode())
