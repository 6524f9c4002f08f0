"""Importance resampling against plain loops, and its defined cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from creditloom.llm import resampling
from creditloom.llm.queries import prepared

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score long, rank string, bucket int"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    w = WORDS.findall((text or "").translate(ASCII_LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def checksums(text):
    return sorted(zlib.crc32(f.encode()) for f in plain_features(text))


def noise(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("aB9 .é世-\n@`{") for _ in range(n))


TEXTS = [None, "", " \n", "a", "x" * 200, "x" * 64, "y" * 63 + " " + "z" * 65, "é" * 500 + " b", "A b  C.d", "ÄÉ\x85 x"]
TEXTS += [noise(k, 3 * k) for k in range(120)]


@pytest.mark.parametrize("piece", [1 << 20, 50, 7])
def test_checksums_of_all_features(monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    got = [[] for _ in TEXTS]
    for owner, sums in resampling.features([None if t is None else t.encode() for t in TEXTS]):
        for o, s in zip(owner.tolist(), sums.tolist(), strict=True):
            got[o].append(s)
    assert [sorted(g) for g in got] == [checksums(t) for t in TEXTS]


def test_long_spans_are_folded_in_blocks():
    data = np.frombuffer(noise(1, 100_000).encode(), dtype=np.uint8)
    start = np.array([0, 0, 5, 17, 1000, 3])
    length = np.array([1, 64, 65, 129, 90_000, 4096])
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start, length, strict=True)]
    assert resampling.span_checksums(data, start, length).tolist() == want
    assert len(resampling.span_checksums(data, start[:0], length[:0])) == 0


def test_a_text_of_megabytes():
    text = "q" * 2_500_000 + " w " + " ".join(noise(2, 40) for _ in range(20_000)) + " " + "r" * 1_200_000
    got = [s for _, sums in resampling.features([text.encode()]) for s in sums.tolist()]
    assert sorted(got) == checksums(text)


def plain(rows, target, percent=25, least=20, buckets=10_000):
    corpus, wanted = [[0] * buckets for _ in range(2)]
    for _, t in rows:
        for c in checksums(t):
            corpus[c % buckets] += 1
    for t in target:
        for c in checksums(t):
            wanted[c % buckets] += 1
    s, t = sum(corpus), sum(wanted)
    gain = [
        math.floor(1000.0 * math.log(float(wanted[b] + 1) * float(s + buckets) / (float(corpus[b] + 1) * float(t + buckets))))
        for b in range(buckets)
    ]
    out = []
    for i, text in rows:
        own = [gain[c % buckets] for c in checksums(text)]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in out), key=str)


def test_every_document_against_plain_loops(spark):
    r = random.Random(4)
    words = ["Loan", "café", "risk", "x", "déjà", "42", "the", "of", "Q" * 90]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice((0, 5, 19, 20, 60))))) for k in range(300)]
    rows += [(None, None), (1000, None), (1001, ""), (7, rows[7][1]), (None, " ".join(words * 5)), (-3, noise(8, 3000))]
    target = ["the risk of loan 42", None, "café café"]
    prepared(spark)
    docs = spark.createDataFrame([(*row, 1, "r", 2) for row in rows], DOCS)
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, target)


def test_empty_corpus_and_empty_target(spark):
    prepared(spark)
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b " * 30, 1, "r", 2), (2, "c", 1, "r", 2)], DOCS)
    assert resampling.resample(none, some).collect() == []
    rows = [(1, "a b " * 30), (2, "c")]
    assert sorted((tuple(r) for r in resampling.resample(some, none, percent=100).collect()), key=str) == plain(rows, [], 100)
