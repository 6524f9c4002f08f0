"""Exact deduplication against plain grouping, the perfect hash by itself, and defined cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from creditloom.llm import exact_dedup
from creditloom.llm.queries import prepared

DOCS = "doc_id long, text string, digest string, points long, `row` string"


def digests(n, salt=""):
    return pa.array([hashlib.sha256(f"{salt}{k}".encode()).digest() for k in range(n)], pa.binary())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 20_000])
def test_slots_are_minimal_and_perfect(n):
    keys = digests(n)
    found = exact_dedup.PerfectHash.build(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(n))
    others = found.slots(digests(50, "other"))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_keys_that_no_table_parts_go_by_their_bytes(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TABLES", 1)
    keys = digests(500)
    found = exact_dedup.PerfectHash.build(keys)
    assert found.tail and sorted(found.slots(keys).tolist()) == list(range(500))
    assert set(found.slots(digests(50, "o")).tolist()) <= set(range(-1, 500))


def plain(rows):
    groups = {}
    for i, text in rows:
        bare = "".join(c for c in text or "" if c not in " \t\n\v\f\r")
        groups.setdefault(hashlib.sha256(bare.encode()).hexdigest(), []).append((-len(text or ""), i is None, i or 0, i))
    out = []
    for sha, own in groups.items():
        keep = min(own)[3]
        out += [(o[3], keep, len(own), sha) for o in own]
    return sorted(out, key=str)


def rows_of(seed, n):
    r = random.Random(seed)
    texts = [None, "", " \t", "a b", "ab", "a b", "é x", "éx ", "A b", "ab ", "long " * 40_000]
    return [(k, r.choice(texts) if r.random() < 0.7 else f"{r.randrange(n)} own") for k in range(n)]


HISTORIES = {
    "half": "pmod(xxhash64(doc_id), 2) = 0",
    "none": "false",
    "all": "true",
    "null": "case when doc_id > 40 then true end",
}


@pytest.mark.parametrize("history", HISTORIES)
def test_groups_and_winners(spark, monkeypatch, history):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    rows = rows_of(3, 400) + [(None, "ab"), (None, None), (-5, "a b"), (7, "twice over"), (7, "twice over"), (7, "twiceover")]
    docs = prepared(spark).createDataFrame([(*row, "x", 1, "y") for row in rows], DOCS)
    got = exact_dedup.deduplicate(docs, F.expr(HISTORIES[history])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    known = {r.text_sha256 for r in got if r.member}
    if history in ("none", "all"):
        assert known == (set() if history == "none" else {r.text_sha256 for r in got})


def test_member_means_that_the_history_holds_the_text(spark):
    rows = rows_of(5, 200)
    docs = prepared(spark).createDataFrame([(*row, "x", 1, "y") for row in rows], DOCS)
    got = exact_dedup.deduplicate(docs, F.col("doc_id") < 100).collect()
    old = {r.text_sha256 for r in got if r.doc_id < 100}
    assert all(r.member == (r.text_sha256 in old) for r in got)


def test_empty_table(spark):
    assert exact_dedup.deduplicate(prepared(spark).createDataFrame([], DOCS)).collect() == []


def test_merge_takes_the_better_winner():
    old = {"points": np.array([5, 5, 5, 5]), "none": np.array([0, 0, 0, 1], bool), "id": np.array([3, 3, 3, 0]), "row": np.array([1, 1, 1, 1])}
    new = {"points": np.array([6, 5, 5, 5]), "none": np.array([0, 0, 1, 1], bool), "id": np.array([9, 2, 0, 0]), "row": np.array([9, 9, 0, 0])}
    assert exact_dedup._better(new, old).tolist() == [True, True, False, True]
