"""Conversation repair against an exhaustive search over edits, and its defined cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from creditloom.llm import dialogue_repair as repair
from creditloom.llm.queries import LLM_QUERIES, prepared

ROWS = "conv_id long, turn long, role string, text string, cost long, key string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    """Plain damage of (conv, turn, role, text), in the order of the repair."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        if case == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if case == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))


def exhaustive(rows):
    """Every sequence of edits by recursion; the cheapest, then ASCII-least audit."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}
    known = {}

    def best(i, state, inserted):
        """(cost, audit, lines) from row i on; ``inserted`` insertions were made in a row."""
        if (i, state, inserted) in known:
            return known[i, state, inserted]
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for c in "ua":
                if (state, c) in NEXT:
                    cost, audit, lines = best(i, c, inserted + 1)
                    ways.append((cost + 2, "I" + audit, (f"{names[c]}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    cost, audit, lines = best(i + 1, NEXT[state, role[:1]], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                for c in "ua":
                    if (state, c) in NEXT:
                        cost, audit, lines = best(i + 1, c, 0)
                        ways.append((cost + 2 + more, "R" + audit, (f"{names[c]}:{text}", *lines)))
        known[i, state, inserted] = min(ways, default=(10**9, "", ()))
        return known[i, state, inserted]

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def expected(rows):
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    return {conv: exhaustive(damaged(own)) for conv, own in by_conv.items()}


def repaired(df):
    found = repair.repair(repair.damage(df), dropped=F.col("dropped")).collect()
    out = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}
    assert len(out) == len(found)
    return out


def conversations(seed, n, longest=9):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"]
    texts = ["Yes.", "No", " ", "", None, "Why? ", "end.\n", " ", "Go on!", "x\u0085"]
    return [
        (conv, None if r.random() < 0.03 else t * r.choice((1, 1, 2)), r.choice(roles), r.choice(texts))
        for conv in range(n)
        for t in range(r.randrange(1, longest))
    ]


def test_binary_powers_are_repeated_steps():
    for symbol in range(16):
        for n in (1, 2, 3, 7, 64, 100):
            vector = repair.MISSING
            for _ in range(n):
                vector = tuple(min(a + b for a, b in zip(row, vector, strict=True)) for row in repair.transition(symbol))
            assert repair.before(symbol, n, repair.MISSING) == vector


def test_one_conversation_against_every_edit():
    r = random.Random(3)
    for _ in range(600):
        rows = [
            (t, r.choice(["system", "user", "assistant", "tool", "user", "assistant"]), r.choice(["a.", "b", "", f"{t}."]))
            for t in range(r.randrange(0, 8))
        ]
        assert repair.repair_rows(rows) == exhaustive(rows), rows


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_table_against_every_edit(spark, parts):
    rows = conversations(5, 150) + [(None, 1, "user", "a."), (None, None, None, None), (-4, 0, "user", "x.")] * 2
    prepared(spark).conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*row, 7, "k") for row in rows], ROWS)
        assert repaired(df) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_conversation_over_all_partitions(spark):
    """A conversation that fills every partition, with long runs and repeats far apart."""
    r = random.Random(9)
    rows = [(1, t, "user" if t % 400 < 200 or r.random() < 0.3 else "assistant", f"{t % 700}" + r.choice(["", ".", "."])) for t in range(3000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = prepared(spark).createDataFrame([(*row, 7, "k") for row in rows], ROWS)
    import sys

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(30000)
    try:
        want = expected(rows)
    finally:
        sys.setrecursionlimit(old)
    assert repaired(df) == want


def test_empty_tables_and_vanished_conversations(spark):
    prepared(spark)
    assert repaired(spark.createDataFrame([], ROWS)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired(spark.createDataFrame([(gone, 0, "user", "a.", 1, "k")], ROWS))
    assert got == {gone: exhaustive([])} and got[gone]["audit"] == ""


def test_long_run_is_unrolled_in_small_steps():
    rows = [(t, "user", f"{t}.") for t in range(20000)]
    got = repair.repair_rows(rows)
    assert got["cost"] == 20000 and len(got["audit"]) >= 20000


def test_query_on_its_table(spark, sf0001):
    rows = spark.read.parquet(f"{sf0001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r.conv_id: r.asDict() for r in LLM_QUERIES["op13_dialogue_repair"].build(spark, sf0001).collect()}
    want = expected([tuple(r) for r in rows])
    assert {c: {k: v for k, v in g.items() if k != "conv_id"} for c, g in got.items()} == want
