"""Repair of conversation structure at least cost, by dynamic programming over runs.

A conversation is brought to the role order ``(s?(ua)+)?`` with the edits Keep
(0), Rerole (2), Delete (3, the only one for blank and repeated rows) and Insert
(2); a truncated row that stays costs 1 more. A row's symbol is the kind of its role
and its fault; equal consecutive symbols form a run. What a row does to the four
states of the pattern is a min-plus matrix, and a run of n rows is worked off
with the cached powers 1, 2, 4, ... of that matrix. Costs to go are carried from
the end to the front; the audit is then read off from the front, always by the
ASCII-least letter that keeps the least cost. State and letter determine
what follows, so the audit found is the least of all cheapest ones.

Rows are range-partitioned and sorted by conversation, turn (null first), role and
digest of the text. A conversation that lies inside one partition is done there
in the same pass. The first and the last one of each partition may reach into
others: their rows are written, each partition's part becomes a segment with
a matrix of its own, and segments are joined by their matrices. So a conversation
of any length is spread over the partitions it fills; only the final SHA-256,
which has to run from front to back, streams its pieces through one task.

Defined cases: a null role or text is one space, a null id or turn in the hashed
key too; equal turns are ordered by role, then digest of the text, equal rows
are adjacent; a role's initial is its first character, an empty role has none and has to
change; a conversation without rows has zeros, an empty audit and the hash of no
bytes; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from creditloom.session import materialize

BLANKS = " \t\n\v\f\r"
EMPTY, SYSTEM, USER, ANSWER = range(4)
KINDS = {"s": 0, "u": 1, "a": 2}  # of a role, by its initial; 3: any other
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
DROPPED = -1
# State after a row of each kind is kept; the only insertion a state allows; what is missing at the end.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ANSWER, None), (None,) * 4)
INSERTED = (USER, USER, ANSWER, USER)
MISSING = (0, 4, 2, 0)
ROLE = {USER: "user", ANSWER: "assistant"}
FAR = 1 << 50
LEGAL = {(0, 1), (1, 2), (2, 1)}
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# --- transitions ------------------------------------------------------------------


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + y for x, y in zip(row, col, strict=True)), FAR) for col in zip(*b, strict=True)) for row in a)


@cache
def transition(symbol: int) -> Matrix:
    """Least cost from state to state over one row, insertions before it included."""
    kind, fault = divmod(symbol, 4)
    rows = []
    for start in range(4):
        cost, at, out = 0, start, [FAR] * 4
        for _ in range(3):  # no further insertions, they would only come round again
            ways = [(3, at)]
            if fault < BLANK:
                ways += [(fault, KEPT[kind][at]), (2 + fault, KEPT[1][at]), (2 + fault, KEPT[2][at])]
            for price, to in ways:
                if to is not None:
                    out[to] = min(out[to], cost + price)
            cost, at = cost + 2, INSERTED[at]
        rows.append(tuple(out))
    return tuple(rows)


@cache
def power(symbol: int, k: int) -> Matrix:
    """Transition over 2**k rows of one symbol."""
    return transition(symbol) if k == 0 else multiply(power(symbol, k - 1), power(symbol, k - 1))


@lru_cache(1 << 16)
def _moved(symbol: int, k: int, above: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, above, strict=True)) for row in power(symbol, k))


def before(symbol: int, n: int, after: Vector) -> Vector:
    """Costs to go in front of a run of n rows, from those behind it."""
    k = 0
    while n >> k:
        if n >> k & 1:
            least = min(after)
            after = tuple(x + least for x in _moved(symbol, k, tuple(x - least for x in after)))
        k += 1
    return after


def runs(symbols: Iterable[int]) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def behind_each(parts: Sequence[tuple[int, int]], after: Vector) -> tuple[list[Vector], Vector]:
    """Costs to go behind every run, and in front of all."""
    out = []
    for symbol, n in reversed(parts):
        out.append(after)
        after = before(symbol, n, after)
    return out[::-1], after


def span_matrix(parts: Sequence[tuple[int, int]]) -> Matrix:
    """Transition over a whole segment: costs to go towards each single state."""
    columns = [behind_each(parts, tuple(0 if i == j else FAR for i in range(4)))[1] for j in range(4)]
    return tuple(tuple(min(c[i], FAR) for c in columns) for i in range(4))


def unroll(parts: Sequence[tuple[int, int]], after: Vector, state: int) -> Iterator[tuple[str, int]]:
    """Letter and following state of every edit, the ASCII-least of the cheapest."""
    ends, _ = behind_each(parts, after)
    for (symbol, n), end in zip(parts, ends, strict=True):
        kind, fault = divmod(symbol, 4)
        todo = [(n, end)]
        while todo:
            size, end = todo.pop()
            if size > 1:  # halve the run: the front part ends where the powers carry the back part
                back = 1 << (size - 1).bit_length() - 1
                todo += [(back, end), (size - back, before(symbol, back, end))]
                continue
            front = before(symbol, 1, end)
            while True:
                need = front[state]
                if 3 + end[state] == need:
                    yield "D", state
                    break
                if 2 + front[INSERTED[state]] == need:
                    state = INSERTED[state]
                    yield "I", state
                    continue
                to = KEPT[kind][state]
                if to is not None and fault + end[to] == need:
                    state = to
                    yield "K", state
                    break
                state = next(KEPT[k][state] for k in (1, 2) if KEPT[k][state] is not None and 2 + fault + end[KEPT[k][state]] == need)
                yield "R", state
                break


def closing(state: int) -> Iterator[tuple[str, int]]:
    """Insertions behind the last row."""
    while MISSING[state]:
        state = INSERTED[state]
        yield "I", state


# --- rows -------------------------------------------------------------------------


def code_of(role: str, text: str) -> int:
    """Symbol of a row as far as it follows from the row alone."""
    bare = text.strip(BLANKS)
    fault = BLANK if not bare else FINE if bare[-1] in ".!?" else TRUNCATED
    return KINDS.get(role[:1], 3) * 4 + fault


def repaired(edits: Iterable[tuple[str, int]], rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the rows that stay or come in."""
    for letter, state in edits:
        if letter == "I":
            yield f"{ROLE[state]}:"
            continue
        role, text = next(rows)
        if letter != "D":
            yield f"{role if letter == 'K' else ROLE[state]}:{text}"


def turn_figures(turns: Iterable[int | None]) -> tuple[int | None, int | None, int]:
    """Smallest, largest and number of distinct turns, which come in order."""
    known = [t for t in turns if t is not None]
    distinct = sum(a != b for a, b in zip(known, known[1:], strict=False)) + bool(known)
    return (known[0], known[-1], distinct) if known else (None, None, 0)


def counts(symbols: Sequence[int]) -> dict[str, int]:
    faults = [s % 4 for s in symbols]
    kinds = [s // 4 for s in symbols]
    return {
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False)),
    }


def repair_rows(rows: Sequence[tuple[int | None, str, str]]) -> dict:
    """Figures, cost, audit and hash of one conversation's (turn, role, text) rows in order."""
    seen: set[tuple[str, str]] = set()
    symbols = []
    for _, role, text in rows:
        symbol = code_of(role, text)
        if symbol % 4 < BLANK:
            symbol = symbol - symbol % 4 + DUPLICATE if (role, text) in seen else symbol
            seen.add((role, text))
        symbols.append(symbol)
    low, high, distinct = turn_figures(t for t, _, _ in rows)
    parts = runs(symbols)
    edits = list(unroll(parts, MISSING, EMPTY))
    edits += closing(edits[-1][1] if edits else EMPTY)
    body = "\n".join(repaired(edits, ((role, text) for _, role, text in rows)))
    return {
        "gaps": high - low + 1 - distinct if distinct else 0,
        **counts(symbols),
        "cost": behind_each(parts, MISSING)[1][EMPTY],
        "audit": "".join(letter for letter, _ in edits),
        "repaired_sha256": hashlib.sha256(body.encode()).hexdigest(),
    }


# --- conversations of one partition -------------------------------------------------

_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _flushed(rows: Iterator[dict], schema: pa.Schema, most_rows: int = 1000, most_chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or row.get("piece") or "")
        if len(held) >= most_rows or size >= most_chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _by_rows(function: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema):
    """A function over all rows of a partition as one over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed(function(row for batch in batches for row in batch.to_pylist()), schema)

    return run


def _one_pass(rows: Iterator[dict]) -> Iterator[dict]:
    """Finished conversations, and the rows of the first and the last one as they are."""
    held: list[dict] = []
    first = None
    for row in rows:
        if first is None:
            first = row["key"]
        if row["key"] == first:
            yield row | {"done": False}
            continue
        if held and held[0]["key"] != row["key"]:
            yield _finished(held)
            held = []
        held.append(row)
    for row in held:
        yield row | {"done": False}


def _finished(rows: list[dict]) -> dict:
    there = [(r["turn"], r["role"], r["text"]) for r in rows if not r["dropped"]]
    return {"done": True, "key": rows[0]["key"], "conv": rows[0]["conv"], **repair_rows(there)}


# --- conversations over several partitions ------------------------------------------


def _summarised(rows: Iterator[dict]) -> Iterator[dict]:
    """Matrix and figures of each segment."""
    for row in rows:
        symbols = [r["code"] for r in row["rows"] if r["code"] != DROPPED]
        low, high, distinct = turn_figures(r["turn"] for r in row["rows"] if r["code"] != DROPPED)
        yield {
            "key": row["key"],
            "part": row["part"],
            "conv": row["conv"],
            "codes": bytes(symbols),
            "matrix": [x for line in span_matrix(runs(symbols)) for x in line],
            "ends": [symbols[0] // 4, symbols[-1] // 4] if symbols else None,
            "low": low,
            "high": high,
            "distinct": distinct,
            **counts(symbols),
        }


def _combined(segments: pa.Table) -> Iterator[dict]:
    """Totals of a conversation, and costs to go behind each of its segments."""
    parts = sorted(segments.to_pylist(), key=lambda s: s["part"])
    after, behind = MISSING, []
    for s in reversed(parts):
        behind.append(after)
        m = s["matrix"]
        after = tuple(min(m[4 * i + j] + after[j] for j in range(4)) for i in range(4))
    low, last, distinct, illegal, end = None, None, 0, 0, None
    for s in parts:
        if s["distinct"]:
            distinct += s["distinct"] - (s["low"] == last)
            low, last = (s["low"] if low is None else low), s["high"]
        if s["ends"]:
            illegal += s["illegal"] + (end is not None and (end, s["ends"][0]) not in LEGAL)
            end = s["ends"][1]
    total = {c: sum(s[c] for s in parts) for c in ("blank", "duplicate", "truncated")}
    total |= {"illegal": illegal, "cost": after[EMPTY], "gaps": last - low + 1 - distinct if distinct else 0}
    for s, togo in zip(parts, reversed(behind), strict=True):
        yield {"key": s["key"], "part": s["part"], "conv": s["conv"], "togo": list(togo), "last": s is parts[-1], **total}


def _exits(rows: Iterator[dict]) -> Iterator[dict]:
    """State in which the least audit leaves a segment, for each state it may be entered in."""
    for row in rows:
        parts, after = runs(row["codes"]), tuple(row["togo"])
        out = []
        for state in range(4):
            for _, state in unroll(parts, after, state):  # noqa: B020
                pass
            out.append(state)
        yield {"key": row["key"], "part": row["part"], "exits": out}


def _entered(segments: pa.Table) -> Iterator[dict]:
    state = EMPTY
    for s in sorted(segments.to_pylist(), key=lambda s: s["part"]):
        yield {"key": s["key"], "part": s["part"], "entry": state}
        state = s["exits"][state]


PIECE = 1 << 16


def _pieces(texts: pa.Table, plan: pa.Table) -> Iterator[dict]:
    """Audit and repaired text of a segment, in pieces of bounded size."""
    if not plan.num_rows:
        return
    p = plan.to_pylist()[0]
    there = sorted((r for r in texts.to_pylist() if not r["dropped"]), key=lambda r: r["place"])
    edits = list(unroll(runs(p["codes"]), tuple(p["togo"]), p["entry"]))
    if p["last"]:
        edits += closing(edits[-1][1] if edits else p["entry"])
    audit = "".join(letter for letter, _ in edits)
    at = {"key": p["key"], "part": p["part"]}
    k = 0
    for k, start in enumerate(range(0, len(audit), PIECE)):  # noqa: B007
        yield at | {"k": k, "letters": audit[start : start + PIECE]}
    held, size = [], 0
    for line in repaired(edits, ((r["role"], r["text"]) for r in there)):
        held.append(line)
        size += len(line)
        if size >= PIECE:
            k += 1
            yield at | {"k": k, "piece": "\n".join(held)}
            held, size = [], 0
    if held:
        yield at | {"k": k + 1, "piece": "\n".join(held)}


def _chained(rows: Iterator[dict]) -> Iterator[dict]:
    """Whole audit and hash of each conversation from its pieces in order."""
    for key, pieces in groupby(rows, key=lambda r: r["key"]):
        digest, letters, some = hashlib.sha256(), [], False
        for row in pieces:
            if row["letters"] is not None:
                letters.append(row["letters"])
            if row["piece"] is not None:
                digest.update((("\n" if some else "") + row["piece"]).encode())
                some = True
        yield {"key": key, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    return df.mapInArrow(_by_rows(function, _arrow(schema)), schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _grouped(function, schema: str, both: bool = False):
    arrow = _arrow(schema)

    def one(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(function(rows)), arrow)

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(function(left, right)), arrow)

    return two if both else one


def _spread(pending: DataFrame, kind: str) -> DataFrame:
    """Result of every conversation in ``pending`` rows, segment by segment."""
    part = F.shiftright("place", 33).alias("part")
    digest = F.sha2("text", 256).alias("digest")
    slim = pending.select("key", part, "place", "conv", "turn", "role", digest, "code")
    first = slim.filter(F.col("code") != DROPPED).groupBy("key", "role", "digest").agg(F.min("place").alias("first"))
    known = slim.join(first, ["key", "role", "digest"], "left")
    again = (F.col("code") != DROPPED) & (F.col("code") % 4 < BLANK) & (F.col("place") > F.col("first"))
    code = F.when(again, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code"))
    # A segment's rows come from one partition, so no group is larger than a partition.
    segments = known.groupBy("key", "part").agg(
        F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("place", code.alias("code"), "turn"))).alias("rows")
    )
    figures = "blank long, duplicate long, truncated long, illegal long"
    summary = materialize(
        _mapped(
            segments,
            _summarised,
            f"key string, part long, conv {kind}, codes binary, matrix array<long>, ends array<int>,"
            f" low long, high long, distinct long, {figures}",
        ),
        "segments",
    )
    total = f"key string, part long, conv {kind}, togo array<long>, last boolean, {figures}, cost long, gaps long"
    combined = materialize(summary.drop("codes").groupBy("key").applyInArrow(_grouped(_combined, total), total), "totals")
    plan = summary.select("key", "part", "codes").join(combined.select("key", "part", "togo", "last"), ["key", "part"])
    exits = _mapped(plan, _exits, "key string, part long, exits array<int>")
    entry = "key string, part long, entry int"
    plan = plan.join(exits.groupBy("key").applyInArrow(_grouped(_entered, entry), entry), ["key", "part"])
    piece = "key string, part long, k long, letters string, piece string"
    pieces = (
        pending.select("key", part, "place", "role", "text", "dropped")
        .groupBy("key", "part")
        .cogroup(plan.groupBy("key", "part"))
        .applyInArrow(_grouped(_pieces, piece, both=True), piece)
    )
    ordered = pieces.repartition("key").sortWithinPartitions("key", "part", "k")
    ends = _mapped(ordered, _chained, "key string, audit string, repaired_sha256 string")
    closed = combined.filter("last").join(ends, "key", "left")
    return closed.select(
        "conv",
        *["gaps", "blank", "duplicate", "truncated", "illegal", "cost"],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    A conversation whose rows are all ``dropped`` still has its result.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    text, role = F.coalesce(F.col(text_col), F.lit(" ")), F.coalesce(F.col(role_col), F.lit(" "))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.substring(role, 1, 1)
    kinds = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    keyed = rows.select(
        F.when(F.col(id_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(id_col).cast("string"))).alias("key"),
        F.col(id_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        gone.alias("dropped"),
        F.when(gone, DROPPED).otherwise(kinds * 4 + fault).cast("int").alias("code"),
        F.sha2(text, 256).alias("digest"),
    )
    order = ["key", "turn", "role", "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("digest")
    placed = placed.withColumn("place", F.monotonically_increasing_id())
    schema = (
        f"done boolean, key string, conv {kind}, turn long, role string, text string, dropped boolean, code int, place long, {_FIGURES}"
    )
    work = materialize(_mapped(placed, _one_pass, schema), "conversations")
    pending = work.filter("not done").select("key", "conv", "turn", "role", "text", "dropped", "code", "place")
    result = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return work.filter("done").select("conv", *result).union(_spread(pending, kind)).withColumnRenamed("conv", id_col)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults: one in twenty is marked dropped, emptied, cut of its stops, repeated or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col))) % 20
    text, role = blank(text_col), blank(role_col)
    return rows.select(
        id_col,
        turn_col,
        F.when(case == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        (case == 0).alias("dropped"),
        F.when(case == 3, 2).otherwise(1).alias("times"),
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "col")
