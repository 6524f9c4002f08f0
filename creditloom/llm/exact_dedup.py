"""Exact deduplication against a history, through minimal perfect hashes.

Texts are equal when they are identical without the six ASCII white spaces; a
text's digest is the SHA-256 of what is left. Of equal texts the row with the
most code points stays, then the smallest id, then the first row.

The distinct digests of the history are dealt to shards of some ten thousand
keys. Each shard is a minimal perfect hash: keys that meet no other key in a
bit table of twice their number are settled there, the rest go to the next, smaller
table; a key's slot is the number of set bits before its own. Slot k holds the
full digest and the locator of its winner. An arriving text's digest is
sent to its shard, hashed to a slot and compared with the stored digest byte by
byte: a member joins the slot's group, a nonmember forms a group of its own.

What moves are digests and locators, never texts. Arriving rows are grouped
before they move. At most a thousand groups can hold more than a thousandth of
all rows each; their results are broadcast back to the rows, all others
joined, so that no task meets a large group of copies.

Defined cases: a null text counts as empty; a null id sorts last and keeps
null; of rows that repeat both id and text exactly one is kept; empty tables give no
rows; an empty history makes every row a nonmember. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shingles import mix
from creditloom.session import materialize

SHARD_KEYS = 1 << 15
ROOM = 2  # bits of a table per key that is left
TABLES = 48
HOT = 1000  # groups above a HOTth of all rows are few enough to broadcast

LOCATOR = "points long, id long, row long, copies long"
_LOCATOR = ["points", "id", "row", "copies"]
_SLOT = pa.struct([("digest", pa.binary()), *((c, pa.int64()) for c in _LOCATOR)])


# --- minimal perfect hash ---------------------------------------------------------


def _words(digests: pa.Array) -> np.ndarray:
    """Digests of 32 bytes as rows of four numbers."""
    flat = b"".join(digests.to_pylist())
    return np.frombuffer(flat, dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, table: int, size: int) -> np.ndarray:
    h = np.full(len(words), (table + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(4):
        h = mix(h ^ words[:, k])
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0..n-1 of n distinct digests; any other digest gets some slot or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray, tail: dict[bytes, int]):
        self.sizes, self.bits, self.tail = sizes, bits, tail
        self.before = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, digests: pa.Array) -> PerfectHash:
        words, sizes, tables = _words(digests), [], []
        left = np.arange(len(words))
        while len(left) and len(sizes) < TABLES:
            size = max(ROOM * len(left), 8)
            at = _place(words[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            tables.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(tables) if tables else np.zeros(0, dtype=bool)
        settled = int(bits.sum())
        # Keys that no table parts have equal hashes throughout; they are told apart by their bytes.
        return cls(sizes, bits, {digests[int(i)].as_py(): settled + k for k, i in enumerate(left)})

    def slots(self, digests: pa.Array) -> np.ndarray:
        words = _words(digests)
        out = np.full(len(words), -1, dtype=np.int64)
        left, start = np.arange(len(words)), 0
        for table, size in enumerate(self.sizes):
            at = start + _place(words[left], table, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        if self.tail:
            for i in left:
                out[i] = self.tail.get(digests[int(i)].as_py(), -1)
        return out


# --- index of the history ---------------------------------------------------------


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", historical: Column | None = None) -> DataFrame:
    """Row number, id, digest, code points and whether the row belongs to the history; written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(bare, 256)).alias("digest"),
            F.length(text).cast("long").alias("points"),
            F.coalesce(historical, F.lit(False)).alias("historical") if historical is not None else F.lit(False).alias("historical"),
        ),
        "digests",
    )


def groups(described: DataFrame) -> DataFrame:
    """Digest, locator of the winner and number of copies of every distinct text."""
    first = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "row")
    grouped = described.groupBy("digest").agg(F.min(first).alias("w"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("digest", (-F.col("w.points")).alias("points"), "w.id", "w.row", "copies")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the hash, and in slot order digests and winner locators."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        digests = rows.column("digest").combine_chunks()
        found = PerfectHash.build(digests)
        order = pa.array(np.argsort(found.slots(digests)))
        fields = [rows.column(c).combine_chunks().take(order) for c in ("digest", *_LOCATOR)]
        slots = pa.StructArray.from_arrays(fields, fields=list(_SLOT))
        tail = sorted(found.tail, key=found.tail.get)
        return pa.table(
            {
                "shard": rows.column("shard").slice(0, 1).cast(pa.int32()),
                "sizes": pa.array([found.sizes], pa.list_(pa.int32())),
                "bits": pa.array([np.packbits(found.bits).tobytes()], pa.binary()),
                "tail": pa.array([tail], pa.list_(pa.binary())),
                "slots": pa.array([slots.to_pylist()], pa.list_(_SLOT)),
            }
        )

    schema = f"shard int, sizes array<int>, bits binary, tail array<binary>, slots array<struct<digest binary, {LOCATOR}>>"
    keyed = history.select(shard_of(shards), "digest", *_LOCATOR)
    return keyed.groupBy("shard").applyInArrow(build, schema)


def _loaded(index: pa.Table) -> tuple[PerfectHash, pa.StructArray]:
    sizes = index.column("sizes")[0].as_py()
    bits = np.unpackbits(np.frombuffer(index.column("bits")[0].as_py(), dtype=np.uint8), count=sum(sizes)).astype(bool)
    tail = {d: int(bits.sum()) + k for k, d in enumerate(index.column("tail")[0].as_py())}
    return PerfectHash(sizes, bits, tail), index.column("slots")[0].values


def _better(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Where a's winner comes before b's: more points, then smaller id (null last), then smaller row."""
    better, even = a["points"] > b["points"], a["points"] == b["points"]
    for c in ("none", "id", "row"):
        better |= even & (a[c] < b[c])
        even &= a[c] == b[c]
    return better


def _locators(fields: list[pa.Array]) -> dict[str, np.ndarray]:
    named = dict(zip(_LOCATOR, fields, strict=True))
    out = {c: pc.fill_null(a, 0).to_numpy(zero_copy_only=False) for c, a in named.items()}
    return out | {"none": np.asarray(pc.is_null(named["id"]).to_numpy(zero_copy_only=False))}


def merge(arriving: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """One row per distinct text of history and arrivals: digest, winner, copies, member (known to the history)."""

    def probe(rows: pa.Table, index: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        digests = rows.column("digest").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        new = [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], pa.int64()) for c in _LOCATOR]
        if index.num_rows:
            found, slots = _loaded(index)
        else:
            found, slots = PerfectHash([], np.zeros(0, dtype=bool), {}), pa.array([], _SLOT)
        held = slots.field("digest")
        at = found.slots(digests)
        near = np.flatnonzero(at >= 0)
        same = pc.equal(digests.take(pa.array(near)), held.take(pa.array(at[near]))).to_numpy(zero_copy_only=False)
        member = np.zeros(len(at), dtype=bool)
        member[near[same.astype(bool)]] = True
        # Members join their slot; a better arriving winner takes the slot's place.
        old, fresh = _locators([slots.field(c) for c in _LOCATOR]), _locators(new)
        slot, own = at[member], np.flatnonzero(member)
        taken = _better({c: v[own] for c, v in fresh.items()}, {c: v[slot] for c, v in old.items()})
        old["copies"] = old["copies"].copy()
        old["copies"][slot] += fresh["copies"][own]
        for c in ("points", "id", "row", "none"):
            old[c] = old[c].copy()
            old[c][slot[taken]] = fresh[c][own[taken]]
        alone = np.flatnonzero(~member)
        joined = {c: np.concatenate([old[c], fresh[c][alone]]) for c in old}
        return pa.table(
            {
                "digest": pa.concat_arrays([held, digests.take(pa.array(alone))]),
                "points": pa.array(joined["points"], pa.int64()),
                "id": pa.array(joined["id"], pa.int64(), mask=joined["none"].astype(bool)),
                "row": pa.array(joined["row"], pa.int64()),
                "copies": pa.array(joined["copies"], pa.int64()),
                "member": pa.array(np.arange(len(joined["row"])) < len(held), pa.bool_()),
            }
        )

    schema = f"digest binary, {LOCATOR}, member boolean"
    left = arriving.select(shard_of(shards), "digest", *_LOCATOR).groupBy("shard")
    return left.cogroup(index.groupBy("shard")).applyInArrow(probe, schema)


def deduplicate(docs: DataFrame, historical: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept, text_sha256 and member for every row.

    Rows where ``historical`` holds are indexed first, the others are looked up.
    ``member`` says whether the history knows the text.
    """
    described = describe(docs, id_col, text_col, historical)
    rows = described.count()
    shards = max(1, -(-rows // SHARD_KEYS))
    index = materialize(build_index(groups(described.filter("historical")), shards), "perfect-hash")
    merged = merge(groups(described.filter("not historical")), index, shards)
    winners = materialize(
        merged.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size"), "member"),
        "winners",
    )
    large = F.col("group_size") * HOT > rows  # fewer than HOT groups, whatever the input
    hot, others = F.broadcast(winners.filter(large)), winners.filter(~large)
    common = described.join(hot, "digest")
    rest = described.join(hot.select("digest"), "digest", "left_anti").join(others, "digest")
    return common.union(rest.select(*common.columns)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "member",
    )
