"""MinHash near-duplicate search by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles. Equal sets form one
class, and only classes are compared. A class has a signature of COORDINATES
minima; each coordinate-value pair is a posting list.

*Prefix.* Two classes are candidates if at least MATCHES coordinates agree. Put
a class's values in order of their list lengths: the candidates of a class agree
with it in one of all but its last MATCHES - 1 values, so only those are posted.
The longest lists, among them those of passages that many documents share, are
*skipped*, and values without a second class need no posting at all.

*Counting.* In each remaining list every class is compared with the smallest
one: matching coordinates are counted first, then full sets are intersected.
Confirmed links are merged into components. Where a list still holds classes of
several components, those outside its largest one are compared with all members,
in blocks inside tasks, leaving out pairs that already belong together or meet in
another list; only new links leave a task, so a group of thousands of copies
yields about as many links as members, never all pairs.

With 64 coordinates and 34 matches, a pair of exactly 75 % similarity stays
unseen with a chance of about 2e-5, of 80 % with 1e-8; every link is confirmed
on full sets, so none is wrong.

Defined cases: a document without words has an empty set, is linked with nothing
and is its own component; a null doc_id takes part, but is never a component's
id: the id of a component is its smallest non-null doc_id (null if none); rows
that repeat a doc_id are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm import id_bitmap
from creditloom.llm.components import components
from creditloom.llm.rows import long_ids, texts
from creditloom.llm.shingles import mix, shingle_set
from creditloom.session import discard, materialize

COORDINATES, MATCHES = 64, 34
PERCENT = 75
BLOCK = 512
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each coordinate's hash function over the set, as signed 64-bit numbers."""
    out = np.empty(COORDINATES, dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = shingles * seed
        out[k] = ((x ^ (x >> np.uint64(32))) * _SEEDS[(k + 1) % COORDINATES]).min()
    return out.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _lists(rows: list[np.ndarray], kind=pa.int64()) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), kind))


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` (null for an empty set) and ``sig`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in texts(batch, "text"):
                own = shingle_set(text)
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else None)
                sigs.append(signature(own) if len(own) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [long_ids(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(sigs)],
                ["doc_id", "n_shingles", "key", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, sig array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``key`` and the whole set of every row, in ascending order of signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text) for text in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), _lists([np.sort(s.view(np.int64)) for s in sets])], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles array<long>")


def set_classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set with a node number: the smallest doc_id, the size and the signature."""
    grouped = rows.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    return materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def posted(classes: DataFrame) -> DataFrame:
    """``value``, ``node``: the prefix of every class that can have a candidate."""
    all_values = classes.select("node", F.explode("sig").alias("value"))
    lengths = all_values.groupBy("value").count().filter("count > 1")
    shared = all_values.join(lengths, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("own"))
    prefix = F.slice("own", 1, F.size("own") - (MATCHES - 1))
    return shared.filter(F.size("own") >= MATCHES).select("node", F.explode(prefix).alias("entry")).select("entry.value", "node")


def similar(inter, left, right):
    return 100 * inter >= PERCENT * (left + right - inter)


def star_pairs(posts: DataFrame) -> DataFrame:
    """Every class of a list with the list's smallest one."""
    hubs = posts.groupBy("value").agg(F.min("node").alias("hub"))
    return posts.join(hubs, "value").filter("node > hub").select("hub", "node").distinct()


def candidates(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs with enough matching coordinates and sizes that can be similar; only signatures move."""
    left = signed.select(F.col("node").alias("hub"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = signed.select("node", F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    fitting = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return pairs.join(left, "hub").join(right, "node").filter(fitting & (agree >= MATCHES)).select("hub", "node")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar."""
    left = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("a"))
    right = sets.select("node", F.col("shingles").alias("b"))
    near = pairs.join(left, "hub").join(right, "node")
    return near.filter(similar(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("hub", "node")


def open_lists(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists, one of each content, that hold more than two classes and several components.

    ``bulk`` is the component with most members in the list, ``n`` counts all members, ``few`` those outside it.
    """
    own = posts.join(roots, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root"))
    mark = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
    by_root = own.groupBy("value", "root").agg(F.count("*").alias("c"), mark.alias("mark"))
    lists = by_root.groupBy("value").agg(
        F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most"), F.sum("mark").alias("mark")
    )
    open_ = lists.filter("n > 2 and most.c < n").groupBy("n", "mark").agg(F.min("value").alias("value"), F.first("most").alias("most"))
    kept = open_.select("value", "n", F.col("most.root").alias("bulk"), (F.col("n") - F.col("most.c")).alias("few"))
    return own.join(kept, "value")


def _cells(lists: DataFrame) -> DataFrame:
    """Members outside the bulk (``left``) beside all members (``right``), in blocks: every pair of blocks is one cell.

    A member outside the bulk is in one cell on both sides, and goes there as one row.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    outside = F.col("root") != F.col("bulk")
    placed = lists.select("*", outside.alias("outside"), place("few").alias("own_i"), place("n").alias("own_j"))
    left = placed.filter("outside").select("*", F.col("own_i").alias("i"), every("n").alias("j"))
    right = placed.select("*", every("few").alias("i"), F.col("own_j").alias("j")).filter("not outside or i != own_i")
    carried = ["value", "node", "root", "size", "sig", "posted"]
    return left.select(*carried, F.lit(True).alias("left"), (F.col("j") == F.col("own_j")).alias("right"), "i", "j").union(
        right.select(*carried, F.lit(False).alias("left"), F.lit(True).alias("right"), "i", "j")
    )


def _partners(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For every member outside the bulk the members of other components that agree with it in enough coordinates.

    Two classes may meet in several lists; they are compared in the list of
    their smallest common posted value only.
    """
    sig = np.stack(frame["sig"].to_list())
    posted_here = (frame["posted"].to_numpy("int64")[:, None] >> np.arange(COORDINATES)) & 1 == 1
    size, root, value = frame["size"].to_numpy(), frame["root"].to_numpy(), frame["value"].iat[0]
    left, right = frame["left"].to_numpy(bool), np.flatnonzero(frame["right"].to_numpy(bool))
    most = np.iinfo(np.int64).max
    for a in np.flatnonzero(left):
        rest = right[(root[right] != root[a]) & (100 * np.minimum(size[right], size[a]) >= PERCENT * np.maximum(size[right], size[a]))]
        same = sig[rest] == sig[a]
        first = np.where(same & posted_here[rest] & posted_here[a], sig[a], most).min(axis=1, initial=most)
        yield a, rest[(same.sum(axis=1) >= MATCHES) & (first == value)]


def with_partner(frame: pd.DataFrame) -> pd.DataFrame:
    """The members of a cell that agree with another one: one row each, however many partners it has."""
    seen = np.zeros(len(frame), dtype=bool)
    for a, rest in _partners(frame):
        if len(rest):
            seen[a] = seen[rest] = True
    return frame.loc[seen, ["value", "i", "j", "node", "root", "left", "right", "size", "sig", "posted"]]


def new_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between members of different components, as few as join them, from one cell."""
    sets = [np.asarray(s) for s in frame["shingles"]]
    size, node, links = frame["size"].to_numpy(), frame["node"].to_numpy(), []
    _, root = np.unique(frame["root"].to_numpy(), return_inverse=True)
    for a, rest in _partners(frame):
        rest = rest[root[rest] != root[a]]
        if not len(rest):
            continue
        flat = np.concatenate([sets[b] for b in rest])
        at = np.minimum(np.searchsorted(sets[a], flat), size[a] - 1)
        inter = np.add.reduceat(sets[a][at] == flat, np.cumsum(size[rest]) - size[rest], dtype=np.int64)
        for b in rest[similar(inter, size[a], size[rest])]:
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                links.append((node[a], node[b]))
    return pd.DataFrame(links, columns=["hub", "node"], dtype="int64")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and full set of the classes in ``nodes``; only texts that may belong to one of them are moved."""
    own = wanted.join(nodes, "node", "left_semi").select("doc_id", "key", "node")
    own = materialize(own, "own")
    ids = own.select("doc_id").distinct()
    readable = docs.select(F.col("doc_id").cast("long"), "text")
    near, _ = id_bitmap.split(readable, "doc_id", own, "doc_id")
    read = full_sets(near.join(ids, near["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi"))
    sets = materialize(read.join(own.select("key", "node"), "key").dropDuplicates(["key"]).drop("key"), "sets")
    discard(own)
    return sets


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node``, ``root`` of the classes that are linked with another one."""
    posts = materialize(posted(classes), "posts")
    prefixes = posts.groupBy("node").agg(F.collect_list("value").alias("posted"))
    # One bit for each coordinate whose value is posted.
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    bits = F.transform("sig", lambda v, k: F.when(F.array_contains("posted", v), bit(k)).otherwise(F.lit(0).cast("long")))
    posted_bits = F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    wanted = prefixes.join(classes, "node").select("node", "key", "doc_id", "n", "sig", posted_bits.alias("posted"))
    wanted = materialize(wanted, "wanted")
    pairs = materialize(candidates(star_pairs(posts), wanted), "pairs")
    sets = sets_of(docs, pairs.select("node").union(pairs.select("hub")).distinct(), wanted)
    links = materialize(confirmed(pairs, sets), "confirmed")
    discard(pairs, sets)
    roots = materialize(components(links, "hub", "node"), "roots")
    discard(links)
    # Cells are searched by signatures first; sets follow only for members that have a partner.
    signed = wanted.select("node", F.col("n").alias("size"), "sig", "posted")
    cells = _cells(open_lists(posts, roots).join(signed, "node"))
    place = "value long, i int, j int, node long, root long, left boolean, right boolean, size long, sig array<long>, posted long"
    # Few bytes and much work in a cell: a fixed number of partitions, which adaptive execution does not merge by size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "value", "i", "j")
    met = materialize(cells.groupBy("value", "i", "j").applyInPandas(with_partner, place), "met")
    discard(posts)
    if met.isEmpty():
        discard(met, wanted)
        return roots
    sets = sets_of(docs, met.select("node").distinct(), wanted)
    full = met.join(sets, "node")
    more = materialize(full.groupBy("value", "i", "j").applyInPandas(new_links, "hub long, node long"), "more")
    discard(met, wanted, sets)
    if more.isEmpty():
        discard(more)
        return roots
    joined = materialize(components(roots.select(F.col("root").alias("hub"), "node").union(more), "hub", "node"), "roots")
    discard(more, roots)
    return joined


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``key``, ``root``, ``kept`` of every row; ``kept`` marks ``doc_id = component_id``."""
    rows = materialize(describe(docs), "described")
    classes = set_classes(rows)
    roots = link_classes(docs, classes)
    named = classes.join(roots, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))
    # Written first, so that both sides of the join come from a shuffle that Spark can split for a large component.
    ids = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    named = materialize(named.join(ids, "root").select("key", "root", "component_id"), "components")
    discard(classes, roots, ids)
    found = rows.drop("sig").join(named, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), "key", "root").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of every group, with all columns of ``docs``.

    The row of the smallest doc_id stays; of rows that repeat it the one with
    the smallest set key, and of equal ones any. Documents without words all
    stay. Groups without any id keep the row of the smallest key.
    """
    marked = materialize(near_duplicates(docs), "marked")
    repeats = marked.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id")
    # Only rows whose id may belong to a row that goes, or occurs several times, are joined; all others stay where they are.
    others = marked.filter("not (kept or n_shingles = 0)").select("doc_id").union(repeats).distinct()
    others = materialize(others.withColumnRenamed("doc_id", "__other_id"), "others")
    near, far = id_bitmap.split(docs, "doc_id", others, "__other_id")
    once = far.union(near.filter("doc_id is not null").join(others, F.col("doc_id") == F.col("__other_id"), "left_anti"))
    if repeats.isEmpty():
        return once
    return once.union(_one_of_repeats(docs, marked, repeats))


def _one_of_repeats(docs: DataFrame, marked: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows whose id is null or occurs several times: chosen by id and set, then one row of each choice."""
    few = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    ids = repeats.withColumnRenamed("doc_id", "__kept_id")
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")
    carried = rows.select(F.col("doc_id").cast("long"), F.col("text"), few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch, "text")]
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([long_ids(batch, "doc_id"), keys, batch.column(2)], ["doc_id", "key", "row"])

    kind = T.StructType().add("doc_id", "long").add("key", "binary").add("row", carried.schema["row"].dataType)
    keyed = carried.mapInArrow(run, kind)
    groups = marked.filter("n_shingles > 0 and (kept or component_id is null)")
    keepers = groups.groupBy("root").agg(F.min("doc_id").alias("id"), F.min("key").alias("chosen"))
    chosen = keyed.join(keepers, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("chosen")), "left_semi")
    ranked = chosen.dropDuplicates(["doc_id", "key"]).select("row.*")
    return ranked.union(keyed.filter("key is null").select("row.*"))
