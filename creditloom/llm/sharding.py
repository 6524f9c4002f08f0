"""Sharding by jump consistent hashing.

The shard follows from the key and the number of shards alone, without a ring
table; with one more shard a key either stays or moves into the new shard.

Rows of a shard are numbered from 0 without gaps, ordered by key, checksum and
size. No shard goes through one task: rows are range-partitioned by shard and
that order, numbered inside each partition and shifted by the sizes of the
partitions before. The numbered rows (a few numbers each, no text) are written
to the shared folder, so a repeated task cannot number them differently.

Defined cases: a null key counts as -1; a null text has size 8 and the checksum
of no bytes; equal rows get slots of their own, in any order; a key that is not
an integer is hashed to one first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import materialize

# Multiplier of the 64-bit congruential generator, and size of a row's header.
MULTIPLIER = np.uint64(2862933555777941757)
HEADER = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key, vectorised over the keys that still jump."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * MULTIPLIER + np.uint64(1)
        ahead = ((shard[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        inside = ahead < shards
        live = live[inside]
        shard[live] = ahead[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    return jump(key)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.typeName()
    integer = kind in ("long", "integer", "short", "byte")
    key = F.col(id_col).cast("long") if integer else F.xxhash64(id_col)
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(key, F.lit(-1)).alias("key"),
        (F.length(raw) + HEADER).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.select("*", shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + 1).alias("grown"))
    order = ["shard", "id", "crc", "size", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "shards",
    )
    part = F.shiftright("place", 33)
    runs = numbered.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    # At most one row per partition and shard boundary, so both the window and the broadcast stay small.
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(
        F.col("part").alias("p"), F.col("shard").alias("s"), "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return numbered.join(F.broadcast(before), (part == F.col("p")) & (F.col("shard") == F.col("s"))).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("place") - F.col("start")).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )
