"""A bitmap of ids that lets most rows of a large table pass without being moved.

Ids are hashed to positions, about SPARE for each id and at most MOST (32 MB of
bits), in rows of 4 kB, so the bitmap can be broadcast. A row whose bit is not
set has none of the ids; one whose bit is set may have one and goes through an
exact join. With very many ids the bitmap fills up and more rows move; nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARE, LEAST, MOST = 64, 1 << 18, 1 << 28
_ROW = 1 << 15


def _position(id_col: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(id_col.cast("long")), F.lit(bits))


def bits_for(count: int) -> int:
    return min(max(1 << (SPARE * count).bit_length(), LEAST), MOST)


def bitmap(ids: DataFrame, id_col: str, bits: int) -> DataFrame:
    """Rows ``__bucket``, ``__bits`` of the positions of all ids.

    Positions are gathered by row first, so that a row of 4 kB is made once and not by every task.
    """
    at = ids.select(_position(F.col(id_col), bits).alias("at")).distinct()
    spread = at.select(F.shiftright("at", 15).alias("__bucket"), F.col("at").bitwiseAND(F.lit(_ROW - 1)).alias("inside"))
    return spread.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("inside").alias("__bits"))


def split(rows: DataFrame, id_col: str, ids: DataFrame, ids_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the ids, and rows that have none; no row is moved. ``ids`` is a written table."""
    size = bits_for(ids.count())
    bits = bitmap(ids, ids_col, size)
    at = _position(F.col(id_col), size)
    inside = at.bitwiseAND(F.lit(_ROW - 1)).cast("int")
    marked = rows.withColumns({"__at": F.shiftright(at, 15), "__inside": inside})
    joined = marked.join(F.broadcast(bits), F.col("__at") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.call_function("substring", F.col("__bits"), F.shiftright("__inside", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, F.col("__inside") % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    found = joined.withColumn("__hit", hit)
    names = [F.col(f"`{c}`") for c in rows.columns]
    return found.filter("__hit").select(*names), found.filter("not __hit").select(*names)
