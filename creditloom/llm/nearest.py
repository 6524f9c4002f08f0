"""Approximate nearest neighbours by stable projections and an incremental kd-tree search.

Largest inner product becomes smallest distance by one more coordinate: with M
the largest norm, a vector x is lengthened by sqrt(M^2 - |x|^2) to norm M, and a
query is scaled to norm M and lengthened by 0. PROJECTED Gaussian (2-stable)
projections of the lengthened vectors are held in a kd-tree, which yields rows
one after the other by their projected distance from the query: leaves are opened
by the distance of their box, and rows nearer than the next leaf are verified on
the original vectors. The squared projected distance of a row, in units of its
squared true distance, follows a chi-square law; so once the next row lies beyond
the CONFIDENCE quantile times the squared distance of the k-th best row, every
better row would have been seen with at least that probability, and the search stops.

Rows are dealt to blocks by a hash, queries too; every pair of a query block and
a row block is one task group with a tree of its own, so all rows are indexed and
no group outgrows a task. A query's best of all blocks are ranked by a window
whose limit Spark applies before the shuffle. There is no cap on candidates.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most take no part; neither do rows without an id.
Rows that repeat id and vector count once. A query never finds rows of its own
id; if an id has several vectors its query is the smallest of them.
"""

from __future__ import annotations

from functools import cache
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTED = 24
CONFIDENCE = 0.95
LEAF = 64
VERIFIED = 64  # rows before the first look at the bound; later a quarter of those seen
ROWS, QUERIES = 16384, 4096


def chi_square_below(x: float, degrees: int) -> float:
    """Probability that a chi-square variable with an even number of degrees is below x."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


@cache
def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_below(high, degrees) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < p else (low, middle)
    return high


class Tree:
    """kd-tree over projected rows; rows are stored leaf by leaf."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = points[rows]
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            half = len(rows) // 2
            order = own[:, axis].argpartition(half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.order = np.concatenate(leaves)
        self.points = points[self.order]
        self.rows = np.split(np.arange(len(points)), np.cumsum([len(x) for x in leaves])[:-1])
        self.low = np.stack([points[x].min(axis=0) for x in leaves])
        self.high = np.stack([points[x].max(axis=0) for x in leaves])

    def nearest_leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared projected distance of their box, and that distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        distance = (gap * gap).sum(axis=1)
        order = distance.argsort(kind="stable")
        return order, distance[order]


class BlockIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, confidence: float = CONFIDENCE):
        self.largest = largest
        self.plane = np.random.default_rng(20).normal(size=(vectors.shape[1] + 1, PROJECTED))
        rest = np.sqrt(np.maximum(largest**2 - (vectors * vectors).sum(axis=1), 0))
        self.tree = Tree(vectors @ self.plane[:-1] + rest[:, None] * self.plane[-1])
        self.squares = (self.tree.points * self.tree.points).sum(axis=1)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]
        self.stop = chi_square_quantile(confidence, PROJECTED)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and inner products of the best rows found, best first, and how many rows were verified.

        Rows are verified in the order of their projected distance: those of the
        opened leaves that lie nearer than the next leaf are known to be next.
        """
        norm = np.sqrt((query * query).sum())
        point = (query * (self.largest / norm)) @ self.plane[:-1]
        leaves, distance = self.tree.nearest_leaves(point)
        ids, scores = np.empty(0, np.int64), np.empty(0)
        worst, seen, opened, batch = np.inf, 0, 0, 2
        waiting, behind = np.empty(0, np.int64), np.empty(0)
        own, room = (point * point).sum(), 1e-9 * self.largest * norm  # more than products in another order can differ by
        while True:
            # Open leaves up to the bound, then verify what lies before the next unopened one.
            until = min(opened + batch, len(leaves), int(np.searchsorted(distance, self.stop * worst)))
            if until > opened:
                rows = np.concatenate([self.tree.rows[x] for x in leaves[opened:until]])
                gap = np.maximum(self.squares[rows] - 2 * (self.tree.points[rows] @ point) + own, 0)
                waiting, behind = np.concatenate([waiting, rows]), np.concatenate([behind, gap])
                if worst < np.inf:  # the bound only falls: what lies beyond it is never verified
                    inside = behind < self.stop * worst
                    waiting, behind = waiting[inside], behind[inside]
                order = behind.argsort()
                waiting, behind = waiting[order], behind[order]
                opened, batch = until, batch * 2
            near = distance[opened] if opened < len(leaves) else np.inf
            ready = int(np.searchsorted(behind, min(near, self.stop * worst), side="right" if near < self.stop * worst else "left"))
            done = 0
            while done < ready and behind[done] < self.stop * worst:
                part = waiting[done : min(done + max(VERIFIED, seen // 4), ready)]
                part = part[: max(1, int(np.searchsorted(behind[done : done + len(part)], self.stop * worst)))]
                seen, done = seen + len(part), done + len(part)
                found, block = self.ids[part], self.vectors[part]
                hit = found != query_id
                if len(ids) == k:  # one product for all; only rows that may be among the best get their score
                    hit &= block @ query >= scores.min() - room
                    if not hit.any():
                        continue
                # A row's own sum, not a matrix product: equal vectors get equal scores.
                ids = np.concatenate([ids, found[hit]])
                scores = np.concatenate([scores, (block[hit] * query).sum(axis=1)])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    worst = 2 * self.largest**2 - 2 * self.largest * scores.min() / norm
                    worst = max(worst, 1e-12 * self.largest**2)
            waiting, behind = waiting[done:], behind[done:]
            bound = self.stop * worst
            if (opened >= len(leaves) or distance[opened] >= bound) and (not len(behind) or behind[0] >= bound):
                break
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best], seen


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``vector`` (doubles) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the queries (ids divisible by ``every``)."""
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    names = "query_id long, ids array<long>, scores array<double>"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == lengths["size"]).dropDuplicates(["id", "vector"])
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    count, largest = rows.agg(F.count("*"), F.max(norm)).first()
    asked = queries.count()
    row_blocks, query_blocks = -(-count // ROWS), max(1, -(-asked // QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row_cells = rows.withColumn("i", F.pmod(F.xxhash64("id", "vector"), F.lit(row_blocks)).cast("int")).withColumn("j", spread(query_blocks))
    query_cells = queries.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("i", spread(row_blocks))

    def cell(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            index = BlockIndex(block["id"].to_numpy(np.int64), np.stack(block["vector"].to_list()), largest)
            for query_id, query in zip(asked["id"], asked["vector"], strict=True):
                ids, scores, _ = index.search(query_id, np.asarray(query), k)
                out.append((query_id, ids, scores))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    found = row_cells.groupBy("i", "j").cogroup(query_cells.groupBy("i", "j")).applyInPandas(cell, names)
    flat = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    flat = flat.select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
