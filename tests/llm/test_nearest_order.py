"""The search verifies rows in the order of their projected distance, and reports how many."""

import numpy as np
import pyarrow.parquet as pq

from creditloom.llm import nearest


def index_of(x):
    return nearest.BlockIndex(np.arange(len(x)), x, float(np.sqrt((x * x).sum(axis=1)).max()))


def test_recall_and_verified_share_on_the_larger_table():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array(table.column("embedding").to_pylist(), dtype=float)
    index, hits, seen, asked = index_of(x), 0, 0, range(0, len(x), 20)
    for q in asked:
        ids, scores, verified = index.search(q, x[q], 20)
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(ids) & set(np.lexsort((np.arange(len(x)), -exact))[:20]))
        assert len(ids) == 20 and (np.diff(scores) <= 0).all()
        seen += verified
    assert hits >= 0.9 * 20 * len(asked)
    assert seen <= 0.65 * len(x) * len(asked)


def test_rows_come_by_projected_distance(monkeypatch):
    """With the bound out of the way every row is verified, nearest projection first."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    index = index_of(x)
    index.stop = np.inf
    order = []
    rows = index.vectors

    class Watched:
        def __getitem__(self, at):
            order.extend(at.tolist())
            return rows[at]

    index.vectors = Watched()
    index.search(0, x[0], 5)
    point = (x[0] * (index.largest / np.sqrt((x[0] * x[0]).sum()))) @ index.plane[:-1]
    gap = ((index.tree.points - point) ** 2).sum(axis=1)
    assert sorted(order) == list(range(700)) and (np.diff(gap[order]) >= -1e-9).all()


def test_few_rows_and_a_query_alone():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    ids, scores, _ = index_of(x).search(2, x[2], 20)
    assert ids.tolist() == [0, 1] and scores.tolist() == [1.0, 1.0]
    ids, _, _ = index_of(x[:1]).search(0, x[0], 20)
    assert len(ids) == 0


class Counted(np.ndarray):
    """Vectors that count the rows multiplied one by one."""

    rows = 0

    def __mul__(self, other):
        Counted.rows += len(self)
        return np.asarray(self) * other


def test_only_rows_that_may_be_among_the_best_are_scored_one_by_one():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x[2500:] = x[:500]  # equal vectors: equal scores, smaller ids first
    index = index_of(x)
    index.stop = np.inf
    index.vectors = index.vectors.view(Counted)
    Counted.rows = 0
    for q in range(0, 3000, 100):
        ids, scores, seen = index.search(q, x[q], 20)
        exact = (x * x[q]).sum(axis=1)
        wanted = [i for i in np.lexsort((np.arange(3000), -exact)) if i != q][:20]
        assert seen == 3000 and ids.tolist() == wanted and scores.tolist() == exact[wanted].tolist()
    assert Counted.rows < 0.2 * 3000 * 30
