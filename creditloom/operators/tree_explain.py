"""Path-dependent Shapley contributions of boosted trees and forests.

Every leaf is a product of per-feature intervals. A feature outside the coalition
lets the share of training rows through that its splits let through. The weights
of all coalitions along a path grow feature by feature (EXTEND) and shrink again by
the one whose contribution is wanted (UNWIND), polynomial in the depth (Lundberg et
al. 2018, algorithm 2). Leaves travel as flat arrays (trees x leaves x depth
entries, whatever the number of rows), cut into leaves once per task; rows of
a batch that meet a leaf in the same pattern of kept and failed intervals share their weights.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from creditloom.session import scratch_path

# The probability of Spark's boosted model is sigmoid(2 * margin).
LOG_ODDS_SCALE = 2.0


# value, features, lower bounds, upper bounds, shares: plain data that any worker can read
Leaf = tuple[float, tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]

# Workers may not have this package installed; its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def leaves_of(spark: SparkSession, model: GBTClassificationModel | RandomForestClassificationModel) -> list[Leaf]:
    """Leaves of all trees, read from the model's stored node table.

    Values are log-odds for boosted trees and probabilities for a forest.
    """
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():  # trees x nodes, never data rows
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    if isinstance(model, RandomForestClassificationModel):
        weights = [1 / len(nodes)] * len(nodes)

        def value(node):
            return node["impurityStats"][1] / sum(node["impurityStats"])
    else:
        weights = [LOG_ODDS_SCALE * w for w in model.treeWeights]

        def value(node):
            return node["prediction"]

    out: list[Leaf] = []
    for tree, weight in enumerate(weights):
        _walk(nodes[tree], value, weight, out)
    return out


def _walk(tree: dict, value, weight: float, out: list[Leaf]) -> None:
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = tree[at]
        if node["leftChild"] < 0:
            f = tuple(path)
            low, high, share = (np.array([path[i][k] for i in f]) for k in range(3))
            out.append((weight * value(node), f, low, high, share))
            continue
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in (("rightChild", (max(low, cut), high)), ("leftChild", (low, min(high, cut)))):
            kept = tree[node[child]]["rawCount"] / node["rawCount"]
            todo.append((node[child], path | {f: (*bounds, share * kept)}))


def base_value(leaves: Sequence[Leaf]) -> float:
    """Expected log-odds over the training rows."""
    return float(sum(value * share.prod() for value, _, _, _, share in leaves))


def path_weights(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights along a path after EXTEND by every feature: patterns x (features + 1)."""
    weights = np.ones((len(inside), 1))
    for k in range(inside.shape[1]):
        size = k + 2
        grown = np.zeros((len(inside), size))
        i = np.arange(1, size)
        grown[:, 1:] = inside[:, k, None] * weights * (i / size)
        grown[:, :-1] += share[k] * weights * ((size - i) / size)
        weights = grown
    return weights


def unwound_sums(weights: np.ndarray, one: np.ndarray, share: float) -> np.ndarray:
    """Sum of the weights that are left after UNWIND by one feature, per pattern."""
    size = weights.shape[1]
    total = np.zeros(len(weights))
    carried = weights[:, -1].copy()
    for j in range(size - 1, 0, -1):
        kept = carried * size / j
        total += np.where(one, kept, weights[:, j - 1] * size / (max(share, 1e-300) * (size - j)))
        carried = weights[:, j - 1] - kept * share * (size - j) / size
    return total


def leaf_contributions(value: float, inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Contributions of one leaf for each pattern (row) of features inside (1) or outside (0) their interval."""
    weights = path_weights(inside, share)
    sums = [unwound_sums(weights, inside[:, i] == 1, share[i]) for i in range(len(share))]
    return value * (inside - share) * np.stack(sums, axis=1)


def patterns_met(pattern: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each different pattern, by rising pattern, and for every row its place among them.

    Patterns of few features are counted off without sorting the rows.
    """
    if 1 << bits > len(pattern):
        _, first, place = np.unique(pattern, return_index=True, return_inverse=True)
        return first, place
    first = np.full(1 << bits, -1)
    first[pattern] = np.arange(len(pattern))
    met = first >= 0
    return first[met], (np.cumsum(met) - 1)[pattern]


def contributions(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Rows x features matrix of contributions in the units of the leaves."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros_like(columns)
    for value, features, low, high, share in leaves:
        at = list(features)
        if at:
            values = columns[at]
            met = (values > low[:, None]) & (values <= high[:, None])
            pattern = np.zeros(len(x), dtype=np.int64)
            for i, inside in enumerate(met):
                pattern |= inside.astype(np.int64) << i
            first, place = patterns_met(pattern, len(at))
            phi[at] += leaf_contributions(value, met[:, first].T.astype(float), share).T[:, place]
    return phi.T


def _flat(leaves: Sequence[Leaf]) -> tuple[np.ndarray, ...]:
    """All leaves in five arrays: values, path lengths, and features, bounds and shares end to end."""
    lengths = np.array([len(leaf[1]) for leaf in leaves])
    columns = [np.concatenate([np.asarray(leaf[k], dtype=float) for leaf in leaves]) if leaves else np.empty(0) for k in range(1, 5)]
    return np.array([leaf[0] for leaf in leaves]), lengths, columns[0].astype(np.int32), *columns[1:]


def _cut(flat: tuple[np.ndarray, ...]) -> list[Leaf]:
    values, lengths, features, low, high, share = flat
    ends = np.cumsum(lengths)
    spans = [slice(e - n, e) for e, n in zip(ends, lengths, strict=True)]
    return [(float(v), tuple(features[s].tolist()), low[s], high[s], share[s]) for v, s in zip(values, spans, strict=True)]


def tree_contributions(
    df: DataFrame,
    model: GBTClassificationModel | RandomForestClassificationModel,
    features: Sequence[str],
    key: str = "SK_ID_CURR",
    vector: str | None = None,
) -> tuple[DataFrame, float]:
    """One contribution column per feature for every row, and the base value.

    ``df`` has a column for each feature or, with ``vector``, one vector of all of them.
    """
    spark = df.sparkSession
    leaves = leaves_of(spark, model)
    shared = spark.sparkContext.broadcast(_flat(leaves))
    names = list(features)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _cut(shared.value)
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if vector else batch[names].to_numpy(dtype=float)
            yield pd.DataFrame(contributions(x, own), columns=names).assign(**{key: batch[key].to_numpy()})[[key, *names]]

    schema = f"`{key}` bigint, " + ", ".join(f"`{c}` double" for c in names)
    read = df.select(key, vector_to_array(vector).alias("x")) if vector else df.select(key, *names)
    return read.mapInPandas(explain, schema), base_value(leaves)
