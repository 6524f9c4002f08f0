"""Quality classifier: a byte-level convolutional network in numpy.

A filter is a table of weights for every (offset, byte value); its activation
at a position is the sum over WIDTH bytes. Activations are max-pooled over
overlapping chunks of two HOPs that cover the whole document; a document's
features are the mean, the largest and the smallest of its chunk maxima, and a
logistic layer turns them into one probability.

Training happens on the driver over a bounded sample: at most ``max_rows``
labelled documents (those with the smallest id hash), at most ``max_chunks``
chunks of each, evenly spread over its whole length. Scoring reads every byte
of every document inside Arrow batches; it moves no row.

Defined cases: a null text is scored like an empty one; an empty or short text
is padded with zero bytes to one chunk; without a label of each kind
the score is the share of label 1 (0.5 without labels); a null or ambiguous
label (several values for one id) is not learned from. Repeated rows are scored
each for itself and learned from once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.rows import long_ids, texts

WIDTH, FILTERS, HOP = 8, 16, 128
FOLDS = 5


@dataclass(frozen=True)
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 3 * FILTERS
    offset: float


def _pad(text: bytes) -> np.ndarray:
    """Bytes of the text, zero-padded to whole hops and at least two of them, plus a rim for the last filter."""
    hops = max(2, -(-len(text) // HOP))
    out = np.zeros(hops * HOP + WIDTH - 1, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


def _pair_tables(filters: np.ndarray) -> np.ndarray:
    """Two neighbouring offsets looked up at once: WIDTH/2 x 65536 x FILTERS."""
    even, odd = filters[0::2], filters[1::2]
    return (even[:, :, None, :] + odd[:, None, :, :]).reshape(WIDTH // 2, 65536, -1).astype(np.float32)


def _chunk_maxima(tables: np.ndarray, padded: np.ndarray, block: int = 256 * HOP) -> np.ndarray:
    """Largest activation of each filter in each overlapping chunk (chunks x FILTERS)."""
    n = len(padded) - WIDTH + 1
    hops = []
    for start in range(0, n, block):
        part = padded[start : start + block + WIDTH - 1].astype(np.int32)
        pairs = (part[:-1] << 8) | part[1:]
        size = len(part) - WIDTH + 1
        total = tables[0].take(pairs[:size], axis=0)
        for k in range(1, WIDTH // 2):
            total += tables[k].take(pairs[2 * k : 2 * k + size], axis=0)
        hops.append(total.reshape(size // HOP, HOP, -1).max(axis=1))
    top = np.concatenate(hops)
    return np.maximum(top[:-1], top[1:])


def _features(chunks: np.ndarray, bias: np.ndarray) -> np.ndarray:
    active = np.maximum(chunks + bias, 0)
    return np.concatenate([active.mean(axis=0), active.max(axis=0), active.min(axis=0)])


class Scorer:
    """A network with its pair tables; made once per Python worker task."""

    def __init__(self, network: Network):
        self.network = network
        self.tables = _pair_tables(network.filters)

    def score(self, text: bytes) -> float:
        net = self.network
        logit = float(_features(_chunk_maxima(self.tables, _pad(text)), net.bias) @ net.weights) + net.offset
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _training_windows(text: bytes, max_chunks: int) -> np.ndarray:
    """Chunks x (2 * HOP + WIDTH - 1) bytes, evenly spread over the whole text."""
    padded = _pad(text)
    count = (len(padded) - WIDTH + 1) // HOP - 1
    at = np.unique(np.linspace(0, count - 1, min(count, max_chunks)).round().astype(int))
    return np.stack([padded[i * HOP : i * HOP + 2 * HOP + WIDTH - 1] for i in at])


def train(
    rows: list[tuple[bytes, int]], max_chunks: int = 8, epochs: int = 6, rate: float = 0.03, seed: int = 7
) -> Network:
    """Fit filters and logistic layer by Adam on the log loss; deterministic for the same rows."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], dtype=np.float64)
    share = float(labels.mean()) if len(labels) else 0.5
    # Both kinds weigh alike, however rare one is.
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS))
    # Neighbouring values of one kind start alike, so that a filter reacts to kinds of characters, not to single ones.
    kinds = [(97, 123), (65, 91), (48, 58), (128, 192), (192, 256), (33, 48), (58, 65)]
    for low, high in kinds:
        filters[:, low:high] = filters[:, low:high] * 0.3 + rng.normal(0, 0.3, (WIDTH, 1, FILTERS))
    bias, weights = np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS)
    if share in (0.0, 1.0) or not len(labels):
        offset = np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)
        return Network(filters, bias, weights * 0, float(offset))
    offset = 0.0
    windows = [_training_windows(text, max_chunks) for text, _ in rows]
    params = [filters, bias, weights, np.array([offset])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, batch = 0, 32
    size = 2 * HOP
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            picked = order[start : start + batch]
            data = np.concatenate([windows[i] for i in picked]).astype(np.int32)
            counts = np.array([len(windows[i]) for i in picked])
            edges = np.concatenate([[0], np.cumsum(counts)])
            total = np.zeros((len(data), size, FILTERS), dtype=np.float32)
            small = params[0].astype(np.float32)
            for k in range(WIDTH):
                total += small[k].take(data[:, k : k + size], axis=0)
            at = total.argmax(axis=1)
            peak = np.take_along_axis(total, at[:, None, :], axis=1)[:, 0] + params[1]
            active = np.maximum(peak, 0)
            grads = [np.zeros_like(p) for p in params]
            back = np.zeros_like(active)
            w = params[2]
            for j, i in enumerate(picked):
                part = active[edges[j] : edges[j + 1]]
                feats = np.concatenate([part.mean(axis=0), part.max(axis=0), part.min(axis=0)])
                p = 1 / (1 + np.exp(-np.clip(feats @ w + params[3][0], -30, 30)))
                err = weight[i] * (p - labels[i]) / len(picked)
                grads[2] += err * feats
                grads[3] += err
                own = back[edges[j] : edges[j + 1]]
                own += err * w[:FILTERS] / len(part)
                cols = np.arange(FILTERS)
                own[part.argmax(axis=0), cols] += err * w[FILTERS : 2 * FILTERS]
                own[part.argmin(axis=0), cols] += err * w[2 * FILTERS :]
            back *= active > 0
            grads[1] += back.sum(axis=0)
            lines = np.arange(len(data))[:, None]
            cols = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(WIDTH):
                np.add.at(grads[0][k], (data[lines, at + k], cols), back)
            step += 1
            pace = rate * (1 - 0.9 * step / (epochs * (len(order) // batch + 1)))
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(params[0], params[1], params[2], float(params[3][0]))


def remainder(id_col: str):
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chunks: int = 8) -> Network:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fold.

    The sample are the ids with the smallest hash among the labelled ones. Text
    and label are all that is read; ids only choose and order the rows.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select("doc_id", "low")
        .collect()
    )
    if not known:
        return train([])
    label = {r[0]: r[1] for r in known}
    picked = docs.filter(F.col("doc_id").isin(list(label))).select("doc_id", spread(F.col("text"), max_chunks))
    rows = dict(picked.groupBy("doc_id").agg(F.min("text")).collect())
    return train([(bytes(rows[i]), label[i]) for i in label if i in rows], max_chunks)


def spread(text, max_chunks: int):
    """A text's bytes, or for a long one ``max_chunks`` evenly spread chunks of it, so that a training row is bounded."""
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    size, piece = F.length(raw), 2 * HOP
    whole = max_chunks * piece
    gap = (size - piece) / F.lit(max_chunks - 1.0)
    parts = [F.substring(raw, (gap * k).cast("int") + 1, F.lit(piece)) for k in range(max_chunks)]
    return F.when(size <= whole, raw).otherwise(F.concat(*parts)).alias("text")


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id``, ``score`` for every document; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            scores = [scorer.score(t or b"") for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([long_ids(batch, "doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, network: Network, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or b"") >= threshold for t in texts(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
