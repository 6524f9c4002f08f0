"""The classifier's convolution against plain loops, and its held-out quality."""

import numpy as np
import pytest

from creditloom.llm import quality
from creditloom.llm.queries import LLM_QUERIES


def plain_chunk_maxima(filters, padded):
    """Largest activation of each filter in each chunk of two hops, position by position."""
    n = len(padded) - quality.WIDTH + 1
    active = np.array([[sum(filters[k, padded[p + k], f] for k in range(quality.WIDTH)) for f in range(filters.shape[2])] for p in range(n)])
    hops = n // quality.HOP
    return np.array([active[h * quality.HOP : (h + 2) * quality.HOP].max(axis=0) for h in range(hops - 1)])


@pytest.mark.parametrize("size", [0, 1, 7, 128, 256, 257, 900])
def test_chunk_maxima_and_score_are_the_plain_convolution(size):
    rng = np.random.default_rng(size + 1)
    network = quality.Network(
        rng.normal(size=(quality.WIDTH, 256, 3)).astype(np.float32).astype(float), rng.normal(size=3), rng.normal(size=9), 0.2
    )
    text = bytes(rng.integers(0, 256, size).tolist())
    padded = quality._pad(text)
    want = plain_chunk_maxima(network.filters, padded)
    got = quality._chunk_maxima(quality._pair_tables(network.filters), padded, block=2 * quality.HOP)
    assert got == pytest.approx(want, abs=1e-4)
    chunks = np.maximum(want + network.bias, 0)
    logit = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)]) @ network.weights + network.offset
    assert quality.Scorer(network).score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-4)


def area(pairs):
    pos = np.array([s for s, y in pairs if y == 1])[:, None]
    neg = np.array([s for s, y in pairs if y == 0])[None]
    return float(((pos > neg) + 0.5 * (pos == neg)).mean())


def test_held_out_area(spark, sf001):
    scores = {r.doc_id: r.score for r in LLM_QUERIES["op3_quality_classifier"].build(spark, sf001).filter("held_out").collect()}
    labels = spark.read.parquet(f"{sf001}/labels.parquet").collect()
    pairs = [(scores[r.doc_id], r.quality) for r in labels if r.doc_id in scores]
    assert len(pairs) > 20 and area(pairs) >= 0.95
