"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and an L1 term leave few non-zero weights; only those (sorted bucket ids and
values, at most 2**bits) travel to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, Words, bounded_sample, chunks, claim, mix, ship


@dataclass
class ToxicityModel:
    bits: int
    weights: np.ndarray  # float32, zero but for a few buckets
    bias: float
    nonzero: int


def _grams(w: Words, bits: int):
    """Buckets of words (whole, and cut to stems of 4 and 5 bytes), word pairs and pairs that skip one word, with how far the last word is."""
    shift, h = np.uint64(64 - bits), w.h
    yield h >> shift, 0
    for n in (4, 5):
        yield w.stems(n) >> shift, 0
    for gap in (1, 2):
        if len(h) > gap:
            yield mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + h[gap:]) >> shift, gap


def _features(text: str, bits: int) -> np.ndarray:
    w = Words([text.encode("utf-8", "surrogatepass")], PUNCT)
    return np.unique(np.concatenate([g for g, _ in _grams(w, bits)])).astype(np.int32) if len(w.h) else np.empty(0, np.int32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[str, int]], bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.05, epochs: int = 4, seed: int = 3) -> ToxicityModel:
    """FTRL-proximal over (text, 0 or 1) rows; a feature counts once a text."""
    size = 1 << bits
    z, n, bz, bn = np.zeros(size), np.zeros(size), 0.0, 0.0
    rng = np.random.default_rng(seed)
    features = [_features(t, bits) for t, _ in rows]
    y = np.array([int(v) for _, v in rows])

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f = features[i]
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            b = -bz / ((beta + np.sqrt(bn)) / alpha)
            g = float(_sigmoid(w.sum() + b)) - y[i]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[f], n[f] = zi + g - step * w, ni + g * g
            bz, bn = bz + g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b, bn + g * g
    w = weights(z, n).astype(np.float32)
    return ToxicityModel(bits, w, float(-bz / ((beta + np.sqrt(bn)) / alpha)), int((w != 0).sum()))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_bytes: int = 48_000_000) -> ToxicityModel | None:
    """Fit on at most ``max_rows`` labelled documents and ``max_bytes`` of text, in the order of a hash of doc_id. None without any.
    Labels other than 0 and 1 are left out; of several labels of one document the largest counts."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = bounded_sample(docs.select("doc_id", "text"), ["text", "toxic"], max_rows, max_bytes, marks)
    return fit([(r.text, r.toxic) for r in rows]) if rows else None


def score(docs: DataFrame, model: ToxicityModel | None, limit: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= limit) for every row, from its whole text.

    Null and empty texts get the score of the bias alone; without a model every score is 0. Equal texts get equal scores.
    """
    ship(docs.sparkSession)
    at = np.flatnonzero(model.weights) if model else np.empty(0, np.int64)
    held = docs.sparkSession.sparkContext.broadcast((model.bits, at.astype(np.int32), model.weights[at], model.bias) if model else None)

    def run(batches):
        claim("toxicity")
        m, table = held.value, None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m is not None:
                bits, where, values, bias = m
                if table is None:
                    table = np.zeros(1 << bits, np.float32)
                    table[where] = values
                for start, part in chunks(batch.column(1).to_pylist()):
                    w = Words(part, PUNCT)
                    rows, codes = [], []
                    for g, gap in _grams(w, bits):
                        hit = np.flatnonzero(table[g.astype(np.int64)])
                        doc = np.searchsorted(w.first, hit, "right") - 1
                        same = w.first[doc + 1] > hit + gap
                        rows.append(doc[same])
                        codes.append(g[hit[same]].astype(np.int64))
                    key = np.unique((np.concatenate(rows) << bits) | np.concatenate(codes)) if rows else np.empty(0, np.int64)
                    total = np.bincount(key >> bits, table[key & ((1 << bits) - 1)], len(part))
                    out[start : start + len(part)] = _sigmoid(total + bias)
            yield pa.record_batch([batch.column(0), pa.array(out), pa.array((out >= limit).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
