"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= j) = sigmoid(threshold_j - w.x) with one shared weight vector and ordered thresholds. x holds the shares of
hashed words, word pairs and word endings in the whole text. Trained with AdaGrad on a bounded sample of rated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_sample, chunks, claim, mix, ship


@dataclass
class QualityModel:
    grades: list[int]
    thresholds: np.ndarray  # increasing, one fewer than grades
    weights: np.ndarray  # float32, 2**bits


def _buckets(h: np.ndarray, tail: np.ndarray, bits: int):
    """Buckets of words, endings and word pairs; the last belongs to the first word of each pair (and crosses texts at their ends)."""
    shift = np.uint64(64 - bits)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    return (h >> shift).astype(np.int64), (tail >> shift).astype(np.int64), (pair >> shift).astype(np.int64)


def _words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words and a hash of the last two bytes of each."""
    w = Words(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    code = raw[w.end - 1].astype(np.uint64) | (raw[np.maximum(w.end - 2, 0)].astype(np.uint64) << np.uint64(8)) if len(w.end) else np.empty(0, np.uint64)
    return w, mix(code + np.uint64(1 << 40))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[str, int]], bits: int = 18, epochs: int = 4, rate: float = 2.0, l2: float = 1e-6, scale: float = 4.0, seed: int = 7) -> QualityModel:
    """Train on (text, grade) rows; grades are any integers, at least one."""
    rng = np.random.default_rng(seed)
    grades = sorted({int(g) for _, g in rows})
    y = np.array([grades.index(int(g)) for _, g in rows])
    k = len(grades)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    first, gaps = (np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(np.log(share / (1 - share))), 1e-3))) if k > 1 else (0.0, np.empty(0))
    w, gw = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    gt = np.full(max(1, k - 1), 1e-6)
    features = []
    for t, _ in rows:
        words, tail = _words([t.encode("utf-8", "surrogatepass")])
        b, c = np.unique(np.concatenate(_buckets(words.h, tail, bits)), return_counts=True)
        features.append((b.astype(np.int32), (scale * c / max(1, len(words.h))).astype(np.float32)))

    def thresholds():
        return np.concatenate([[first], first + np.cumsum(np.exp(gaps))]) if k > 1 else np.empty(0)

    for _ in range(epochs if k > 1 else 0):
        for i in rng.permutation(len(rows)):
            b, x = features[i]
            t, j = thresholds(), y[i]
            z = float(w[b] @ x)
            hi = _sigmoid(t[j] - z) if j < k - 1 else 1.0
            lo = _sigmoid(t[j - 1] - z) if j else 0.0
            p = max(hi - lo, 1e-9)
            dhi = hi * (1 - hi) / p if j < k - 1 else 0.0
            dlo = lo * (1 - lo) / p if j else 0.0
            g = (dhi - dlo) * x + l2 * w[b]  # of -log p by w
            gw[b] += g * g
            w[b] -= rate * 0.1 * g / np.sqrt(gw[b])
            # thresholds move through the first one and the logs of the gaps, so they stay ordered
            d = np.zeros(k - 1)
            if j < k - 1:
                d[j] -= dhi
            if j:
                d[j - 1] += dlo
            gt += d.sum() ** 2
            first -= 0.05 * d.sum() / np.sqrt(gt[0])
            if k > 2:
                gaps = gaps - 0.02 * np.exp(gaps) * np.cumsum(d[::-1])[::-1][1:]
    return QualityModel(grades, thresholds(), (w * scale).astype(np.float32))


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", max_rows: int = 8000, max_bytes: int = 32_000_000) -> QualityModel | None:
    """Fit on at most ``max_rows`` rated documents and ``max_bytes`` of text, in the order of a hash of doc_id. None without any.
    Of several ratings of one document the largest counts; null ratings are left out."""
    marks = ratings.where(F.col(grade).isNotNull()).groupBy("doc_id").agg(F.max(grade).alias("grade"))
    rows = bounded_sample(docs.select("doc_id", "text"), ["text", "grade"], max_rows, max_bytes, marks)
    return fit([(r.text, r.grade) for r in rows]) if rows else None


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, expected_grade, tail_probability (that of the highest grade) and n_words for every row, from its whole text.

    Null, empty and blank texts get the thresholds' own distribution at w.x = 0. Without a model both are null. Equal texts get
    equal results; rows that share a doc_id are scored each for itself.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("quality")
        m = held.value
        for batch in batches:
            z, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at, part in chunks(batch.column(1).to_pylist()) if m is not None else ():
                w, tail = _words(part)
                bits = int(np.log2(len(m.weights)))
                one, end, pair = (m.weights[b].astype(np.float64) for b in _buckets(w.h, tail, bits))
                last = w.first[1:] - 1
                pair = np.append(pair, 0.0)
                pair[last[last >= 0]] = 0.0
                run_ = np.concatenate([[0.0], np.cumsum(one + end + pair[: len(one)])])
                count = np.diff(w.first)
                z[at : at + len(part)] = (run_[w.first[1:]] - run_[w.first[:-1]]) / np.maximum(1, count)
                n[at : at + len(part)] = count
            if m is None:
                for at, part in chunks(batch.column(1).to_pylist()):
                    n[at : at + len(part)] = np.diff(Words(part).first)
                expected = tail_p = np.full(batch.num_rows, np.nan)
            else:
                above = np.stack([np.ones(len(z)), *[1 - _sigmoid(t - z) for t in m.thresholds]])
                expected = m.grades[0] + sum((m.grades[j] - m.grades[j - 1]) * above[j] for j in range(1, len(m.grades)))
                expected = np.broadcast_to(expected, z.shape).astype(float)
                tail_p = above[-1]
            yield pa.record_batch([batch.column(0), pa.array(expected, from_pandas=True), pa.array(tail_p, from_pandas=True), pa.array(n)], ["doc_id", "expected_grade", "tail_probability", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, n_words long")


def select(docs: DataFrame, model: QualityModel | None, least_tail: float = 0.5) -> DataFrame:
    """Rows whose tail probability reaches the limit, with all their columns (all rows without a model)."""
    if model is None:
        return docs
    kept = score(docs, model).where(F.col("tail_probability") >= least_tail).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
