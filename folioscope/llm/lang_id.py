"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample; the embedding table and the linear layer
are multiplied out into one score table of (buckets x languages), whose size is fixed by the parameters, so
scoring a whole text is a gather and a mean. Confidence is calibrated with a temperature on held-back rows, and
a text whose calibrated confidence falls under the calibrated limit is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, bounded_sample, chunks, claim, give_back, quoted, ship

SIZES = (2, 3, 4)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    limit: float
    held_back_accuracy: float


def _prepared(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one kind of white space, a space around each text; where each text begins."""
    b = LOWER[np.frombuffer(b" " + b" ".join(texts) + b"     ", np.uint8)].copy()
    b[SPACE[b]] = 32
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return b, starts


def _subwords(b: np.ndarray, bits: int):
    """For each size the buckets of all byte n-grams, and whether an n-gram lies in one word and its boundaries."""
    n = len(b) - 4
    x = b.astype(np.uint32)
    gap = b == 32
    code = x[:n] | (x[1 : n + 1] << np.uint32(8))
    inside = ~(gap[:n] & gap[1 : n + 1])
    shift = np.uint32(32 - bits)
    for k in SIZES:
        if k >= 3:
            code = code | (x[k - 1 : n + k - 1] << np.uint32(8 * (k - 1)))
            inside = (inside if k > 3 else np.ones(n, bool)) & ~gap[k - 2 : n + k - 2]
        yield ((code ^ np.uint32(k * 0x01000193)) * np.uint32(2654435761)) >> shift, inside


def fit(rows: list[tuple[str, str]], bits: int = 17, dim: int = 16, epochs: int = 6, positions: int = 384, seed: int = 5, kept: float = 0.995) -> LanguageModel:
    """Train on (text, language) rows. Each epoch draws ``positions`` subwords from all over every whole text."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[1] for r in rows})
    y = np.array([languages.index(r[1]) for r in rows])
    features = []
    for t, _ in rows:
        b, _s = _prepared([t.encode("utf-8", "surrogatepass")])
        features.append(np.concatenate([h[ok] for h, ok in _subwords(b, bits)]).astype(np.int32))
    k = len(languages)
    table, linear, bias = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    order = rng.permutation(len(rows))
    back = order[: max(1, len(rows) // 5)]
    train = order[len(back) :] if len(order) > len(back) else back
    rate = 2.0
    for epoch in range(epochs):
        for at in range(0, len(train), 32):
            batch = train[at : at + 32]
            idx = np.stack([features[i][rng.integers(0, max(1, len(features[i])), positions)] if len(features[i]) else np.zeros(positions, np.int32) for i in batch])
            mean = table[idx].mean(1)
            z = mean @ linear + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            down = (p @ linear.T) / positions
            step = rate * (1 - epoch / epochs)
            linear -= step * (mean.T @ p)
            bias -= step * p.sum(0)
            np.add.at(table, idx.ravel(), np.repeat(-step * 32 * down, positions, axis=0).astype(np.float32))
    scores = (table @ linear).astype(np.float32)
    z = np.stack([scores[features[i]].mean(0) + bias if len(features[i]) else bias for i in back])
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.05, 20, 60):
        s = z / temperature
        s = s - s.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(back)), y[back]]))
        best = min(best, (loss, float(temperature)))
    s = z / best[1]
    p = np.exp(s - s.max(1, keepdims=True))
    top = (p / p.sum(1, keepdims=True)).max(1)
    right = z.argmax(1) == y[back]
    # at least ``kept`` of rightly named rows stay, and never more is asked than an even chance
    limit = min(0.5, float(np.quantile(top[right], 1 - kept))) if right.any() else 0.5
    return LanguageModel(languages, scores, bias, best[1], limit, float(right.mean()))


def train(docs: DataFrame, max_rows: int = 2500, max_bytes: int = 24_000_000) -> LanguageModel | None:
    """Fit on at most ``max_rows`` labelled rows and ``max_bytes`` of text, taken in the order of a hash of doc_id. None without any."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = bounded_sample(usable, ["text", "lang"], max_rows, max_bytes, by="lang")
    model = fit([(r.text, r.lang) for r in rows]) if rows else None
    del rows
    give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Adds lang_pred (a language, or ``und``), score (calibrated, 0 to 1) and rejected to every row; the text is read whole.

    Null text or no letter: ``und``, score 0, rejected. No model (nothing to learn from): the same. Other columns pass
    through untouched; columns of the same three names are replaced. Equal texts get equal results.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    # plain names inside, so that no column's own name can clash
    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    at_text = rest.index("text")

    def score(batches):
        claim("lang_id")
        m = held.value
        for batch in batches:
            letters = batch.column(len(rest)).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            who, conf = np.full(n, -1), np.zeros(n)
            if m is not None:
                bits, k = int(np.log2(len(m.scores))), len(m.languages)
                for at, part in chunks(batch.column(at_text).to_pylist(), 1 << 17):
                    b, starts = _prepared(part)
                    total, count = np.zeros((len(part), k)), np.zeros(len(part))
                    for h, inside in _subwords(b, bits):
                        where = np.flatnonzero(inside)
                        cut = np.searchsorted(where, np.append(starts, len(b)))
                        got = m.scores[h[where]]
                        run = np.concatenate([np.zeros((1, k)), np.cumsum(got, 0, dtype=np.float64)])
                        total += run[cut[1:]] - run[cut[:-1]]
                        count += np.diff(cut)
                    z = (total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    who[at : at + len(part)], conf[at : at + len(part)] = p.argmax(1), p.max(1)
            known = letters & (who >= 0)
            names = np.array([*(m.languages if m else []), "und"], object)[np.where(known, who, -1)]
            conf = np.where(known, conf, 0.0)
            limit = m.limit if m else 1.0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(names, pa.string()), pa.array(conf), pa.array(~known | (conf < limit))], [*rest, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in rest]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return source.mapInArrow(score, schema)
