"""op1, op3, op4: held-out accuracy on the test tables, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import lang_id, quality, toxicity
from folioscope.llm.common import held_out

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, rejected int"
EDGES = [(1, None, "en", "", 0), (2, "", "en", "", 0), (3, "123 456 !!", None, "", 0), (4, "the cat and the dog " * 20000, "en", "", 0), (4, "le chat et le chien", "fr", "", 0), (None, "the house of the man", "en", "", 0), (6, "the cat and the dog", None, "", 0), (7, "\x00 é", "fr", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_language_held_out(docs):
    model = lang_id.train(docs.where(~held_out("doc_id")), max_rows=600)
    got = lang_id.identify(docs, model).where(held_out("doc_id") & F.col("text").rlike(r"\p{L}"))
    right, n, rejected = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 200 and right > 0.97 and rejected < 0.03


def test_language_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    model = lang_id.train(docs)
    rows = lang_id.identify(docs, model).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in rows)
    assert {r.lang_pred for r in lang_id.identify(docs, None).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert lang_id.train(empty) is None and lang_id.identify(empty, None).collect() == []


def test_language_ignores_other_columns(docs):
    model = lang_id.train(docs.where(~held_out("doc_id")), max_rows=200)
    a = lang_id.identify(docs, model).select("doc_id", "lang_pred", "score").collect()
    b = lang_id.identify(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_toxicity_held_out(docs, labels):
    model = toxicity.train(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(held_out("doc_id")).collect()
    pos, neg = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.8 and sum(n >= 0.7 for n in neg) / len(neg) < 0.03
    assert 0 < model.nonzero < 0.2 * len(model.weights)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (2, 1), (9, 1), (1, None), (7, 5)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.score == 0 for r in toxicity.score(docs, None).collect())
    assert toxicity.train(docs, labels.limit(0)) is None


def test_quality_held_out(docs, labels):
    model = quality.train(docs.where(~held_out("doc_id")), labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(held_out("doc_id")).collect()
    right = sum((r.tail_probability >= 0.5) == (r.quality == 1) for r in got) / len(got)
    assert right > 0.9


def test_quality_orders_several_grades():
    words = [["bad", "poor"], ["fair", "usual"], ["good", "fine"]]
    rows = [(" ".join(words[g] * (1 + i % 5)), g * 2) for i in range(120) for g in range(3)]
    model = quality.fit(rows, bits=12, epochs=6)
    assert model.grades == [0, 2, 4] and all(a < b for a, b in zip(model.thresholds, model.thresholds[1:]))


def test_quality_edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    labels = spark.createDataFrame([(4, 2), (6, 0), (2, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)
    assert {r.expected_grade for r in quality.score(docs, None).collect()} == {None}
    assert quality.select(docs, model).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None


def test_language_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 5, 6, 7)], "doc_id long, text string, lang string, letters int, letters_ int, `a.b` int")
    out = lang_id.identify(docs, lang_id.train(docs))
    assert out.columns == [*docs.columns, "lang_pred", "score", "rejected"] and out.select("letters", "letters_", "`a.b`").collect() == [(5, 6, 7)]


def test_quality_scores_follow_the_weights(spark):
    """Scores from words one by one, and a fitted model tells its rows better than thresholds alone."""
    import math
    import random

    rng = random.Random(4)
    good, bad = [f"good{i}" for i in range(30)], [f"poor{i}" for i in range(30)]
    rows = [(" ".join(rng.choices(good if g else bad, k=rng.randint(1, 40))), g) for g in (0, 1) for _ in range(60)]
    m = quality.fit(rows, bits=12)
    sig = lambda x: 1 / (1 + math.exp(-x))

    def tail(text):
        h = [int(quality._words([w.encode()])[0].h[0]) for w in text.split()]
        e = [int(quality._words([w.encode()])[1][0]) for w in text.split()]
        pair = [int(quality._buckets(np.array([a, b], np.uint64), np.zeros(2, np.uint64), 12)[2][0]) for a, b in zip(np.array(h, np.uint64), np.array(h[1:], np.uint64))]
        z = sum(float(m.weights[x >> 52]) for x in [*h, *e]) + sum(float(m.weights[b]) for b in pair)
        return 1 - sig(m.thresholds[0] - z / max(1, len(h)))

    texts = [t for t, _ in rows] + ["", "unseen words here"]
    got = {r.doc_id: r.tail_probability for r in quality.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), m).collect()}
    assert all(abs(got[i] - tail(t)) < 1e-6 for i, t in enumerate(texts))
    loss = lambda p, g: -math.log(max(1e-9, p if g else 1 - p))
    assert sum(loss(got[i], g) for i, (_, g) in enumerate(rows)) < 0.5 * len(rows) * math.log(2)


def test_samples_are_bounded_before_they_are_collected(spark):
    from folioscope.llm.common import bounded_sample

    rows = [(1, "same", "en")] * 50 + [(1, f"other {i}", "en") for i in range(50)] + [(2, "x" * 900, "en"), (3, "drei", "de"), (None, "n", "en"), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = bounded_sample(docs, ["text", "lang"], 10, 500)
    assert len(got) <= 10 and sum(len(r.text) for r in got) <= 500 and len({(r.doc_id, r.text) for r in got}) == len(got)
    assert {r.lang for r in bounded_sample(docs, ["text", "lang"], 10, 500, by="lang")} == {"en", "de"}
