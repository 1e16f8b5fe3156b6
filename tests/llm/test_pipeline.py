"""The pipeline against its stages' brute-force readings."""

import re

import corpus_pipeline
from folioscope.llm import lang_id, secrets
from folioscope.llm.decontaminate import overlaps

from .test_jaccard_join import brute


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_passages", "secret_spans", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang_id.train(docs)
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in lang_id.identify(docs, model).collect() if not r.rejected}
    near = corpus_pipeline.near_copies(spark, kept, sf)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in kept.collect()], 5, 80)})
    clean = corpus_pipeline.benchmark_passages(spark, near, sf)
    bad = {r.doc_id for r in overlaps(near, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    left = {r.doc_id: r for r in clean.collect()}
    assert set(left) == {r.doc_id for r in near.collect()} - bad
    masked = {r.doc_id: r for r in corpus_pipeline.secret_spans(spark, clean, sf).collect()}
    assert set(masked) == set(left)
    for d, r in masked.items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == left[d].text) or "[SECRET]" in r.text
        assert not re.search("AKIA[A-Z0-9]{12}", r.text)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(masked)
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_edges(spark, tmp_path):
    """Null and empty texts are rejected with their unknown language; copies leave one row; rows that share an id stay together."""
    text = "the house of the man and the dog that was not in the garden with all the other animals of the farm " * 3
    other = "it is the end of the story and there was nothing more to be said by the people from the town " * 3
    leak = other + " ".join(f"item{i}" for i in range(30))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, text, "en", "a", 1), (4, text, "en", "b", 1), (4, text, "en", "b", 1), (5, text, None, None, None), (5, other, "en", "c", 3), (6, leak, "en", "c", 3), (7, "12 34", None, "z", 5)]
    sf = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
    assert {r.doc_id for r in docs.collect()} == {None, 4, 5} and docs.where("doc_id = 4").count() == 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {None, 4, 5}


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).collect() == []


def test_workers_get_small_batches_and_give_memory_back(spark):
    import pyarrow as pa

    from folioscope.llm import common

    common.ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": [b.nbytes]})

    texts = spark.range(0, 24, 1, 1).selectExpr("id", "repeat('a b c d ', 125000) AS text")
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 8_000_000  # 24 MB in all
    common.claim("one", (held := [1]).clear)
    common._powers(10)
    common.claim("one")
    assert held and common._POW
    common.claim("two")
    assert not held and not common._POW


def test_driver_collects_filters_without_a_row_object_each(spark):
    import tracemalloc

    from folioscope.llm.common import bits_of

    numbers = spark.range(0, 300_000).selectExpr("xxhash64(id) AS h")
    tracemalloc.start()
    held = bits_of(numbers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int((held.value != 0).sum()) > 100_000 and peak < 16_000_000
