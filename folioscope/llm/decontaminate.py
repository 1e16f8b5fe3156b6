"""Benchmark decontamination by spaced seeds, on built-in expressions only.

Fixed masks pick some positions of a run of words and ignore the rest, so a run with replaced words still gives an
equal hash. Hashes of the documents meet those of the benchmark in one equi join; each hit names a document, an
item and a shift between them, and the words of both are then compared position by position along that shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir
from .native import let, plain_words, positions

#: 1: the word counts, 0: it is ignored. All ways to have four of five words in a row: were there three at most in each five of an
#: item of m words, 3 * (m // 5) + min(m % 5, 3) would match, less than the share of 0.7 (and eight words) asks for any m from 8 on, and
#: a run's score would be 3 at most. So each pair that the default rule accepts has a seed; of items under eight words all must match.
MASKS = ("1111", "11101", "11011", "10111")
#: Sizes up to which a benchmark (words) and the documents with hits (ids) are broadcast; larger ones are joined by shuffle.
BROADCAST_WORDS, BROADCAST_IDS = 200_000, 1_000_000


def _seed(h: Column, k: int, at: list[int]):
    return lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + o) for o in at])


def _seeds(words: Column, masks: tuple[str, ...]) -> Column:
    """All seed hashes of a word array, one mask after the other; each mask gives as many as there are words."""

    def of(h: Column) -> Column:
        parts = []
        for k, mask in enumerate(masks):
            at = [i for i, c in enumerate(mask) if c == "1"]
            # positions beyond the end count as nothing, one seed a position; such seeds meet none of the benchmark
            parts.append(F.transform(positions(F.size(h)), _seed(h, k, at)))
        return F.concat(*parts)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def overlaps(docs: DataFrame, benchmark: DataFrame, least_score: int = 12, least_share: float = 0.7, least_words: int = 8) -> DataFrame:
    """doc_id, item_id, matched, overlap, score: one row for each document and item that overlap.

    Words are lower-cased runs of letters and digits of whole texts. Along a shift, ``overlap`` counts the aligned
    positions and ``matched`` the equal ones; ``score`` is the best run of aligned positions at +1 for an equal and -2 for a
    replaced word. A pair is kept when the score reaches ``least_score``, or when ``least_share`` of the item's words match and
    these are ``least_words`` at least (all of an item with fewer). Of several shifts the best one is returned. Each pair that the
    default rule accepts is found; with a lower share or score, only pairs with four equal words of five in a row, or the whole item.

    Null and empty texts overlap with nothing; items without words are ignored; a null doc_id or item_id is never returned.
    Rows that share a doc_id are compared each for itself and reported once. Either table may be empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = (
        benchmark.select("item_id", plain_words(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0").distinct()
        .withColumn("m", F.size("words"))
    )
    total, short = items.agg(F.coalesce(F.sum("m"), F.lit(0)), F.sort_array(F.collect_set(F.when(F.col("m") < len(MASKS[0]), F.col("m"))))).first()
    # items too short for a mask are seeds of their own length, whole
    masks = MASKS + tuple("1" * m for m in short)
    spans = F.array(*[F.lit(len(x)) for x in masks])
    index = (
        items.select("item_id", "m", F.posexplode(_seeds(F.col("words"), masks)).alias("p", "seed"))
        .select("item_id", "m", "seed", (F.col("p") % F.col("m")).alias("j"), F.get(spans, F.floor(F.col("p") / F.col("m")).cast("int")).alias("need"))
        .where((F.col("j") + F.col("need") <= F.col("m")) & ((F.col("need") >= len(MASKS[0])) | (F.col("need") == F.col("m")))).select("item_id", "seed", "j").distinct()
    )
    if total <= BROADCAST_WORDS:
        index = F.broadcast(index)
    seeds = docs.select("doc_id", _seeds(plain_words(F.col("text")), masks).alias("s"))
    seeds = seeds.select("doc_id", (F.size("s") / len(masks)).cast("int").alias("n"), F.posexplode("s").alias("p", "seed"))
    hits = (
        seeds.join(index, "seed").select("doc_id", "item_id", ((F.col("p") % F.col("n")) - F.col("j")).alias("shift")).distinct()
        .groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    )
    # few documents have hits: only their texts are shuffled
    hits = materialise(docs.sparkSession, hits, shared_dir(docs.sparkSession), "hits")
    ids = hits.select("doc_id").distinct()
    if hits.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = hits.join(docs.join(ids, "doc_id", "left_semi"), "doc_id").join(items.select("item_id", F.col("words").alias("item")), "item_id")
    found = found.select("doc_id", "item_id", "shifts", "item", plain_words(F.col("text")).alias("words"))

    def along(shift: Column) -> Column:
        start, end = F.greatest(F.lit(0), -shift), F.least(F.size("item"), F.size("words") - shift)
        same = F.transform(positions(end - start), lambda i: F.get(F.col("item"), i + start) == F.get(F.col("words"), i + start + shift))
        empty = F.struct(F.lit(0).alias("matched"), F.lit(0).alias("run"), F.lit(0).alias("score"))

        def step(a, eq):
            run = F.greatest(F.lit(0), a["run"] + F.when(eq, 1).otherwise(-2))
            return F.struct((a["matched"] + eq.cast("int")).alias("matched"), run.alias("run"), F.greatest(a["score"], run).alias("score"))

        return F.aggregate(same, empty, step, lambda a: F.struct(a["score"].alias("score"), a["matched"].alias("matched"), (end - start).alias("overlap"), shift.alias("shift")))

    best = found.select("doc_id", "item_id", F.size("item").alias("m"), F.explode(F.transform("shifts", along)).alias("b"))
    enough = (F.col("b.score") >= least_score) | ((F.col("b.matched") >= F.ceil(F.col("m") * least_share)) & (F.col("b.matched") >= F.least(F.col("m"), F.lit(least_words))))
    top = best.where(enough).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return top.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.overlap").cast("long").alias("overlap"), F.col("b.score").cast("long").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with all their columns; rows without doc_id or text stay."""
    spark = docs.sparkSession
    ids = materialise(spark, overlaps(docs, benchmark).select("doc_id").distinct(), shared_dir(spark), "contaminated")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def sql() -> str:
    """The default rule in DuckDB, without seeds: equal words of a document and an item by shift. In a run of positions an equal word counts 1 and
    another -2, so the best run that ends at the k-th equal word, at position p, is the rise of 3 k - 2 p over its least value so far, plus 1."""
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, {words.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM d), bw AS (SELECT item_id, len(w) AS m, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS w FROM b),
hit AS (SELECT doc_id, item_id, n, m, i - p AS shift, p FROM dw JOIN bw ON dw.w = bw.w),
many AS (SELECT doc_id, item_id, n, m, shift, count(*) AS matched FROM hit GROUP BY ALL HAVING count(*) >= least(m, 8)),
f AS (SELECT h.doc_id, h.item_id, h.n, h.m, h.shift, matched, h.p, 3 * row_number() OVER (PARTITION BY h.doc_id, h.item_id, h.shift ORDER BY h.p) - 2 * h.p AS f FROM hit h JOIN many USING (doc_id, item_id, shift)),
r AS (SELECT *, f - min(f) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) + 1 AS run FROM f),
s AS (SELECT doc_id, item_id, shift, m, max(run) AS score, matched, (least(m, n - shift) - greatest(0, -shift)) AS overlap FROM r GROUP BY doc_id, item_id, shift, m, n, matched),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, matched DESC, overlap DESC, shift DESC) AS k FROM s WHERE score >= 12 OR (matched >= ceil(m * 0.7::DOUBLE) AND matched >= least(m, 8)))
SELECT doc_id, item_id, matched::BIGINT AS matched, overlap::BIGINT AS overlap, score::BIGINT AS score FROM best WHERE k = 1
"""
