"""Document fingerprints as threshold-scaled sketches, on built-in expressions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range and nothing else, so its size follows the document,
the sketches of parts merge by union, and the containment of a short text in a very long one can be estimated without bias.
A very short text may keep no hash: it is then told by a hash of its whole text, which stands beside the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let, positions

WORDS = 5
#: One hash in SCALE is kept.
SCALE = 4


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes under the threshold, of the shingles of ``words`` words (lower case, split at white space).

    A text with fewer words is one shingle; null, empty or blank: an empty sketch. A text of n shingles keeps n / scale of them
    on average, maybe none where n is small.
    """
    return let(_words(text), lambda h: _kept(h, words, scale))


def whole(text: Column) -> Column:
    """One hash of all words of a text in their order; 0 for a text without words."""
    return let(_words(text), _whole)


def _kept(h: Column, words: int, scale: int) -> Column:
    limit = (1 << 64) // scale - (1 << 63)
    runs = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(
        F.transform(positions(F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    )
    return F.array_sort(F.array_distinct(F.filter(runs, lambda x: x < limit)))


def _whole(h: Column) -> Column:
    return F.when(F.size(h) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(h))


def merge(sketches: Column) -> Column:
    """The sketch of several texts together, from an array of sketches."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a's sketch is empty, as it says nothing."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """1 for texts of the same words. Else the larger containment of either sketch in the other, 0 to 1: high also when one is a small
    part of the other; where a sketch is empty nothing is known to be shared: 0."""
    least = F.least(F.size(a), F.size(b))
    return F.when(whole_a == whole_b, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def written(s: Column, whole_text: Column) -> Column:
    """A fingerprint as text: the hash of the whole text, then those of the sketch in order, hexadecimal and joined with dots."""
    return F.concat_ws(".", F.hex(whole_text), F.transform(s, lambda x: F.hex(x)))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the row after it by descending doc_id (then text); after the last one, the first.

    No window runs over the whole table: ids are cut into ranges at quantiles that are ids themselves, and the row at
    each cut is copied to the range before it, whose last row it follows. Null ids come last.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.select(F.approx_percentile(F.col("doc_id").cast("long"), [k / buckets for k in range(1, buckets)] or [0.5], F.lit(10000)).alias("c"), F.max(F.col("doc_id").cast("long")).alias("top")).first()
    # one range for each cut and the rows above it in the descending order; the number of cuts is bounded by ``buckets``, and a row finds
    # its range by halving
    top, marks = cuts.top, sorted(set(cuts.c or []), reverse=True)
    held = F.array(*[F.lit(m).cast("long") for m in marks]) if marks else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(marks).bit_length()))]) if marks else F.array().cast("array<int>")
    above = F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.get(held, n + k - 1) >= F.col("doc_id"), n + k).otherwise(n))
    rows = rows.withColumn("bucket_", F.when(F.col("doc_id").isNull(), len(marks)).otherwise(above)).withColumn("edge_", F.when(F.get(held, F.col("bucket_") - 1) == F.col("doc_id"), F.col("bucket_")))
    last = len(marks)
    own = F.struct(F.col("bucket_").alias("b"), F.lit(0).alias("ghost"))
    places = F.array_compact(F.array(
        own, F.when(F.col("edge_").isNotNull(), F.struct((F.col("edge_") - 1).cast("int").alias("b"), F.lit(1).alias("ghost"))),
        F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("long")), F.struct(F.lit(last).alias("b"), F.lit(2).alias("ghost"))),
    ))
    placed = rows.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.b", "at.ghost")
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where("ghost = 0").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and that of its edited text: the last half (floor) of its code points replaced by the first as
    many, or all, of the next document by descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text: empty. Rows
    that share a doc_id follow each other in the order of their texts. An only row is its own next. Equal texts have equal
    fingerprints. Empty table: no rows.
    """
    t = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    t = t.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))")))
    both = [let(_words(F.col(c)), lambda h: F.struct(_kept(h, WORDS, SCALE).alias("s"), _whole(h).alias("w"))) for c in ("text", "edited", "next_text")]
    t = t.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.array(*both).alias("x"))
    out = let(F.col("x"), lambda x: F.struct(
        written(x[0]["s"], x[0]["w"]).alias("fingerprint"), written(x[1]["s"], x[1]["w"]).alias("edited_fingerprint"),
        likeness(x[0]["s"], x[1]["s"], x[0]["w"], x[1]["w"]).alias("near_edited"), likeness(x[0]["s"], x[2]["s"], x[0]["w"], x[2]["w"]).alias("near_next"),
    ))
    # one array of one row, exploded: a generator keeps the optimiser from pasting the sketches into each use
    return t.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(out)).alias("o")).select("doc_id", "n_chars", "edited_sha256", "o.*")
