"""Segment lifecycle: flattening, context, sharing, memory, glossary, retry, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

READING = ["doc_id", "ord"]


def word_run(n: int):
    """The n words from a position of the array column w, joined."""
    return lambda i: F.array_join(F.slice("w", i + 1, n), " ")


def context(seg: DataFrame, blocks: int = 1, cap: int = 400) -> DataFrame:
    """``blocks`` neighbours on each side of a segment in its document, newline-joined; the last ``cap`` characters before, the first after.
    One shuffle by document serves both sides."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(-blocks, -1)), "\n")
    after = F.array_join(F.collect_list("text").over(w.rowsBetween(1, blocks)), "\n")
    plain = seg.withColumn("before", before).withColumn("after", after)
    return plain.withColumn("context_before", F.when(F.length("before") > cap, F.expr(f"right(before, {cap})")).otherwise(F.col("before"))).withColumn("context_after", F.substring("after", 1, cap)).drop("before", "after")


def first_of_each(seg: DataFrame, key: Column) -> DataFrame:
    """The first occurrence of each share key over the corpus, by an aggregate with map-side combine (no sort of a hot key's rows).
    Segments without a key are asked for themselves."""
    keyed = seg.withColumn("key", key)
    return keyed.where("key is not null").groupBy("key").agg(F.min(F.struct(*READING)).alias("first"), F.count(F.lit(1)).alias("uses"))


def vote(tr: DataFrame) -> DataFrame:
    """For every share key with two wordings or more the wording that wins (keeps numbers, then most uses, then first seen).

    Two aggregates with partial sums; the winner is a max over a struct, so no window sorts a hot key.
    """
    seen = tr.withColumn("key", T.share_key(F.col("source"))).where("key is not null and target <> ''").withColumn("variant", T.collapse(F.col("target")))
    v = seen.groupBy("key", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*READING)).alias("first"), F.min((~T.drops_numbers(F.col("source"), F.col("target"))).cast("int")).alias("keeps")
    )
    rank = F.struct(F.col("keeps"), F.col("n"), (-F.col("first.doc_id")).alias("d"), (-F.col("first.ord")).alias("o"), F.col("variant"))
    return v.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("uses"), F.max(rank).alias("best")).where("variants >= 2").select("key", "variants", "uses", F.col("best.variant").alias("winner"), F.col("best.n").alias("winner_uses"))


def memory_key(src: Column, src_lang: Column, tgt_lang: Column, model: Column) -> Column:
    """Sha-256 over the parts with a zero between them."""
    return F.sha2(F.concat_ws("\u0000", src, src_lang, tgt_lang, model), 256)


def memory(tr: DataFrame) -> DataFrame:
    """K9: the memory that replies leave: the last one of each source (by document and position)."""
    rows = tr.where("target <> ''").groupBy("source", "lang").agg(F.max(F.struct("doc_id", "ord", "target")).alias("last"))
    return rows.select(memory_key(F.col("source"), F.col("lang"), F.lit("xx"), F.lit("m")).alias("key"), "source", F.col("last.target").alias("target"), F.col("lang").alias("src_lang"))


def lookup(requests: DataFrame, mem: DataFrame, max_len: Column | None = None) -> DataFrame:
    """Every request with its remembered reply, if any; a reply over the length cap is a miss."""
    asked = requests.withColumn("key", memory_key(F.col("source"), F.col("lang"), F.lit("xx"), F.lit("m")))
    found = asked.join(mem.select("key", F.col("target").alias("cached")), "key", "left")
    ok = F.col("cached").isNotNull() & ((F.length("cached") <= max_len) if max_len is not None else F.lit(True))
    return found.withColumn("hit", ok)


#: Glossaries up to this many terms are broadcast (about 64 MB of terms at most); larger ones are joined by shuffle, hot terms in SALTS parts.
BROADCAST_TERMS, SALTS = 500_000, 16


def phrases(seg: DataFrame, stop: list[str]) -> DataFrame:
    """READING, phrase: runs of one to three letter words that neither begin nor end with a stop word, of four characters at least. Words are
    exploded once; a run is only put together when both its ends count."""
    words = seg.select(*READING, F.split(F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ").alias("w"))
    at = words.select(*READING, F.posexplode("w").alias("i", "first"), "w").where(~F.lower("first").isin(*stop))
    second, third = F.get("w", F.col("i") + 1), F.get("w", F.col("i") + 2)
    runs = F.array_compact(F.array(
        F.col("first"), F.when(second.isNotNull() & ~F.lower(second).isin(*stop), F.concat_ws(" ", "first", second)),
        F.when(third.isNotNull() & ~F.lower(third).isin(*stop), F.concat_ws(" ", "first", second, third)),
    ))
    return at.select(*READING, F.explode(runs).alias("phrase")).where(F.length("phrase") >= 4)


def terms_in(seg: DataFrame, terms: DataFrame, longest: int = 1) -> DataFrame:
    """The glossary terms of each text as whole words, exact case. Texts are cut into runs of words up to the longest term, which meet
    the terms by equality: a small glossary (its size is checked) filters them before any shuffle, a large one is joined."""
    w = F.split(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), " ")
    words = seg.select(*READING, w.alias("w"))
    runs = words.select(*READING, F.explode(F.array_distinct(F.flatten(F.array(*[
        F.when(F.size("w") >= n, F.zip_with(*[F.slice("w", k + 1, F.size("w") - n + 1) for k in range(2)], lambda a, b: F.concat(a, F.lit(" "), b)) if n == 2 else F.col("w") if n == 1
               else F.transform(F.sequence(F.lit(0), F.size("w") - n), word_run(n))).otherwise(F.array().cast("array<string>"))
        for n in range(1, longest + 1)
    ])))).alias("term"))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return runs.join(F.broadcast(terms), "term")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return runs.withColumn("salt", F.pmod(F.xxhash64(*READING), F.lit(SALTS)).cast("int")).join(terms.select("*", salt), ["term", "salt"]).drop("salt")


def inflected_in(seg: DataFrame, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """READING, term: terms (one word, lower case, of the given lengths) that a word of the text begins with; of terms of four letters or more the last letter
    may differ where the word goes on for two more. Equality of word beginnings, so the glossary may be of any size."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    starts = [F.transform(F.filter("w", lambda w: F.length(w) >= n), lambda w: F.struct(F.lit("whole").alias("how"), F.substring(w, 1, n).alias("start"))) for n in lengths]  # noqa: B023
    starts += [F.transform(F.filter("w", lambda w: F.length(w) >= n + 2), lambda w: F.struct(F.lit(f"less{n}").alias("how"), F.substring(w, 1, n - 1).alias("start"))) for n in lengths if n >= 4]  # noqa: B023
    found = seg.select(*READING, words.alias("w")).select(*READING, F.explode(F.array_distinct(F.flatten(F.array(*starts)))).alias("s")).select(*READING, "s.*")
    n = F.length("term")
    forms = terms.select("term", F.explode(F.array_compact(F.array(F.struct(F.lit("whole").alias("how"), F.col("term").alias("start")), F.when(n >= 4, F.struct(F.concat(F.lit("less"), n.cast("string")).alias("how"), F.substring("term", F.lit(1), n - 1).alias("start")))))).alias("f")).select("term", "f.*")
    if forms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        forms = F.broadcast(forms)
    return found.join(forms, ["how", "start"]).select(*READING, "term").distinct()


def prepared(tr: DataFrame) -> DataFrame:
    """What the predicates on replies share, computed once a row: normalised texts and ordinary words of both sides."""
    return tr.select("*", *[f(F.col(c)).alias(f"{k}_{c}") for c in ("source", "target") for k, f in (("norm", T.normalised), ("words", T.ordinary_words))])


def judged(tr: DataFrame) -> DataFrame:
    """Flags of every reply from the prepared columns: missing, identical, copy, numbers, garbled, foreign (written in another language than
    ``lang``), and the number of ordinary words of the source."""
    s, t = F.col("source"), F.col("target")
    there = t != ""
    same = (F.col("norm_source") != "") & (F.col("norm_source") == F.col("norm_target"))
    shared = T.let(F.array_distinct("words_source"), lambda x: F.size(F.array_intersect(x, F.col("words_target"))) > 0.5 * F.size(x))
    return prepared(tr).select(
        *tr.columns, F.size("words_source").alias("n_words"), (~there).alias("missing"), (there & same).alias("identical"),
        (there & (F.size("words_source") >= 4) & (same | shared)).alias("copy"), (there & T.drops_numbers(s, t)).alias("numbers"),
        (there & (F.size(T.garbled_words(s, t)) > 0)).alias("garbled"), (there & T.wrong_language(t, F.col("lang"))).alias("foreign"),
    )


def suspicious(tr: DataFrame) -> DataFrame:
    """The reasons for which a reply is asked for again, in one pass."""
    s, t = F.col("source"), F.col("target")
    return judged(tr).withColumn("runaway", ~F.col("missing") & (F.length(t) > 2 * F.length(s)) & (F.length(s) >= 20))


def apply_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies onto blocks by id; a block without one keeps its text."""
    return blocks.join(replies.select(*READING, "target"), READING, "left").withColumn("written", F.when(F.coalesce("target", F.lit("")) != "", F.col("target")).otherwise(F.col("text")))
