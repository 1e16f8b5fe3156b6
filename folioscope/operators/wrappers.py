"""Providers and what is wrapped around them: transforms of a frame of requests to one of replies.

Requests: doc_id, ord, lang, source. A provider takes requests and returns them with ``target``, one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .segments import READING, first_of_each, memory_key

Provider = Callable[[DataFrame], DataFrame]


def contract(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests without a reply, replies to nothing and requests answered twice, counted; a provider keeps the contract where all are 0.

    Both sides are dealt out by READING here: a union of parts that were dealt out alike says so to Spark 4.1, which then counts without a shuffle,
    but where an exchange is used again the parts are not put together, and a key in two of them is not met (``spark.sql.unionOutputPartitioning``)."""
    requests, replies = (x.select(*READING).repartition(*READING) for x in (requests, replies))
    lost = requests.join(replies, READING, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    extra = replies.join(requests, READING, "left_anti").agg(F.count(F.lit(1)).alias("unasked"))
    twice = replies.groupBy(*READING).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    return lost.join(F.broadcast(extra)).join(F.broadcast(twice))  # three tables of one row


def dedupe(base: Provider) -> Provider:
    """One request for each share key, by its first occurrence; every occurrence gets its reply."""

    def ask(requests: DataFrame) -> DataFrame:
        keyed = requests.withColumn("key", F.coalesce(T.share_key(F.col("source")), F.concat_ws(":", F.lit("\u0000"), *READING)))
        first = first_of_each(requests.withColumn("text", F.col("source")), F.coalesce(T.share_key(F.col("source")), F.concat_ws(":", F.lit("\u0000"), *READING)))
        asked = keyed.join(first.select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.ord").alias("ord")), ["key", *READING], "left_semi")
        got = base(asked.drop("key")).select(*READING, "target").join(asked.select("key", *READING), READING).select("key", "target")
        return keyed.join(got, "key", "left").drop("key")

    return ask


def cached(base: Provider, memory: DataFrame) -> Provider:
    """Remembered replies first; the base answers the rest. memory: key, target."""

    def ask(requests: DataFrame) -> DataFrame:
        keyed = requests.withColumn("key", memory_key(F.col("source"), F.col("lang"), F.lit("xx"), F.lit("m")))
        hits = keyed.join(memory.select("key", "target"), "key").drop("key")
        return hits.unionByName(base(keyed.join(memory.select("key"), "key", "left_anti").drop("key")))

    return ask


def protected(base: Provider) -> Provider:
    """Lines without a letter answer themselves; literals travel as numbered tokens and come back; a reply that lost one is flagged (``lost``), and its
    confidence is at most a half."""

    def ask(requests: DataFrame) -> DataFrame:
        data = T.is_data_only(F.col("source"))
        found = requests.where(~data).withColumn("plain", F.col("source")).withColumn("found", T.literals(F.col("plain"))).withColumn("source", T.protect(F.col("plain")))
        got = base(found.select(*READING, "lang", "source")).select(*READING, "target")
        back = found.select(*READING, "lang", F.col("plain").alias("source"), "found").join(got.withColumnRenamed("target", "told"), READING, "left")
        back = back.withColumn("lost", T.lost_tokens(F.coalesce("told", F.lit("")), F.col("found")))
        told = back.select(*READING, "lang", "source", T.restore(F.col("told"), F.col("found")).alias("target"), "lost")
        own = requests.where(data).select(*READING, "lang", "source", F.col("source").alias("target"), F.lit(0).alias("lost"))
        return told.unionByName(own).withColumn("confidence", F.when(F.col("lost") > 0, 0.5).otherwise(1.0))

    return ask


def wrapped(base: Provider, memory: DataFrame) -> Provider:
    """Protect(Cache(Dedupe(base))): the memory and the provider see texts with tokens, so lines that differ in values alone share one request."""
    return protected(cached(dedupe(base), memory))


def automatic_glossary(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Of the terms a model answers those that were asked for, whatever their case; the spelling of the candidates stands. candidates: phrase;
    answers: term, value."""
    a = answers.select(F.lower(F.trim("term")).alias("k"), "value").groupBy("k").agg(F.min("value").alias("value"))
    return candidates.select("phrase", F.lower("phrase").alias("k")).join(a, "k").where("value <> ''").select("phrase", "value")
