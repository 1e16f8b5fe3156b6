"""Tables and the views derived from them (segments, replies, boxes, ...), each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, by document, where the file gives fewer splits than there are cores (one large row group, say); otherwise
    unchanged, so large inputs are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ord, text: the non-blank lines of each document in reading order (ord: 0-based position in the text)."""
    lines = spread(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return lines.select("doc_id", "lang", "ord", F.trim("line").alias("text")).where("text <> ''")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"))


SEG = """seg AS (
  SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS ord, trim(s) AS text
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(s) <> ''
)"""


def replies(seg: DataFrame) -> DataFrame:
    """The deterministic provider. Sources get a number on every third line; replies are the marked source, with failures
    by position: missing, echoed, numbers removed, a changed wording, foreign script."""
    k = (F.col("doc_id") * 7 + F.col("ord")) % 20
    src = F.when(F.col("ord") % 3 == 0, F.concat("text", F.lit(" "), (F.col("ord") + 100).cast("string"))).otherwise(F.col("text"))
    t = seg.withColumn("source", src).withColumn("k", k.cast("int"))
    target = (
        F.when(F.col("k") == 0, "").when(F.col("k") == 1, F.col("source")).when(F.col("k") == 2, F.concat(F.lit("[xx] "), F.regexp_replace("source", "[0-9]+", "")))
        .when(F.col("k") == 3, F.concat(F.lit("[xx]  "), F.translate("source", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).when(F.col("k") == 4, F.concat(F.lit("[xx] "), F.col("source"), F.lit(" aбc")))
        .otherwise(F.concat(F.lit("[xx] "), F.col("source")))
    )
    return t.select("doc_id", "lang", "ord", "source", target.alias("target"))


TR = SEG + """, src AS (
  SELECT doc_id, lang, ord, CASE WHEN ord % 3 = 0 THEN text || ' ' || CAST(ord + 100 AS VARCHAR) ELSE text END AS source, CAST((doc_id * 7 + ord) % 20 AS INTEGER) AS k FROM seg
), tr AS (
  SELECT doc_id, lang, ord, source,
    CASE k WHEN 0 THEN '' WHEN 1 THEN source WHEN 2 THEN '[xx] ' || regexp_replace(source, '[0-9]+', '', 'g')
           WHEN 3 THEN '[xx]  ' || translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 4 THEN '[xx] ' || source || ' aбc' ELSE '[xx] ' || source END AS target
  FROM src
)"""


def boxes(seg: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Boxes of a two-column layout derived from the lines: 40 lines a page; other columns come along if named."""
    n = F.length("text")
    t = seg.select("doc_id", *(carry or []), F.floor(F.col("ord") / 40).cast("int").alias("pg"), "ord", "text", n.cast("int").alias("len"))
    t = t.withColumn("x0", 50 + 260.0 * (F.col("ord") % 2)).withColumn("y0", 60 + 14.0 * F.floor((F.col("ord") % 40) / 2))
    return t.withColumn("x1", F.col("x0") + F.least(F.lit(240.0), 5.0 * F.col("len"))).withColumn("y1", F.col("y0") + 12.0 * F.ceil(F.col("len") / 48)).select("doc_id", "pg", "ord", "text", "x0", "y0", "x1", "y1", *(carry or []))


LAY = SEG + """, lay AS (
  SELECT doc_id, CAST(floor(ord / 40) AS INTEGER) AS pg, ord, text, x0, y0, x0 + least(240.0::DOUBLE, 5.0 * length(text))::DOUBLE AS x1, (y0 + 12.0 * ceil(length(text) / 48))::DOUBLE AS y1
  FROM (SELECT *, (50 + 260.0 * (ord % 2))::DOUBLE AS x0, (60 + 14.0 * floor((ord % 40) / 2))::DOUBLE AS y0 FROM seg)
)"""


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn and the assistant turn right after it, as (source, target)."""
    u = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    a = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "turn"])


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
)"""
