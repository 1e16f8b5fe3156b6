"""Catalogue, part 6: the audit of written documents with all its kinds, repair, and what is told by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import segments as S
from ..sources.tables import SEG, TR, boxes, replies, segments
from .segment_queries import KEY
from .sql import judged_sql


def _written(tr):
    """Plain replies in capitals, so that only the failures look like their sources; a tag leaks into some."""
    shown = F.translate("source", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    target = F.when(F.col("target") == F.concat(F.lit("[xx] "), F.col("source")), F.concat(F.lit("[xx] "), shown)).otherwise(F.col("target"))
    return tr.withColumn("target", F.when((F.col("ord") % 17 == 5) & (target != ""), F.concat(target, F.lit(" <B>x</B>"))).otherwise(target))


WRITTEN = TR.replace(", tr AS (", ", tr0 AS (") + """, tr1 AS (SELECT doc_id, lang, ord, source, CASE WHEN target = '[xx] ' || source THEN '[xx] ' || translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE target END AS target FROM tr0),
tr AS (SELECT doc_id, lang, ord, source, CASE WHEN ord % 17 = 5 AND target <> '' THEN target || ' <B>x</B>' ELSE target END AS target FROM tr1)"""


def _blocks(spark, d):
    """Blocks with their boxes: columns of the same rows, no join. Written boxes are a point lower, every seventh 20."""
    seg = segments(spark, d)
    n = F.col("ord")
    tr = _written(replies(seg))
    b = boxes(tr.withColumn("text", F.col("source")), ["lang", "source", "target"])
    return b.withColumn("oy", F.col("y0") + F.when(n % 7 == 0, 20.0).otherwise(1.0)).withColumn("scanned", F.col("doc_id") % 10 == 9)


BLOCKS = """, blocks AS (SELECT doc_id, lang, floor(ord / 40)::INTEGER AS pg, ord, source, target, x0, y0, (x0 + least(240.0::DOUBLE, 5.0 * length(source)))::DOUBLE AS x1, (y0 + 12.0 * ceil(length(source) / 48))::DOUBLE AS y1,
  y0 + CASE WHEN ord % 7 = 0 THEN 20.0::DOUBLE ELSE 1.0 END AS oy, doc_id % 10 = 9 AS scanned, CASE WHEN target = '' THEN source ELSE target END AS written
  FROM (SELECT *, (50 + 260.0 * (ord % 2))::DOUBLE AS x0, (60 + 14.0 * floor((ord % 40) / 2))::DOUBLE AS y0 FROM tr))"""


def _figures(blocks):
    """Two figures on every third page of a document, and one that fills the page on every sixth."""
    at = F.col("doc_id") + F.col("pg")
    pages = blocks.select("doc_id", "pg").distinct().where(at % 3 == 0)
    box = lambda k, *v: F.struct(F.lit(k).alias("ord"), *[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    some = F.when(at % 6 == 0, F.array(box(0, 0, 0, 600, 320))).otherwise(F.array(box(0, 40, 90, 300, 160), box(1, 300, 200, 480, 260)))
    return pages.select("doc_id", "pg", F.explode(some).alias("b")).select("doc_id", "pg", "b.*")


FIGURES = """, figs AS (SELECT doc_id, pg, 40.0::DOUBLE AS fx0, 90.0::DOUBLE AS fy0, 300.0::DOUBLE AS fx1, 160.0::DOUBLE AS fy1 FROM (SELECT DISTINCT doc_id, pg FROM blocks) WHERE (doc_id + pg) % 6 = 3
  UNION ALL SELECT doc_id, pg, 300, 200, 480, 260 FROM (SELECT DISTINCT doc_id, pg FROM blocks) WHERE (doc_id + pg) % 6 = 3)"""

#: What a page shows of a block: its box cuts a long text.
SHOWN = 120


def _findings(spark, d):
    b = _blocks(spark, d)
    return A.findings(b, _figures(b), F.substring("written", 1, SHOWN))


_CHECKED = "regexp_matches(source, '\\p{L}') AND length(regexp_replace(source, '[^\\p{L}]', '', 'g')) / length(source) >= 0.3"
FOUND = f"""{judged_sql(WRITTEN)}{BLOCKS}{FIGURES},
jb AS (SELECT b.*, n_words, missing, identical, same, copy, numbers, garbled, "foreign" FROM blocks b JOIN judged j ON j.doc_id = b.doc_id AND j.ord = b.ord),
pw AS (SELECT doc_id, lang, pg, w, count(*) AS n FROM (SELECT doc_id, lang, pg, unnest(string_split_regex(written, ' +')) AS w FROM blocks WHERE NOT scanned) WHERE w <> '' GROUP BY ALL),
pd AS (SELECT doc_id, lang, pg, w, count(*) AS n FROM (SELECT doc_id, lang, pg, unnest(string_split_regex(substr(written, 1, {SHOWN}), ' +')) AS w FROM blocks WHERE NOT scanned) WHERE w <> '' GROUP BY ALL),
own AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(source, '{A.TAG}', 1))) AS tag FROM blocks),
leak AS (SELECT DISTINCT doc_id, lang, pg, ord, lower(tag) AS tag FROM (SELECT doc_id, lang, pg, ord, unnest(regexp_extract_all(target, '{A.TAG}', 1)) AS tag FROM blocks)),
ov AS (SELECT a.doc_id, a.lang, a.pg, a.ord, a.x0 AS xa, b.x0 AS xb, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.pg = b.pg AND a.ord < b.ord),
found AS (
  SELECT doc_id, lang, 'L1' AS kind, NULL::INTEGER AS pg, NULL::INTEGER AS ord FROM (SELECT doc_id, lang, pg, bool_or(target <> '') AS shown FROM blocks GROUP BY ALL) GROUP BY doc_id, lang HAVING count(*) <> count(*) FILTER (WHERE shown)
  UNION ALL SELECT doc_id, lang, 'L2', pg, ord FROM jb WHERE {_CHECKED} AND n_words >= 4 AND (missing OR copy OR identical OR "foreign")
  UNION ALL SELECT pw.doc_id, pw.lang, 'L3', pw.pg, NULL FROM pw LEFT JOIN pd USING (doc_id, lang, pg, w) GROUP BY pw.doc_id, pw.lang, pw.pg HAVING sum(least(pw.n, coalesce(pd.n, 0))) / sum(pw.n) < 0.9::DOUBLE
  UNION ALL SELECT doc_id, lang, 'L4', pg, ord FROM blocks WHERE x1 > 546 OR y1 > 341
  UNION ALL SELECT DISTINCT doc_id, lang, 'L5', pg, ord FROM leak WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = leak.doc_id AND own.tag = leak.tag)
  UNION ALL SELECT doc_id, lang, 'L6', pg, ord FROM jb WHERE numbers
  UNION ALL SELECT doc_id, lang, CASE WHEN xa = xb THEN 'D3' ELSE 'L7' END, pg, ord FROM ov WHERE shared > 0.3::DOUBLE * small
  UNION ALL SELECT doc_id, lang, 'L8', pg, ord FROM blocks a WHERE (target = source OR target = '') AND NOT EXISTS (SELECT 1 FROM blocks o WHERE o.doc_id = a.doc_id AND o.pg = a.pg AND o.written = a.source AND abs(a.y0 - o.oy) <= greatest(1, (a.y1 - a.y0) / 2) AND abs(a.x0 - o.x0) <= 6)
  UNION ALL SELECT doc_id, lang, 'L9', pg, ord FROM jb WHERE garbled
  UNION ALL SELECT DISTINCT a.doc_id, a.lang, 'L10', a.pg, a.ord FROM blocks a JOIN figs f ON f.doc_id = a.doc_id AND f.pg = a.pg
    WHERE greatest(0, least(x1, fx1) - greatest(x0, fx0)) * greatest(0, least(oy + y1 - y0, fy1) - greatest(oy, fy0)) > 0.55::DOUBLE * (x1 - x0) * (y1 - y0)
    AND NOT EXISTS (SELECT 1 FROM blocks o WHERE o.doc_id = a.doc_id AND o.pg = a.pg AND o.source = a.written AND abs(a.x0 - o.x0) <= 3 AND abs(a.oy - o.y0) <= 3)
  UNION ALL SELECT doc_id, lang, 'D1', pg, ord FROM blocks WHERE length(target) * 0.85::DOUBLE > floor((x1 - x0) / 5) * round((y1 - y0) / 12)
  UNION ALL SELECT doc_id, lang, 'D2', pg, ord FROM jb WHERE {_CHECKED} AND n_words < 4 AND len(string_split(source, ' ')) >= 2 AND same)"""


def losses_by_kind(spark, d):
    """2.11: all thirteen kinds of loss, counted by language."""
    return _findings(spark, d).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def lossless_flag(spark, d):
    """The losses of each document (kinds L1 to L10) and whether there are none."""
    n = _findings(spark, d).where("kind like 'L%'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))
    docs = segments(spark, d).select("doc_id").distinct().join(n, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("n", F.lit(0)).alias("losses"), F.coalesce("kinds", F.lit(0)).alias("kinds"), F.col("n").isNull().alias("lossless"))


def segment_audit(spark, d):
    """The segment audit: flatten, replies, repeated wordings and the flags of every reply, by language; one pass and one aggregate.

    A repeated wording is counted once, by the first language that has it: keys are counted by an aggregate of their own."""
    flags = ("missing", "copy", "numbers", "garbled", "foreign")
    j = S.judged(replies(segments(spark, d)))
    by = j.groupBy("lang").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("source")).cast("long").alias("chars"), *[F.sum(F.col(c).cast("long")).alias(c) for c in flags])
    keys = segments(spark, d).select("lang", T.share_key(F.col("text")).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.min("lang").alias("lang")).where("uses >= 2")
    return by.join(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("repeated")), "lang", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))


AUDIT_SQL = f"""WITH {judged_sql(TR)}, k AS (SELECT key, min(lang) AS lang FROM (SELECT lang, {KEY.format(t='text')} AS key FROM seg) WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 2),
r AS (SELECT lang, count(*) AS repeated FROM k GROUP BY lang), a AS (SELECT lang, count(*) AS segments, sum(length(source))::BIGINT AS chars, sum(missing::INT)::BIGINT AS missing, sum(copy::INT)::BIGINT AS copy, sum(numbers::INT)::BIGINT AS numbers,
  sum(garbled::INT)::BIGINT AS garbled, sum("foreign"::INT)::BIGINT AS "foreign" FROM judged GROUP BY lang) SELECT a.*, coalesce(r.repeated, 0) AS repeated FROM a LEFT JOIN r USING (lang)"""


def _ask(rows, k):
    """A provider that answers a third of what it is asked in each round, drops numbers in a third and echoes the rest."""
    plain = F.concat(F.lit("[xx] "), F.translate("source", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    turn = (F.col("doc_id") + F.col("ord") + k) % 3
    return rows.withColumn("target", F.when(turn == 0, plain).when(turn == 1, F.regexp_replace(plain, "[0-9]+", "")).otherwise(F.col("source")))


def verify_rounds(spark, d):
    """How many replies have a loss before the first round and after each of two, found by the checks themselves."""
    _, history = A.verify_and_repair(_written(replies(segments(spark, d))), _ask, 2)
    out = None
    for k, rows in enumerate(history):
        n = rows.agg(F.count(F.lit(1)).alias("failing"), F.sum(F.col("doc_id") * 1000 + F.col("ord")).alias("which")).select(F.lit(k).alias("round"), "failing", "which")
        out = n if out is None else out.union(n)
    return out


def repaired(spark, d):
    """The replies after two rounds."""
    return A.verify_and_repair(_written(replies(segments(spark, d))), _ask, 2)[0].select("doc_id", "ord", "target")


def _round_sql(k: int) -> str:
    """Round k: answers to what still fails, judged like the replies."""
    fails = 'n_words >= 4 AND (missing OR copy OR identical OR "foreign") OR numbers OR garbled'
    if k == 0:
        return judged_sql(WRITTEN) + f", f0 AS (SELECT doc_id, lang, ord, source FROM judged WHERE {fails})"
    plain = "'[xx] ' || translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    base = f"tr AS (SELECT doc_id, lang, ord, source, CASE (doc_id + ord + {k}) % 3 WHEN 0 THEN {plain} WHEN 1 THEN regexp_replace({plain}, '[0-9]+', '', 'g') ELSE source END AS target FROM f{k - 1})"
    return f"a{k} AS (WITH {judged_sql(base)} SELECT *, {fails} AS fails FROM judged), f{k} AS (SELECT doc_id, lang, ord, source FROM a{k} WHERE fails)"


ROUNDS = ", ".join(_round_sql(k) for k in range(3))

QUERIES = {
    "segment_audit": (segment_audit, AUDIT_SQL),
    "losses_by_kind": (losses_by_kind, f"WITH {FOUND} SELECT lang, kind, count(*) AS n FROM found GROUP BY ALL"),
    "lossless_flag": (lossless_flag, f"WITH {FOUND}, c AS (SELECT doc_id, count(*) AS n, count(DISTINCT kind) AS kinds FROM found WHERE kind LIKE 'L%' GROUP BY doc_id) SELECT s.doc_id, coalesce(n, 0) AS losses, coalesce(kinds, 0) AS kinds, n IS NULL AS lossless FROM (SELECT DISTINCT doc_id FROM seg) s LEFT JOIN c USING (doc_id)"),
    "page_counts": (lambda spark, d: A.page_counts(_blocks(spark, d)).select("doc_id"), f"WITH {FOUND} SELECT doc_id FROM found WHERE kind = 'L1'"),
    "dropped_text": (lambda spark, d: A.dropped_text(_blocks(spark, d), F.substring("written", 1, SHOWN)).select("doc_id", "pg"), f"WITH {FOUND} SELECT doc_id, pg FROM found WHERE kind = 'L3'"),
    "words_over_figures": (lambda spark, d: (lambda b: A.over_figures(b, _figures(b)).select("doc_id", "pg", "ord"))(_blocks(spark, d)), f"WITH {FOUND} SELECT doc_id, pg, ord FROM found WHERE kind = 'L10'"),
    "fit_failures": (lambda spark, d: A.block_losses(_blocks(spark, d)).where("kind = 'D1'").select("doc_id", "ord"), f"WITH {FOUND} SELECT doc_id, ord FROM found WHERE kind = 'D1'"),
    "verify_rounds": (verify_rounds, f"WITH {ROUNDS} " + " UNION ALL ".join(f"SELECT {k} AS round, count(*) AS failing, sum(doc_id * 1000 + ord)::BIGINT AS which FROM f{k}" for k in range(3))),
    "repaired": (repaired, f"WITH {ROUNDS}, m AS (SELECT doc_id, ord, target FROM a1 WHERE NOT fails UNION ALL SELECT doc_id, ord, target FROM a2 WHERE NOT fails) SELECT tr.doc_id, tr.ord, coalesce(m.target, tr.target) AS target FROM tr LEFT JOIN m ON m.doc_id = tr.doc_id AND m.ord = tr.ord"),
}
