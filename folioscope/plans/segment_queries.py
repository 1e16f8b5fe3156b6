"""Catalogue, part 2: joins, segment lifecycle, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments as S
from ..sources.tables import SEG, TR, replies, segments, table
from .sql import JUDGED, lost_sql

COLLAPSE = "trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'))"
KEY = "CASE WHEN len(string_split(lower(" + COLLAPSE + "), ' ')) >= 3 THEN lower(" + COLLAPSE + ") END"


def _seg(spark, d):
    return segments(spark, d)


def _tr(spark, d):
    return replies(segments(spark, d))


def progress_chars(spark, d):
    """Characters done and total on the source side, and the measured expansion."""
    done = F.col("target") != ""
    g = _tr(spark, d).groupBy("lang").agg(
        F.sum(F.when(done, F.length("source"))).cast("long").alias("done"), F.sum(F.length("source")).cast("long").alias("total"),
        F.sum(F.when(done, F.length("target"))).cast("long").alias("written"), F.count_if(~done).alias("missing"),
    )
    return g.select("lang", "done", "total", "missing", F.round(F.col("written") / F.col("done"), 6).alias("expansion"))


def page_semi(spark, d):
    """Segments on the selected pages (40 lines a page), by number."""
    pages = spark.createDataFrame([(1,), (3,)], "pg int")
    return _seg(spark, d).withColumn("pg", F.floor(F.col("ord") / 40).cast("int")).join(F.broadcast(pages), "pg", "left_semi").select("doc_id", "ord", "pg")


def skip_limit(spark, d):
    """Skip 100 segments, then take 50, in reading order."""
    return _seg(spark, d).select("doc_id", "ord").orderBy("doc_id", "ord").offset(100).limit(50)


def apply_left(spark, d):
    """Replies of even documents applied to all blocks."""
    r = _tr(spark, d).where("doc_id % 2 = 0")
    return S.apply_replies(_seg(spark, d), r).select("doc_id", "ord", "written")


def apply_orphans(spark, d):
    """Replies whose block is not there (blocks at odd positions removed)."""
    return _tr(spark, d).join(_seg(spark, d).where("ord % 2 = 0"), S.READING, "left_anti").select("doc_id", "ord")


def dedupe_first(spark, d):
    """J2/N8."""
    return S.first_of_each(_seg(spark, d), T.share_key(F.col("text"))).select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.ord").alias("ord"), "uses")


def dedupe_apply(spark, d):
    """Every occurrence gets the reply of the first occurrence of its key; others keep their own."""
    t = _tr(spark, d).withColumn("key", T.share_key(F.col("source")))
    first = t.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "ord", "target")).alias("f"))
    return t.join(first, "key", "left").select("doc_id", "ord", F.coalesce("f.target", "target").alias("target"))


def memory_lookup(spark, d):
    """Requests of odd documents against the memory of even ones: hits, misses and replies over the length cap."""
    tr = _tr(spark, d)
    found = S.lookup(tr.where("doc_id % 2 = 1"), S.memory(tr.where("doc_id % 2 = 0")), F.length("source") + 5)
    return found.groupBy("lang").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit") & F.col("cached").isNotNull()).alias("over"), F.count_if(F.col("cached").isNull()).alias("misses"))


MEMORY_SQL = f"""WITH {TR}, m AS (SELECT source, lang, arg_max(target, (doc_id, ord)) AS cached FROM tr WHERE target <> '' AND doc_id % 2 = 0 GROUP BY source, lang)
SELECT lang, count(*) FILTER (WHERE cached IS NOT NULL AND length(cached) <= length(source) + 5) AS hits, count(*) FILTER (WHERE length(cached) > length(source) + 5) AS over, count(*) FILTER (WHERE cached IS NULL) AS misses
FROM (SELECT tr.lang, tr.source, m.cached FROM tr LEFT JOIN m ON m.source = tr.source AND m.lang = tr.lang WHERE doc_id % 2 = 1) GROUP BY lang"""


def memory_upsert(spark, d):
    """K9: the memory itself, the last reply of each source."""
    return S.memory(_tr(spark, d)).select("source", "src_lang", "target", "key")


def term_candidates(spark, d):
    """Runs of one to three words counted over the corpus, ranked by count * (1 + 0.35 * spaces); the best 40."""
    stop = sorted({x for ws in T.FUNCTION_WORDS.values() for x in ws})
    g = S.phrases(_seg(spark, d), stop).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    g = g.withColumn("score", F.round(F.col("n") * (1 + 0.35 * (F.size(F.split("phrase", " ")) - 1)), 4))
    return g.orderBy(F.desc("score"), F.desc(F.length("phrase")), F.desc("phrase")).limit(40)


def _terms_sql() -> str:
    stop = ", ".join(f"'{x}'" for x in sorted({x for ws in T.FUNCTION_WORDS.values() for x in ws}))
    parts = " UNION ALL ".join(f"SELECT array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})" for n in (1, 2, 3))
    return f"""WITH {SEG}, w AS (SELECT string_split(trim(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g')), ' ') AS w FROM seg), p AS ({parts}),
g AS (SELECT phrase, count(*) AS n FROM p WHERE lower(split_part(phrase, ' ', 1)) NOT IN ({stop}) AND lower(split_part(phrase, ' ', -1)) NOT IN ({stop}) AND length(phrase) >= 4 GROUP BY phrase HAVING count(*) >= 3)
SELECT phrase, n, round(n * (1 + 0.35::DOUBLE * (len(string_split(phrase, ' ')) - 1)), 4) AS score FROM g ORDER BY score DESC, length(phrase) DESC, phrase DESC LIMIT 40"""


def glossary_terms(spark, d):
    """Glossary terms (the names of market segments and word pairs of the corpus) found in the texts."""
    terms = spark.createDataFrame([(t,) for t in ("the", "of the", "and", "der", "que", "les", "in the", "los")], "term string")
    return S.terms_in(_seg(spark, d), terms, 2).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))


GLOSSARY_SQL = f"""WITH {SEG}, w AS (SELECT doc_id, ord, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS w FROM seg), t(term) AS (VALUES ('the'), ('of the'), ('and'), ('der'), ('que'), ('les'), ('in the'), ('los'))
SELECT term, count(*) AS texts FROM w JOIN t ON contains(w, ' ' || term || ' ') GROUP BY term"""


def glossary_merge(spark, d):
    """User terms win over automatic ones whose folded key is the same."""
    auto = table(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("k"), F.lit("auto").alias("origin")).distinct()
    user = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("k"), F.lit("user").alias("origin")).distinct()
    return auto.join(user, "k", "left_anti").unionByName(user)


def repeat_groups(spark, d):
    return S.first_of_each(_seg(spark, d), T.share_key(F.col("text"))).where("uses >= 2").select("key", "uses")


def repeat_vote(spark, d):
    """G7."""
    return S.vote(_tr(spark, d))


VOTE_SQL = f"""WITH {TR}, t AS (SELECT *, {KEY.format(t='source')} AS key, {COLLAPSE.format(t='target')} AS variant FROM tr WHERE target <> ''), {lost_sql('t')},
v AS (SELECT key, variant, count(*) AS n, min((t.doc_id, t.ord)) AS f, min((lost.doc_id IS NULL)::INT) AS keeps FROM t LEFT JOIN lost ON lost.doc_id = t.doc_id AND lost.ord = t.ord WHERE key IS NOT NULL GROUP BY key, variant),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY keeps DESC, n DESC, f, variant DESC) AS k, count(*) OVER (PARTITION BY key) AS variants, sum(n) OVER (PARTITION BY key) AS uses FROM v)
SELECT key, variants, uses::BIGINT AS uses, variant AS winner, n AS winner_uses FROM r WHERE k = 1 AND variants >= 2"""


FLAGS = ["missing", "identical", "copy", "numbers", "garbled", "runaway"]


def retry_selection(spark, d):
    """How many replies each reason rejects, and how many are accepted."""
    s = S.suspicious(_tr(spark, d))
    bad = F.greatest(*[F.col(f).cast("int") for f in FLAGS])
    return s.groupBy("lang").agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS], F.sum((1 - bad).cast("long")).alias("accepted"))


RETRY_SQL = f"""WITH {JUDGED}, f AS (SELECT *, NOT missing AND length(target) > 2 * length(source) AND length(source) >= 20 AS runaway FROM judged)
SELECT lang, {", ".join(f"sum({f}::BIGINT)::BIGINT AS {f}" for f in FLAGS)}, sum((NOT ({" OR ".join(FLAGS)}))::BIGINT)::BIGINT AS accepted FROM f GROUP BY lang"""


def untranslated(spark, d):
    """N15."""
    t = _tr(spark, d).where(~T.is_data_only(F.col("source")))
    return t.select("doc_id", "ord", F.when(F.col("target") == "", "missing").when((F.size(F.split("source", " ")) >= 4) & T.identical(F.col("source"), F.col("target")), "passthrough").alias("flag")).where("flag is not null")


UNTRANSLATED_SQL = f"""WITH {TR} SELECT * FROM (SELECT doc_id, ord, CASE WHEN target = '' THEN 'missing' WHEN len(string_split(source, ' ')) >= 4 AND lower({COLLAPSE.format(t="source")}) = lower({COLLAPSE.format(t="target")}) THEN 'passthrough' END AS flag
FROM tr WHERE regexp_matches(source, '\\p{{L}}')) WHERE flag IS NOT NULL"""


def context_windows(spark, d):
    """W1."""
    return S.context(_seg(spark, d), 2, 120).select("doc_id", "ord", "context_before", "context_after")


CONTEXT_SQL = f"""WITH {SEG}, c AS (SELECT doc_id, ord, lag(text, 2) OVER w AS b2, lag(text) OVER w AS b1, lead(text) OVER w AS a1, lead(text, 2) OVER w AS a2 FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
j AS (SELECT doc_id, ord, concat_ws(chr(10), b2, b1) AS b, concat_ws(chr(10), a1, a2) AS a FROM c)
SELECT doc_id, ord, CASE WHEN length(b) > 120 THEN substr(b, length(b) - 119) ELSE b END AS context_before, substr(a, 1, 120) AS context_after FROM j"""


def _with_headings(spark, d):
    """Lines with a heading of a source list and one of an appendix in every stretch of 40."""
    n = F.col("ord") % 40
    return _seg(spark, d).withColumn("text", F.when(n == 9, F.concat(F.lit("7. "), F.get(F.array(*[F.lit(h) for h in T.HEADINGS]), (F.col("doc_id") % len(T.HEADINGS)).cast("int")), F.lit(":"))).when(n == 23, F.lit("Appendix")).otherwise(F.col("text")))


def section_state(spark, d):
    """Lines inside a list of sources: its heading opens it, the next heading (short, a capital first, no end of a sentence) closes it; the state runs over
    the pages of a document."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    title = (F.length(t) <= 25) & t.rlike(r"^\p{Lu}") & ~t.rlike("[.!?,;]$")
    mark = F.when(T.is_bibliography_heading(t), 1).when(title, 0)
    return _with_headings(spark, d).withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0))).select("doc_id", "ord", "inside")


_HEADS = ", ".join(f"'{h}'" for h in T.HEADINGS)
SECTION_SQL = f"""WITH {SEG}, h AS (SELECT doc_id, ord, CASE ord % 40 WHEN 9 THEN '7. ' || [{_HEADS}][doc_id % {len(T.HEADINGS)} + 1] || ':' WHEN 23 THEN 'Appendix' ELSE text END AS text FROM seg),
m AS (SELECT doc_id, ord, CASE WHEN trim(regexp_replace(regexp_replace(lower(text), '^[0-9ivx.]+[ )]+', ''), '[:.]+$', '')) IN ({_HEADS}) THEN 1 WHEN length(text) <= 25 AND regexp_matches(text, '^\\p{{Lu}}') AND NOT regexp_matches(text, '[.!?,;]$') THEN 0 END AS mark FROM h)
SELECT doc_id, ord, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS inside FROM m"""


def hyphen_join(spark, d):
    """Lines that end in a letter and a hyphen take the first word of the next line, if that starts in lower case."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    s = _seg(spark, d).withColumn("text", F.when(F.col("ord") % 4 == 0, F.concat(F.rtrim(F.regexp_replace("text", "[.,]$", "")), F.lit("-"))).otherwise(F.lower("text")))
    s = s.withColumn("next", F.lead("text").over(w)).withColumn("prev", F.lag("text").over(w))
    takes = F.col("text").rlike(r"\p{L}-$") & F.col("next").rlike(r"^\p{Ll}")
    gave = F.col("prev").rlike(r"\p{L}-$") & F.col("text").rlike(r"^\p{Ll}")
    first = F.split_part("next", F.lit(" "), F.lit(1))
    body = F.when(F.coalesce(gave, F.lit(False)), F.trim(F.regexp_replace("text", r"^[^ ]+", ""))).otherwise(F.col("text"))
    return s.select("doc_id", "ord", F.when(F.coalesce(takes, F.lit(False)), F.concat(F.expr("left(text, length(text) - 1)"), first)).otherwise(body).alias("joined"))


HYPHEN_SQL = f"""WITH {SEG}, t AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 0 THEN rtrim(regexp_replace(text, '[.,]$', '')) || '-' ELSE lower(text) END AS text FROM seg),
n AS (SELECT *, lead(text) OVER w AS nx, lag(text) OVER w AS pv FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, CASE WHEN coalesce(regexp_matches(text, '\\p{{L}}-$') AND regexp_matches(nx, '^\\p{{Ll}}'), false) THEN left(text, length(text) - 1) || split_part(nx, ' ', 1)
  WHEN coalesce(regexp_matches(pv, '\\p{{L}}-$') AND regexp_matches(text, '^\\p{{Ll}}'), false) THEN trim(regexp_replace(text, '^[^ ]+', '')) ELSE text END AS joined FROM n"""


def header_repeat(spark, d):
    """First and last lines of a document's pages that repeat on two pages or more once digits are folded, with the pages they stand on; a document of one page
    has a header when its only short margin line is the first. Every page gets a numbered running line at either end on half the documents."""
    s = _seg(spark, d).withColumn("pg", F.floor(F.col("ord") / 40).cast("int"))
    edge = s.groupBy("doc_id", "pg").agg(F.min(F.struct("ord", "text")).alias("a"), F.max(F.struct("ord", "text")).alias("b"))
    number = F.concat(F.lit("Page "), (F.col("pg") + 1).cast("string"))
    head = F.when(F.col("doc_id") % 2 == 0, number).otherwise(F.col("a.text"))
    foot = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("- "), (F.col("pg") + 7).cast("string"), F.lit(" -"))).otherwise(F.col("b.text"))
    margins = edge.select("doc_id", "pg", F.explode(F.array(F.struct(F.lit("header").alias("margin"), head.alias("t")), F.struct(F.lit("footer").alias("margin"), foot.alias("t")))).alias("m"))
    folded = margins.select("doc_id", "pg", "m.margin", F.regexp_replace("m.t", "[0-9]+", "#").alias("key"))
    g = folded.groupBy("doc_id", "margin", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("doc_id", "margin", "key", "n")
    short = F.length("key") <= 20
    alone = folded.groupBy("doc_id").agg(F.max("pg").alias("last"), F.count_if(short).alias("c"), F.max(F.when(short, F.struct("margin", "key"))).alias("m")).where("last = 0 and c = 1 and m.margin = 'header'")
    return g.union(alone.select("doc_id", "m.margin", "m.key", F.lit(1).cast("long")))


HEADER_SQL = f"""WITH {SEG}, e AS (SELECT doc_id, floor(ord / 40)::INT AS pg, arg_min(text, ord) AS a, arg_max(text, ord) AS b FROM seg GROUP BY ALL),
m AS (SELECT doc_id, pg, 'header' AS margin, CASE WHEN doc_id % 2 = 0 THEN 'Page ' || (pg + 1) ELSE a END AS t FROM e UNION ALL SELECT doc_id, pg, 'footer', CASE WHEN doc_id % 4 = 0 THEN '- ' || (pg + 7) || ' -' ELSE b END FROM e),
f AS (SELECT doc_id, pg, margin, regexp_replace(t, '[0-9]+', '#', 'g') AS key FROM m), one AS (SELECT doc_id, count(*) FILTER (WHERE length(key) <= 20) AS c, max(pg) AS last FROM f GROUP BY doc_id)
SELECT doc_id, margin, key, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT f.doc_id, margin, key, 1 FROM f JOIN one USING (doc_id) WHERE last = 0 AND c = 1 AND margin = 'header' AND length(key) <= 20"""


def weighted_median(spark, d):
    """The median line length of each language, weighted by words."""
    s = _seg(spark, d).select("lang", F.length("text").cast("int").alias("n"), F.size(F.split("text", " ")).cast("int").alias("w"))
    return s.groupBy("lang").agg(F.percentile("n", 0.5, F.col("w")).alias("median"))


def typical_ratio(spark, d):
    """Median of target over source length where three pairs or more differ and the source has 20 characters."""
    t = _tr(spark, d).where((F.col("target") != "") & (F.col("target") != F.col("source")) & (F.length("source") >= 20))
    g = t.groupBy("lang").agg(F.percentile(F.length("target") / F.length("source"), 0.5).alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return g.select("lang", F.round("r", 6).alias("ratio"), "n")


def dominant_style(spark, d):
    """The style (case of the first letter and length class) that covers most characters of a document; the first seen wins a tie."""
    style = F.concat(F.when(F.substring("text", 1, 1) == F.upper(F.substring("text", 1, 1)), "U").otherwise("l"), F.least(F.lit(3), F.floor(F.length("text") / 60)).cast("string"))
    g = _seg(spark, d).withColumn("style", style).groupBy("doc_id", "style").agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("first"))
    return g.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "style")).alias("b")).select("doc_id", F.col("b.style").alias("style"), F.col("b.n").cast("long").alias("chars"))


def page_metrics(spark, d):
    """Blocks, characters, median and the element at int(0.9 n) of the sorted sizes, by page of 40 lines."""
    s = _seg(spark, d).select("doc_id", F.floor(F.col("ord") / 40).cast("int").alias("pg"), F.length("text").cast("int").alias("n"))
    g = s.groupBy("doc_id", "pg").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").cast("long").alias("chars"), F.percentile("n", 0.5).alias("median"), F.array_sort(F.collect_list("n")).alias("all"))
    return g.select("doc_id", "pg", "blocks", "chars", "median", F.element_at("all", (F.floor(F.size("all") * 0.9) + 1).cast("int")).alias("p90"))


def phase_share(spark, d):
    """Each event type's share of the summed value."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return g.select("event_type", F.round("v", 3).alias("seconds"), F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1))), 3).alias("percent"))


def fit_layers(spark, d):
    """A zero-filled histogram of fit layers by box budget."""
    budget = F.when(F.length("source") < 40, 60).otherwise(F.length("source"))
    over = F.length("target") / budget
    layer = F.when(F.col("target") == "", "as-is").when(over <= 1, "as-is").when(over <= 1 / 0.85, "shrink").when(over <= 1.3, "shorter").otherwise("overflow")
    names = spark.createDataFrame([(x,) for x in ("as-is", "shrink", "shorter", "longer", "overflow")], "layer string")
    return F.broadcast(names).join(_tr(spark, d).groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("c")), "layer", "left").select("layer", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def bench_grouping_sets(spark, d):
    """Losses by source and language with subtotals for each language and a grand total."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    t = _tr(spark, d).drop("source").join(docs, "doc_id").select("source", "lang", (F.col("target") == "").cast("int").alias("lost"))
    g = t.groupingSets([["source", "lang"], ["lang"], []], "source", "lang").agg(F.sum("lost").cast("long").alias("lost"), F.count(F.lit(1)).alias("blocks"), F.grouping_id().cast("int").alias("level"))
    return g.select("source", "lang", "level", "lost", "blocks", F.round(1 - F.col("lost") / F.col("blocks"), 6).alias("layout"))


def rollup_orders(spark, d):
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


def cube_lineitem(spark, d):
    li = table(spark, d, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def even_sample(spark, d):
    """20 evenly spaced segments of each language among those with 30 characters.

    Ranks come from counts of id ranges: a range's rows are ranked in its own task, and the ranges before it add their counts, so no
    task sorts a whole language."""
    s = _seg(spark, d).where(F.length("text") >= 30).select("lang", "doc_id", "ord").withColumn("part", F.floor(F.col("doc_id") / 64))
    per = s.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lang").orderBy("part")
    base = per.select("lang", "part", (F.sum("c").over(w) - F.col("c")).alias("base"), F.sum("c").over(Window.partitionBy("lang")).alias("n"))
    i = F.col("base") + F.row_number().over(Window.partitionBy("lang", "part").orderBy("doc_id", "ord")) - 1
    t = s.join(base, ["lang", "part"]).withColumn("i", i)
    # i is one of floor(k * n / 20) for k in 0..19
    return t.where((F.col("n") <= 20) | (F.floor(F.ceil(F.col("i") * 20 / F.col("n")) * F.col("n") / 20) == F.col("i")) & (F.ceil(F.col("i") * 20 / F.col("n")) < 20)).select("lang", "doc_id", "ord")


def score_summary(spark, d):
    """Mean rating and share of good ones by source, safe where nothing is rated."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("mean"), F.round(F.avg((F.col("quality") >= 1).cast("int")), 6).alias("good"), F.count("quality").alias("rated"))


def run_delta(spark, d):
    """Counts of a fixed list of kinds in two runs (even and odd documents) and the signed change where the first has the kind."""
    kinds = spark.createDataFrame([(k,) for k in ("missing", "passthrough", "other")], "kind string")
    u = untranslated(spark, d)
    a = u.where("doc_id % 2 = 0").groupBy(F.col("flag").alias("kind")).agg(F.count(F.lit(1)).alias("a"))
    b = u.where("doc_id % 2 = 1").groupBy(F.col("flag").alias("kind")).agg(F.count(F.lit(1)).alias("b"))
    return kinds.join(a, "kind", "left").join(b, "kind", "left").select("kind", F.coalesce("b", F.lit(0)).alias("now"), (F.coalesce("b", F.lit(0)) - F.col("a")).alias("delta"))


def part_openings(spark, d):
    """The first three blocks of 40 characters of every document, cut at 600."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return _seg(spark, d).where(F.length("text") >= 40).withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc_id", "k", F.substring("text", 1, 600).alias("text"))


def matrix_ratio(spark, d):
    """Characters and words before and after by document; 0/0 is 1, x/0 is 0."""
    words = lambda c: F.size(F.filter(F.split(c, " +"), lambda w: w != ""))
    chars = lambda c: F.length(F.regexp_replace(c, "[ \n]", ""))
    g = _tr(spark, d).groupBy("doc_id").agg(*[F.sum(f(F.col(c))).cast("long").alias(f"{n}_{c}") for n, f in (("words", words), ("chars", chars)) for c in ("source", "target")])
    r = lambda n: F.when(F.col(f"{n}_source") == 0, F.when(F.col(f"{n}_target") == 0, 1.0).otherwise(0.0)).otherwise(F.round(F.col(f"{n}_target") / F.col(f"{n}_source"), 6))
    return g.select("doc_id", "words_source", "words_target", r("words").alias("words_ratio"), r("chars").alias("chars_ratio"))


def word_share(spark, d):
    """Multiset overlap of a document's words in the source with those written."""
    t = _tr(spark, d)
    count = lambda c: t.select("doc_id", F.explode(F.filter(F.split(c, " +"), lambda w: w != "")).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias(c))
    j = count("source").join(count("target"), ["doc_id", "w"], "left")
    return j.groupBy("doc_id").agg(F.round(F.sum(F.least("source", F.coalesce("target", F.lit(0)))) / F.sum("source"), 6).alias("share"))


def reading_diff(spark, d):
    """Documents whose line lists differ after white space is collapsed and case folded (stale readings), and both set differences."""
    a = _tr(spark, d).select("doc_id", T.collapse(F.col("source")).alias("t"))
    b = _tr(spark, d).where("target <> ''").select("doc_id", T.collapse(F.regexp_replace("target", r"^\[xx\]", "")).alias("t"))
    left = a.exceptAll(b).groupBy("doc_id").agg(F.count(F.lit(1)).alias("gone"))
    right = b.exceptAll(a).groupBy("doc_id").agg(F.count(F.lit(1)).alias("new"))
    return left.join(right, "doc_id", "full").select("doc_id", F.coalesce("gone", F.lit(0)).alias("gone"), F.coalesce("new", F.lit(0)).alias("new"))


def union_chunks(spark, d):
    """Chunks of 20 lines put together again in their order."""
    s = _seg(spark, d).withColumn("chunk", F.floor(F.col("ord") / 20))
    c = s.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    whole = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "l"))).alias("c"))
    return whole.select("doc_id", F.array_join(F.transform(F.flatten(F.transform("c", lambda x: x["l"])), lambda x: x["text"]), "\n").alias("text"))


def term_consistency(spark, d):
    """For each repeated source, its most common wording and the share that agrees."""
    t = _tr(spark, d).where("target <> ''").withColumn("key", T.share_key(F.col("source"))).where("key is not null")
    v = t.groupBy("key", F.lower(T.collapse(F.col("target"))).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    g = v.groupBy("key").agg(F.sum("n").alias("uses"), F.max(F.struct("n", "form")).alias("b")).where("uses >= 2")
    return g.select("key", F.col("b.form").alias("form"), "uses", F.round(F.col("b.n") / F.col("uses"), 6).alias("share"))


def char_batches(spark, d):
    """Greedy batches of at most 2000 characters and 8 segments, a longer one alone: a fold over each document's ordered lengths."""
    g = _seg(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.length("text").cast("int").alias("n")))).alias("s"))
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<struct<ord:int,batch:int>>").alias("out"))

    def step(a, x):
        new = ((a["n"] + x["n"] > 2000) | (a["k"] >= 8)) & (a["k"] > 0)
        b = a["b"] + new.cast("int")
        return F.struct(b.alias("b"), F.when(new, x["n"]).otherwise(a["n"] + x["n"]).alias("n"), F.when(new, 1).otherwise(a["k"] + 1).alias("k"), F.concat(a["out"], F.array(F.struct(x["ord"].alias("ord"), b.alias("batch")))).alias("out"))

    return g.select("doc_id", F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("o")).select("doc_id", "o.ord", "o.batch")


BATCHES_SQL = f"""WITH RECURSIVE {SEG}, o AS (SELECT doc_id, ord, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM seg),
f AS (SELECT doc_id, ord, i, n AS total, 1 AS k, 0 AS batch FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.ord, o.i, CASE WHEN f.total + o.n > 2000 OR f.k >= 8 THEN o.n ELSE f.total + o.n END, CASE WHEN f.total + o.n > 2000 OR f.k >= 8 THEN 1 ELSE f.k + 1 END, f.batch + (f.total + o.n > 2000 OR f.k >= 8)::INT
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
SELECT doc_id, ord, batch FROM f"""

QUERIES = {
    "progress_chars": (progress_chars, f"WITH {TR} SELECT lang, sum(length(source)) FILTER (WHERE target <> '')::BIGINT AS done, sum(length(source))::BIGINT AS total, count(*) FILTER (WHERE target = '') AS missing, round(sum(length(target)) FILTER (WHERE target <> '') / sum(length(source)) FILTER (WHERE target <> ''), 6) AS expansion FROM tr GROUP BY lang"),
    "page_semi": (page_semi, f"WITH {SEG} SELECT doc_id, ord, CAST(floor(ord / 40) AS INTEGER) AS pg FROM seg WHERE floor(ord / 40) IN (1, 3)"),
    "skip_limit": (skip_limit, f"WITH {SEG} SELECT doc_id, ord FROM seg ORDER BY doc_id, ord LIMIT 50 OFFSET 100"),
    "apply_left": (apply_left, f"WITH {TR} SELECT s.doc_id, s.ord, CASE WHEN coalesce(t.target, '') <> '' THEN t.target ELSE s.text END AS written FROM seg s LEFT JOIN tr t ON t.doc_id = s.doc_id AND t.ord = s.ord AND t.doc_id % 2 = 0"),
    "apply_orphans": (apply_orphans, f"WITH {SEG} SELECT doc_id, ord FROM seg WHERE ord % 2 = 1"),
    "dedupe_first": (dedupe_first, f"WITH {SEG}, k AS (SELECT *, {KEY.format(t='text')} AS key FROM seg) SELECT key, arg_min(doc_id, (doc_id, ord)) AS doc_id, arg_min(ord, (doc_id, ord)) AS ord, count(*) AS uses FROM k WHERE key IS NOT NULL GROUP BY key"),
    "dedupe_apply": (dedupe_apply, f"WITH {TR}, k AS (SELECT *, {KEY.format(t='source')} AS key FROM tr), f AS (SELECT key, arg_min(target, (doc_id, ord)) AS t FROM k WHERE key IS NOT NULL GROUP BY key) SELECT k.doc_id, k.ord, coalesce(f.t, k.target) AS target FROM k LEFT JOIN f USING (key)"),
    "memory_lookup": (memory_lookup, MEMORY_SQL),
    "memory_upsert": (memory_upsert, f"WITH {TR} SELECT source, lang AS src_lang, arg_max(target, (doc_id, ord)) AS target, sha256(source || chr(0) || lang || chr(0) || 'xx' || chr(0) || 'm') AS key FROM tr WHERE target <> '' GROUP BY source, lang"),
    "term_candidates": (term_candidates, _terms_sql()),
    "glossary_terms": (glossary_terms, GLOSSARY_SQL),
    "glossary_merge": (glossary_merge, "WITH a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS k FROM part), u AS (SELECT DISTINCT lower(c_mktsegment) AS k FROM customer) SELECT k, 'auto' AS origin FROM a WHERE k NOT IN (SELECT k FROM u) UNION ALL SELECT k, 'user' FROM u"),
    "repeat_groups": (repeat_groups, f"WITH {SEG}, k AS (SELECT {KEY.format(t='text')} AS key FROM seg) SELECT key, count(*) AS uses FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 2"),
    "repeat_vote": (repeat_vote, VOTE_SQL),
    "retry_selection": (retry_selection, RETRY_SQL),
    "untranslated": (untranslated, UNTRANSLATED_SQL),
    "context_windows": (context_windows, CONTEXT_SQL),
    "section_state": (section_state, SECTION_SQL),
    "hyphen_join": (hyphen_join, HYPHEN_SQL),
    "header_repeat": (header_repeat, HEADER_SQL),
    "weighted_median": (weighted_median, f"WITH {SEG}, w AS (SELECT lang, length(text) AS n, unnest(range(len(string_split(text, ' ')))) FROM seg) SELECT lang, quantile_cont(n, 0.5)::DOUBLE AS median FROM w GROUP BY lang"),
    "typical_ratio": (typical_ratio, f"WITH {TR} SELECT lang, round(quantile_cont(length(target) / length(source), 0.5), 6) AS ratio, count(*) AS n FROM tr WHERE target <> '' AND target <> source AND length(source) >= 20 GROUP BY lang HAVING count(*) >= 3"),
    "dominant_style": (dominant_style, f"WITH {SEG}, s AS (SELECT doc_id, ord, length(text) AS n, (CASE WHEN substr(text, 1, 1) = upper(substr(text, 1, 1)) THEN 'U' ELSE 'l' END) || least(3, floor(length(text) / 60))::INT::VARCHAR AS style FROM seg), g AS (SELECT doc_id, style, sum(n) AS n, min(ord) AS f FROM s GROUP BY ALL) SELECT doc_id, arg_max(style, (n, -f)) AS style, max(n)::BIGINT AS chars FROM g GROUP BY doc_id"),
    "page_metrics": (page_metrics, f"WITH {SEG}, g AS (SELECT doc_id, CAST(floor(ord / 40) AS INTEGER) AS pg, list_sort(list(length(text))) AS l FROM seg GROUP BY ALL) SELECT doc_id, pg, len(l)::BIGINT AS blocks, list_sum(l)::BIGINT AS chars, list_aggregate(l, 'quantile_cont', 0.5)::DOUBLE AS median, l[floor(len(l) * 0.9::DOUBLE)::INT + 1]::INT AS p90 FROM g"),
    "phase_share": (phase_share, "WITH g AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1) SELECT event_type, round(v, 3) AS seconds, round(100 * v / sum(v) OVER (), 3) AS percent FROM g"),
    "fit_layers": (fit_layers, f"WITH {TR}, r AS (SELECT target, length(target) / (CASE WHEN length(source) < 40 THEN 60 ELSE length(source) END) AS o FROM tr), c AS (SELECT CASE WHEN target = '' OR o <= 1 THEN 'as-is' WHEN o <= 1 / 0.85::DOUBLE THEN 'shrink' WHEN o <= 1.3::DOUBLE THEN 'shorter' ELSE 'overflow' END AS layer, count(*) AS c FROM r GROUP BY 1), l(layer) AS (VALUES ('as-is'), ('shrink'), ('shorter'), ('longer'), ('overflow')) SELECT layer, coalesce(c, 0)::BIGINT AS n FROM l LEFT JOIN c USING (layer)"),
    "bench_grouping_sets": (bench_grouping_sets, f"WITH {TR}, t AS (SELECT d.source AS source, tr.lang AS lang, (target = '')::INT AS lost FROM tr JOIN documents d USING (doc_id)) SELECT source, lang, grouping(source, lang)::INT AS level, sum(lost)::BIGINT AS lost, count(*) AS blocks, round(1 - sum(lost) / count(*), 6) AS layout FROM t GROUP BY GROUPING SETS ((source, lang), (lang), ())"),
    "rollup_orders": (rollup_orders, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "cube_lineitem": (cube_lineitem, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "even_sample": (even_sample, f"WITH {SEG}, s AS (SELECT lang, doc_id, ord, row_number() OVER (PARTITION BY lang ORDER BY doc_id, ord) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM seg WHERE length(text) >= 30) SELECT lang, doc_id, ord FROM s WHERE n <= 20 OR i IN (SELECT (k * s.n) // 20 FROM range(20) t(k))"),
    "score_summary": (score_summary, "SELECT source, round(avg(quality), 6) AS mean, round(avg((quality >= 1)::INT), 6) AS good, count(quality) AS rated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"),
    "run_delta": (run_delta, f"WITH u AS ({UNTRANSLATED_SQL}), k(kind) AS (VALUES ('missing'), ('passthrough'), ('other')), a AS (SELECT flag AS kind, count(*) AS a FROM u WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT flag AS kind, count(*) AS b FROM u WHERE doc_id % 2 = 1 GROUP BY 1) SELECT kind, coalesce(b, 0) AS now, coalesce(b, 0) - a AS delta FROM k LEFT JOIN a USING (kind) LEFT JOIN b USING (kind)"),
    "part_openings": (part_openings, f"WITH {SEG} SELECT doc_id, k::INT AS k, substr(text, 1, 600) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM seg WHERE length(text) >= 40) WHERE k <= 3"),
    "matrix_ratio": (matrix_ratio, f"WITH {TR}, g AS (SELECT doc_id, sum(len(list_filter(string_split_regex(source, ' +'), lambda w: w <> '')))::BIGINT AS ws, sum(len(list_filter(string_split_regex(target, ' +'), lambda w: w <> '')))::BIGINT AS wt, sum(length(regexp_replace(source, '[ \\n]', '', 'g'))) AS cs, sum(length(regexp_replace(target, '[ \\n]', '', 'g'))) AS ct FROM tr GROUP BY doc_id) SELECT doc_id, ws AS words_source, wt AS words_target, CASE WHEN ws = 0 THEN (wt = 0)::INT::DOUBLE ELSE round(wt / ws, 6) END AS words_ratio, CASE WHEN cs = 0 THEN (ct = 0)::INT::DOUBLE ELSE round(ct / cs, 6) END AS chars_ratio FROM g"),
    "word_share": (word_share, f"WITH {TR}, a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(source, ' +')) AS w FROM tr) WHERE w <> '' GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS m FROM (SELECT doc_id, unnest(string_split_regex(target, ' +')) AS w FROM tr) WHERE w <> '' GROUP BY ALL) SELECT doc_id, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) AS share FROM a LEFT JOIN b USING (doc_id, w) GROUP BY doc_id"),
    "reading_diff": (reading_diff, f"WITH {TR}, a AS (SELECT doc_id, {COLLAPSE.format(t='source')} AS t FROM tr), b AS (SELECT doc_id, {COLLAPSE.format(t='plain')} AS t FROM (SELECT doc_id, regexp_replace(target, '^\\[xx\\]', '') AS plain FROM tr WHERE target <> '')), l AS (SELECT doc_id, count(*) AS gone FROM (FROM a EXCEPT ALL FROM b) GROUP BY 1), r AS (SELECT doc_id, count(*) AS new FROM (FROM b EXCEPT ALL FROM a) GROUP BY 1) SELECT doc_id, coalesce(gone, 0) AS gone, coalesce(new, 0) AS new FROM l FULL JOIN r USING (doc_id)"),
    "union_chunks": (union_chunks, f"WITH {SEG} SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM seg GROUP BY doc_id"),
    "term_consistency": (term_consistency, f"WITH {TR}, v AS (SELECT {KEY.format(t='source')} AS key, lower({COLLAPSE.format(t='target')}) AS form, count(*) AS n FROM tr WHERE target <> '' GROUP BY ALL) SELECT key, arg_max(form, (n, form)) AS form, sum(n)::BIGINT AS uses, round(max(n) / sum(n), 6) AS share FROM v WHERE key IS NOT NULL GROUP BY key HAVING sum(n) >= 2"),
    "char_batches": (char_batches, BATCHES_SQL),
}
