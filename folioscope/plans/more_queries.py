"""Catalogue, part 5: the remaining predicates, joins, aggregates, windows and text functions of SURVEY 2."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import segments as S
from ..operators import pages as P
from ..operators import sequential as Q
from ..sources.tables import LAY, SEG, TR, boxes, replies, segments, table


def _seg(spark, d):
    return segments(spark, d)


def _tr(spark, d):
    return replies(segments(spark, d))


def _lay(spark, d):
    return boxes(segments(spark, d))


def scanned_pages(spark, d):
    """Image coverage of 0.05 and fewer than one character per 1000 square points."""
    cover = (F.col("doc_id") % 10) / 10
    return table(spark, d, "documents").select("doc_id", ((cover >= 0.05) & (F.length("text") / 480.0 < 1.0)).alias("scanned"))


def searchable_scan(spark, d):
    """Coverage of half the page and more invisible glyphs (here digits) than visible ones (punctuation)."""
    n = lambda p: F.length(F.regexp_replace("text", p, ""))
    return _seg(spark, d).groupBy("doc_id").agg(F.sum(n("[^0-9]")).alias("a"), F.sum(n("[^.,]")).alias("b")).select("doc_id", ((F.col("doc_id") % 10 >= 5) & (F.col("a") > F.col("b"))).alias("searchable"))


def best_reading(spark, d):
    """Documents read twice only where more than 8 % of the first reading's blocks are doubtful (confidence under 0.8); of two readings the one with more
    confidence-weighted characters."""
    t = _tr(spark, d).withColumn("c1", (70 + (F.col("ord") * 7 + F.col("doc_id")) % 31) / 100).withColumn("c2", (75 + (F.col("ord") * 5 + F.col("doc_id")) % 26) / 100)
    g = t.groupBy("doc_id").agg(F.avg((F.col("c1") < 0.8).cast("int")).alias("doubt"), F.sum(F.length("source") * F.round(F.col("c1") * 100).cast("long")).alias("w1"), F.sum(F.length("target") * F.round(F.col("c2") * 100).cast("long")).alias("w2"))
    again = F.col("doubt") > 0.08
    return g.select("doc_id", F.when(again & (F.col("w2") > F.col("w1")), "300").otherwise("200").alias("dpi"), F.when(again, F.greatest("w1", "w2")).otherwise(F.col("w1")).alias("weight"))


READING_SQL = f"""WITH {TR}, t AS (SELECT *, 70 + (ord * 7 + doc_id) % 31 AS c1, 75 + (ord * 5 + doc_id) % 26 AS c2 FROM tr),
g AS (SELECT doc_id, avg((c1 < 80)::INT) AS doubt, sum(length(source) * c1) AS w1, sum(length(target) * c2) AS w2 FROM t GROUP BY doc_id)
SELECT doc_id, CASE WHEN doubt > 0.08::DOUBLE AND w2 > w1 THEN '300' ELSE '200' END AS dpi, (CASE WHEN doubt > 0.08::DOUBLE THEN greatest(w1, w2) ELSE w1 END)::BIGINT AS weight FROM g"""


def outlined_text(spark, d):
    """Lines none of whose words stand in the document's other half (an anti join on words)."""
    s = _seg(spark, d)
    words = lambda x: x.select("doc_id", "ord", F.explode(F.array_distinct(F.split(F.lower("text"), " +"))).alias("w"))
    shared = words(s.where("ord % 2 = 0")).join(words(s.where("ord % 2 = 1")).select("doc_id", "w").distinct(), ["doc_id", "w"], "left_semi").select("doc_id", "ord").distinct()
    return s.where("ord % 2 = 0").select("doc_id", "ord").join(shared, ["doc_id", "ord"], "left_anti")


def untouched(spark, d):
    """Replies equal to their source once markers and white space are normalised, with and without regard to case."""
    s, t = F.col("source"), F.col("target")
    u = T.collapse(T.strip_markers(s)) == T.collapse(T.strip_markers(t))
    return _tr(spark, d).groupBy("lang").agg(F.count_if(u).alias("exact"), F.count_if(T.normalised(s) == T.normalised(t)).alias("folded"))


def conversion_allowed(spark, d):
    """Membership of (source, target) pairs, ``auto`` meaning the source's own kind."""
    pairs = spark.createDataFrame([("pdf", "pdf"), ("pdf", "html"), ("docx", "docx"), ("epub", "epub"), ("epub", "html")], "s string, t string")
    kinds = F.array(*[F.lit(x) for x in ("pdf", "docx", "epub", "txt")])
    asks = F.array(*[F.lit(x) for x in ("auto", "html", "pdf")])
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("s"), F.element_at(asks, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("a"))
    o = o.withColumn("t", F.when(F.col("a") == "auto", F.col("s")).otherwise(F.col("a")))
    return o.join(F.broadcast(pairs.withColumn("open", F.lit(True))), ["s", "t"], "left").select("o_orderkey", "s", "t", F.coalesce("open", F.lit(False)).alias("open"))


def growth_rules(spark, d):
    """P20 over boxes: single-line boxes don't grow down, only left-column boxes grow right."""
    return _lay(spark, d).select("doc_id", "ord", (F.col("y1") - F.col("y0") > 12).alias("down"), (F.col("x0") == 50).alias("right"))


def inflected_terms(spark, d):
    """Texts with a term at the start of a word, in any case and with any ending; of a term of four letters or more the last letter may differ where two more
    follow. Words meet the terms by their beginnings, of the lengths that terms have."""
    terms = spark.createDataFrame([(t,) for t in ("tion", "the", "ein", "que", "oner")], "term string")
    return S.inflected_in(_seg(spark, d), terms, [3, 4]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def language_dimension(spark, d):
    """Characters a token and expansion by language, with defaults."""
    dim = spark.createDataFrame([("en", 4.0, 1.0), ("de", 3.5, 1.15), ("fr", 3.8, 1.1)], "lang string, per_token double, expansion double")
    g = _seg(spark, d).groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    return g.join(F.broadcast(dim), "lang", "left").select("lang", F.bround(F.col("chars") / F.coalesce("per_token", F.lit(3.6))).cast("long").alias("tokens"), F.floor(F.col("chars") * F.coalesce("expansion", F.lit(1.2))).cast("long").alias("expected"))


def point_in_box(spark, d):
    """The first box (by order) that holds each page's probe points, 2 points of slack."""
    lay = _lay(spark, d)
    probe = lay.select("doc_id", "pg").distinct().select("doc_id", "pg", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((60, 65), (320, 100), (590, 10))])).alias("p"))
    hit = probe.join(lay, ["doc_id", "pg"]).where((F.col("p.x") >= F.col("x0") - 2) & (F.col("p.x") <= F.col("x1") + 2) & (F.col("p.y") >= F.col("y0") - 2) & (F.col("p.y") <= F.col("y1") + 2))
    return hit.groupBy("doc_id", "pg", F.col("p.x").alias("x")).agg(F.min("ord").alias("ord"))


def type_verdict(spark, d):
    """How a reply's size compares: faithful, shrunk, grown."""
    r = F.length("target") / F.length("source")
    v = F.when(r <= 0.8, "shrunk").when(r >= 1.2, "inflated").otherwise("faithful")
    return _tr(spark, d).where("target <> ''").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def aligned_rows(spark, d):
    """Pairs of y-rows of a page that share two left edges or more."""
    lay = _lay(spark, d).select("doc_id", "pg", "y0", "x0").distinct()
    a, b = lay.withColumnRenamed("y0", "ya"), lay.withColumnRenamed("y0", "yb")
    return a.join(b, ["doc_id", "pg", "x0"]).where("ya < yb").groupBy("doc_id", "pg", "ya", "yb").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def zip_positions(spark, d):
    """Positional pairing of a batch with a reply that is one short; what has no reply gets null."""
    b = _seg(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("s"))
    short = F.transform(F.slice("s", 1, F.greatest(F.lit(1), F.size("s") - 1)), lambda x: F.reverse(F.substring(x["text"], 1, 3)))
    pairs = F.zip_with("s", short, lambda a, r: F.struct(a["ord"].alias("ord"), r.alias("reply")))
    return b.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.ord", "p.reply")


def inline_styles(spark, d):
    """Numbers of the styles that aren't dominant, by first appearance."""
    style = F.least(F.lit(4), F.floor(F.length("text") / 50)).cast("int")
    g = _seg(spark, d).groupBy("doc_id", style.alias("style")).agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("doc_id")
    top = F.max(F.struct("n", (-F.col("first")).alias("f"))).over(w)
    return g.withColumn("f", (-F.col("first"))).withColumn("top", top).where("n <> top.n or f <> top.f").select("doc_id", "style", (F.row_number().over(w.orderBy("first")) - 1).alias("marker"))


def size_ceiling(spark, d):
    """The page's body column (median left edge of boxes half as wide as the widest), and sizes of boxes that are no headings held down to the median
    of their document's page medians."""
    lay = _lay(spark, d)
    size = F.col("y1") - F.col("y0")
    widest = lay.groupBy("doc_id", "pg").agg(F.max(F.col("x1") - F.col("x0")).alias("widest"))
    j = lay.join(widest, ["doc_id", "pg"])
    page = j.groupBy("doc_id", "pg").agg(F.percentile(F.when(F.col("x1") - F.col("x0") >= 0.5 * F.col("widest"), F.col("x0")), 0.5).alias("edge"), F.percentile(F.when(F.length("text") > 25, size), 0.5).alias("mid"))
    cap = page.groupBy("doc_id").agg(F.percentile("mid", 0.5).alias("cap"))
    held = F.when((F.length("text") > 25) & F.col("cap").isNotNull(), F.least(size, F.col("cap"))).otherwise(size)
    return lay.join(page, ["doc_id", "pg"]).join(cap, "doc_id").select("doc_id", "pg", "ord", held.alias("size"), "edge")


CEILING_SQL = f"""WITH {LAY}, w AS (SELECT *, max(x1 - x0) OVER (PARTITION BY doc_id, pg) AS widest FROM lay),
p AS (SELECT doc_id, pg, quantile_cont(x0, 0.5) FILTER (WHERE x1 - x0 >= 0.5::DOUBLE * widest) AS edge, quantile_cont(y1 - y0, 0.5) FILTER (WHERE length(text) > 25) AS mid FROM w GROUP BY ALL), c AS (SELECT doc_id, quantile_cont(mid, 0.5) AS cap FROM p GROUP BY doc_id)
SELECT lay.doc_id, lay.pg, ord, CASE WHEN length(text) > 25 AND cap IS NOT NULL THEN least(y1 - y0, cap) ELSE y1 - y0 END AS size, edge FROM lay JOIN p ON p.doc_id = lay.doc_id AND p.pg = lay.pg JOIN c ON c.doc_id = lay.doc_id"""


def keyword_stretches(spark, d):
    return Q.stretches(_seg(spark, d), 40, 1000)


def glossary_excerpt(spark, d):
    """Each document's lines joined until 300 characters are reached, then cut."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    s = _seg(spark, d).withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before <= 300")
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    return g.select("doc_id", F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 1, 300).alias("excerpt"))


def contrast(spark, d):
    """For each term, target words of segments that hold it and of none that doesn't; the four most frequent."""
    s = _seg(spark, d)
    terms = spark.createDataFrame([("with",), ("dans",), ("nicht",), ("para",)], "term string")
    words = s.select("doc_id", "ord", "lang", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("length(w) >= 4")
    has = words.join(F.broadcast(terms), words.w == terms.term).select("doc_id", "ord", "term")
    inside = words.select("doc_id", "ord", "w").join(has, ["doc_id", "ord"]).groupBy("term", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and w <> term")
    total = words.groupBy("w").agg(F.count(F.lit(1)).alias("all"))
    only = inside.join(total, "w").where("n = all")
    return only.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "w"))).where("k <= 4").select("term", "w", "n", "k")


CONTRAST_SQL = f"""WITH {SEG}, w AS (SELECT DISTINCT doc_id, ord, w FROM (SELECT doc_id, ord, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS w FROM seg) WHERE length(w) >= 4),
h AS (SELECT doc_id, ord, w AS term FROM w WHERE w IN ('with', 'dans', 'nicht', 'para')), i AS (SELECT term, w.w, count(*) AS n FROM w JOIN h USING (doc_id, ord) WHERE w.w <> term GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT w, count(*) AS a FROM w GROUP BY w) SELECT * FROM (SELECT term, i.w, n, row_number() OVER (PARTITION BY term ORDER BY n DESC, i.w)::INT AS k FROM i JOIN t ON t.w = i.w AND n = a) WHERE k <= 4"""


def completeness(spark, d):
    """Share of prose left in the source language, and of boxes off the page."""
    prose = T.is_checked(F.col("source")) & (F.length("source") >= 40)
    g = _tr(spark, d).where(prose).groupBy("doc_id").agg(F.round(F.avg(((F.col("target") == "") | (F.col("source") == F.col("target"))).cast("int")), 6).alias("verbatim"), F.count(F.lit(1)).alias("prose"))
    off = _lay(spark, d).groupBy("doc_id").agg(F.count_if((F.col("x1") > 545) | (F.col("y1") > 340)).alias("off"))
    return off.join(g, "doc_id", "left")


def vocabulary_share(spark, d):
    """Known words over words by document, known meaning that the benchmark's vocabulary has them (a semi join)."""
    words = lambda df, k: df.select(k, F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)).alias("w"))
    vocab = words(table(spark, d, "benchmark"), "item_id").select("w").distinct().withColumn("known", F.lit(1))
    j = words(table(spark, d, "documents"), "doc_id").groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n")).join(vocab, "w", "left")
    return j.groupBy("doc_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("known"))


def spread_sample(spark, d):
    """Ten documents of 200 characters, by the hash of their id."""
    return table(spark, d, "documents").where(F.length("text") >= 200).select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("s7"))).alias("h")).orderBy("h").limit(10)


def continuation(spark, d):
    """The last box of each page that ends without terminal punctuation."""
    last = _lay(spark, d).groupBy("doc_id", "pg").agg(F.max(F.struct("ord", "text")).alias("b"))
    return last.select("doc_id", "pg", F.col("b.ord").alias("ord"), (~F.col("b.text").rlike("[.!?:]$")).alias("continues"))


def page_content(spark, d):
    """Boxes and stand-in images of each page in one order by y."""
    lay = _lay(spark, d)
    both = lay.select("doc_id", "pg", "y0", F.lit(0).alias("image"), "ord").union(lay.select("doc_id", "pg").distinct().select("doc_id", "pg", F.lit(150.0), F.lit(1), F.lit(-1)))
    return both.select("doc_id", "pg", "image", "ord", F.row_number().over(Window.partitionBy("doc_id", "pg").orderBy("y0", "image", "ord")).alias("place"))


def wave_plan(spark, d):
    """Chunks of ten segments in document order, four in a wave."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    s = _seg(spark, d).withColumn("k", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("k") / 10).cast("int"))
    return s.select("doc_id", "ord", "chunk", F.floor(F.col("chunk") / 4).cast("int").alias("wave"))


def first_examples(spark, d):
    """Three examples of each kind of finding."""
    t = _tr(spark, d).withColumn("kind", F.when(F.col("target") == "", "missing").when(F.col("source") == F.col("target"), "echo").when(F.col("target").rlike(r"\p{IsCyrillic}"), "script")).where("kind is not null")
    return t.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("doc_id", "ord"))).where("k <= 3").select("kind", "k", "doc_id", "ord")


def marked_spans(spark, d):
    """F15/F16."""
    m = F.concat(F.lit("<0>"), F.substring("text", 1, 5), F.lit("</0>"), F.substring("text", 6, 20), F.when(F.col("ord") % 5 == 0, F.lit("<1>")).otherwise(F.lit("")))
    return Q.parse_marked(_seg(spark, d).select("doc_id", "ord", m.alias("m")), "m")


MARKED_SQL = f"""WITH {SEG} SELECT doc_id, ord, 0 AS k, 0 AS style, substr(text, 1, 5) AS text FROM seg WHERE ord % 5 <> 0 UNION ALL SELECT doc_id, ord, 1, -1, substr(text, 6, 20) FROM seg WHERE ord % 5 <> 0 AND length(text) > 5"""


def soft_hyphens(spark, d):
    return _seg(spark, d).select("doc_id", "ord", (F.length(Q.soft_hyphens(F.col("text"))) - F.length("text")).alias("added"), (F.replace(Q.soft_hyphens(F.col("text")), F.lit("­"), F.lit("")) == F.col("text")).alias("same"))


def missing_glyphs(spark, d):
    """letters of each document that a Latin-1 letter set lacks."""
    have = F.split(F.lit("abcdefghijklmnopqrstuvwxyzäöüß"), "")
    chars = F.array_distinct(F.filter(F.split(F.lower("text"), ""), lambda c: c.rlike(r"\p{L}")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_except(chars, have)), "").alias("missing"))


def font_ladder(spark, d):
    """original, else substitute by name, else by class, else none."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Font"), (F.col("p_size") % 7).cast("string")).alias("font"), (F.col("p_size") % 3).alias("cls"))
    own = spark.createDataFrame([("Font1",), ("Font2",)], "font string").withColumn("o", F.concat(F.lit("own:"), F.col("font")))
    sub = spark.createDataFrame([("Font3", "Sub3")], "font string, s string")
    cls = spark.createDataFrame([(0, "Sans"), (1, "Serif")], "cls int, c string")
    return p.join(F.broadcast(own), "font", "left").join(F.broadcast(sub), "font", "left").join(F.broadcast(cls), "cls", "left").select("p_partkey", F.coalesce("o", "s", "c", F.lit("none")).alias("used"))


def glossary_fingerprint(spark, d):
    """twelve hex digits of the sha-256 of sorted key=value pairs, by market segment."""
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.concat(F.col("c_name"), F.lit("="), F.col("c_nationkey").cast("string")))).alias("l"))
    return g.select("c_mktsegment", F.substring(F.sha2(F.array_join("l", "|"), 256), 1, 12).alias("print"))


def review_reasons(spark, d):
    """Findings of a segment joined into one reason, each once, with an argument after a pipe."""
    s, t = F.col("source"), F.col("target")
    lost = F.size(T.digit_groups(s)) - F.size(T.digit_groups(t))
    r = F.array_compact(F.array(F.when(t == "", "MISSING"), F.when((t != "") & (s == t), "ECHO"), F.when((t != "") & (lost > 0), F.concat(F.lit("NUMBERS|"), lost.cast("string")))))
    return _tr(spark, d).select("doc_id", "ord", F.array_join(r, "; ").alias("reason")).where("reason <> ''")


def wrapped_lines_count(spark, d):
    """A10."""
    return _seg(spark, d).select("doc_id", "ord", Q.wrap_count(F.col("text"), 60).alias("lines"))


def timeouts(spark, d):
    """Batch timeouts clamped to 30..900 seconds, and retry delays from headers that may be unreadable."""
    g = _seg(spark, d).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    return g.select("doc_id", F.least(F.lit(900.0), F.greatest(F.lit(30.0), 10 + F.col("n") / 40)).alias("timeout"), F.least(F.lit(60), F.coalesce(F.expr("try_cast(CASE WHEN doc_id % 3 = 0 THEN 'soon' ELSE cast(doc_id % 100 AS string) END AS int)"), F.lit(5))).alias("delay"))


def settings(spark, d):
    """Settings of any text clamped into their range, unreadable ones at their default."""
    raw = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE cast(o_totalprice AS string) END")
    return table(spark, d, "orders").select("o_orderkey", F.least(F.lit(90000), F.greatest(F.lit(1000), F.floor(F.coalesce(raw.try_cast("double"), F.lit(50000.0))).cast("int"))).alias("v"))


def piece_rescue(spark, d):
    """Missing replies asked for piece by piece and put together; any failed piece keeps the source."""
    t = _tr(spark, d).where("target = ''").withColumn("p", T.pieces(F.col("source"))).where("size(p) > 0").select("doc_id", "ord", "source", F.posexplode("p").alias("k", "x"))
    t = t.withColumn("r", F.when(F.length("x") > 160, F.lit(None)).otherwise(F.concat(F.lit("~"), F.col("x"))))
    g = t.groupBy("doc_id", "ord", "source").agg(F.bool_and(F.col("r").isNotNull()).alias("ok"), F.array_sort(F.collect_list(F.struct("k", "r"))).alias("l"))
    return g.select("doc_id", "ord", F.when(F.col("ok"), F.array_join(F.transform("l", lambda x: x["r"]), " ")).otherwise(F.col("source")).alias("rescued"))


PIECE_SQL = f"""WITH {TR}, p AS (SELECT doc_id, ord, source, string_split(regexp_replace(source, '([.!?;:]) +', '\\1' || chr(10), 'g'), chr(10)) AS p FROM tr WHERE target = '')
SELECT doc_id, ord, CASE WHEN len(list_filter(p, lambda x: length(x) > 160)) = 0 THEN array_to_string(list_transform(p, lambda x: '~' || x), ' ') ELSE source END AS rescued FROM p
WHERE len(p) BETWEEN 2 AND 12 AND len(list_filter(p, lambda x: len(string_split_regex(trim(x), ' +')) < 2)) = 0"""


def glossary_verify(spark, d):
    """Terms of the source that the reply honours (as upper case or as they were)."""
    s, t = F.col("source"), F.col("target")
    terms = F.array(*[F.lit(x) for x in ("the", "und", "que", "les")])
    whole = lambda c, x: F.contains(F.concat(F.lit(" "), c, F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))
    r = _tr(spark, d).where("target <> ''").select(F.explode(F.transform(F.filter(terms, lambda x: whole(s, x)), lambda x: F.struct(x.alias("term"), (whole(t, x) | whole(t, F.upper(x))).alias("ok")))).alias("r"))
    return r.groupBy("r.term").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("r.ok")).alias("honoured"))


def off_figures(spark, d):
    """The wider free strip of each box beside a figure that stands at x 120..200; refused under 36 points or a quarter of the box."""
    left, right = F.least("x1", F.lit(120.0)) - F.col("x0"), F.col("x1") - F.greatest("x0", F.lit(200.0))
    best = F.greatest(F.lit(0.0), left, right)
    w = F.col("x1") - F.col("x0")
    return _lay(spark, d).select("doc_id", "ord", best.alias("free"), ((best >= 36) & (best >= 0.25 * w)).alias("ok"))


def required_expansion(spark, d):
    """The least of five height steps, up to twice the height, at which the reply fits."""
    t = _tr(spark, d).where("target <> ''").join(_lay(spark, d), S.READING).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    room = F.floor((F.col("x1") - F.col("x0")) / 5.5) * F.floor((F.col("y1") - F.col("y0")) * (1 + F.col("k") * 0.25) / 12)
    return t.where(room >= F.length("target")).groupBy("doc_id", "ord").agg(F.min("k").alias("step"))


def splice_edits(spark, d):
    """K6: edits of a text by position, spliced from left to right, a swallowed one dropped."""
    s, n = _seg(spark, d).where("length(text) >= 30").select("doc_id", "ord", "text"), F.length("text")
    e = F.array(F.struct(F.lit(2).alias("a"), F.lit(6).alias("b"), F.lit("[A]").alias("t")), F.struct((4 + n % 5).alias("a"), (5 + n % 5).alias("b"), F.lit("[B]").alias("t")), F.struct(F.lit(10).alias("a"), F.lit(14).alias("b"), F.lit("[C]").alias("t")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x["b"] <= acc["at"], acc).otherwise(F.struct(x["b"].alias("at"), F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), x["a"] - acc["at"])), x["t"]).alias("out")))
    done = F.aggregate(e, zero, step)
    return s.withColumn("d", done).select("doc_id", "ord", F.concat("d.out", F.substr(F.col("text"), F.col("d.at") + 1)).alias("text"))


def boxes_to_lines(spark, d):
    return P.boxes_to_lines(_lay(spark, d))


def reading_order(spark, d):
    return P.reading_order(_lay(spark, d))


def wrapped_merge(spark, d):
    return P.wrapped_lines(_lay(spark, d))


def set_operations(spark, d):
    """Customers and suppliers by nation: both, only customers, either."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda x, n: x.select("k", F.lit(n).alias("op"))
    return tag(c.intersect(s), "both").union(tag(c.subtract(s), "customers")).union(tag(c.union(s).distinct(), "either"))


def squeezed_lines(spark, d):
    """D3: overlapping boxes of one column."""
    lay = _lay(spark, d)
    o = L.overlaps(lay)
    x = lay.select("doc_id", "pg", F.col("ord"), "x0")
    j = o.join(x.withColumnRenamed("ord", "a_ord").withColumnRenamed("x0", "xa"), ["doc_id", "pg", "a_ord"]).join(x.withColumnRenamed("ord", "b_ord").withColumnRenamed("x0", "xb"), ["doc_id", "pg", "b_ord"])
    return j.where("xa = xb").groupBy("doc_id", "pg").agg(F.count(F.lit(1)).alias("n"))


OVER = """ov AS (SELECT a.doc_id, a.pg, a.x0 AS xa, b.x0 AS xb, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.pg = b.pg AND a.ord < b.ord)"""
NORM = "lower(trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g')))"

QUERIES = {
    "scanned_pages": (scanned_pages, "SELECT doc_id, (doc_id % 10) / 10 >= 0.05 AND length(text) / 480.0::DOUBLE < 1.0 AS scanned FROM documents"),
    "searchable_scan": (searchable_scan, f"WITH {SEG} SELECT doc_id, doc_id % 10 >= 5 AND sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) > sum(length(regexp_replace(text, '[^.,]', '', 'g'))) AS searchable FROM seg GROUP BY doc_id"),
    "best_reading": (best_reading, READING_SQL),
    "outlined_text": (outlined_text, f"WITH {SEG}, w AS (SELECT DISTINCT doc_id, ord, unnest(string_split_regex(lower(text), ' +')) AS w FROM seg), o AS (SELECT DISTINCT doc_id, w FROM w WHERE ord % 2 = 1), hit AS (SELECT DISTINCT doc_id, ord FROM w JOIN o USING (doc_id, w) WHERE ord % 2 = 0) SELECT doc_id, ord FROM seg WHERE ord % 2 = 0 AND (doc_id, ord) NOT IN (SELECT (doc_id, ord) FROM hit)"),
    "untouched": (untouched, f"WITH {TR} SELECT lang, count(*) FILTER (WHERE trim(regexp_replace(source, '[ \\t\\r\\n]+', ' ', 'g')) = trim(regexp_replace(target, '[ \\t\\r\\n]+', ' ', 'g'))) AS exact, count(*) FILTER (WHERE {NORM.format(t='source')} = {NORM.format(t='target')}) AS folded FROM tr GROUP BY lang"),
    "conversion_allowed": (conversion_allowed, "WITH o AS (SELECT o_orderkey, ['pdf', 'docx', 'epub', 'txt'][o_orderkey % 4 + 1] AS s, ['auto', 'html', 'pdf'][o_orderkey % 3 + 1] AS a FROM orders), t AS (SELECT o_orderkey, s, CASE WHEN a = 'auto' THEN s ELSE a END AS t FROM o) SELECT *, (s, t) IN (('pdf', 'pdf'), ('pdf', 'html'), ('docx', 'docx'), ('epub', 'epub'), ('epub', 'html')) AS open FROM t"),
    "growth_rules": (growth_rules, f"WITH {LAY} SELECT doc_id, ord, y1 - y0 > 12 AS down, x0 = 50 AS right FROM lay"),
    "inflected_terms": (inflected_terms, f"WITH {SEG} " + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS n FROM seg WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}])({t}" + (f"|{t[:-1]}\\p{{L}}\\p{{L}}\\p{{L}}" if len(t) >= 4 else "") + ")') HAVING count(*) > 0" for t in ("tion", "the", "ein", "que", "oner"))),
    "language_dimension": (language_dimension, f"WITH {SEG}, g AS (SELECT lang, sum(length(text)) AS chars FROM seg GROUP BY lang) SELECT lang, round_even(chars / CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 3.5 WHEN 'fr' THEN 3.8 ELSE 3.6 END, 0)::BIGINT AS tokens, floor(chars * CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 1.15 WHEN 'fr' THEN 1.1 ELSE 1.2 END)::BIGINT AS expected FROM g"),
    "point_in_box": (point_in_box, f"WITH {LAY}, p(x, y) AS (VALUES (60.0::DOUBLE, 65.0::DOUBLE), (320, 100), (590, 10)) SELECT doc_id, pg, x, min(ord) AS ord FROM lay, p WHERE x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2 GROUP BY ALL"),
    "type_verdict": (type_verdict, f"WITH {TR} SELECT CASE WHEN length(target) / length(source) <= 0.8::DOUBLE THEN 'shrunk' WHEN length(target) / length(source) >= 1.2::DOUBLE THEN 'inflated' ELSE 'faithful' END AS verdict, count(*) AS n FROM tr WHERE target <> '' GROUP BY 1"),
    "aligned_rows": (aligned_rows, f"WITH {LAY}, l AS (SELECT DISTINCT doc_id, pg, y0, x0 FROM lay) SELECT a.doc_id, a.pg, a.y0 AS ya, b.y0 AS yb, count(*) AS n FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.pg = b.pg AND a.x0 = b.x0 AND a.y0 < b.y0 GROUP BY ALL HAVING count(*) >= 2"),
    "zip_positions": (zip_positions, f"WITH {SEG}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM seg) SELECT doc_id, ord, CASE WHEN k <= greatest(1, n - 1) THEN reverse(substr(text, 1, 3)) END AS reply FROM k"),
    "inline_styles": (inline_styles, f"WITH {SEG}, g AS (SELECT doc_id, least(4, floor(length(text) / 50))::INT AS style, sum(length(text)) AS n, min(ord) AS f FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM g) SELECT doc_id, style, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INT AS marker FROM r WHERE k > 1"),
    "size_ceiling": (size_ceiling, CEILING_SQL),
    "keyword_stretches": (keyword_stretches, f"WITH RECURSIVE {SEG}, o AS (SELECT doc_id, ord, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM seg WHERE length(text) >= 40), f AS (SELECT doc_id, ord, i, 0 AS grp, CASE WHEN n >= 1000 THEN 1 ELSE 0 END AS nextg, CASE WHEN n >= 1000 THEN 0 ELSE n END AS run FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.ord, o.i, f.nextg, CASE WHEN f.run + o.n >= 1000 THEN f.nextg + 1 ELSE f.nextg END, CASE WHEN f.run + o.n >= 1000 THEN 0 ELSE f.run + o.n END FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1) SELECT doc_id, ord, grp FROM f"),
    "glossary_excerpt": (glossary_excerpt, f"WITH {SEG} SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY ord), 1, 300) AS excerpt FROM seg GROUP BY doc_id"),
    "contrast_rendering": (contrast, CONTRAST_SQL),
    "completeness": (completeness, f"WITH {TR}, {LAY.replace(SEG + ', ', '')}, g AS (SELECT doc_id, round(avg((target = '' OR source = target)::INT), 6) AS verbatim, count(*) AS prose FROM tr WHERE regexp_matches(source, '\\p{{L}}') AND length(regexp_replace(source, '[^\\p{{L}}]', '', 'g')) / length(source) >= 0.3 AND length(source) >= 40 GROUP BY doc_id), o AS (SELECT doc_id, count(*) FILTER (WHERE x1 > 545 OR y1 > 340) AS off FROM lay GROUP BY doc_id) SELECT doc_id, off, verbatim, prose FROM o LEFT JOIN g USING (doc_id)"),
    "vocabulary_share": (vocabulary_share, "WITH v AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM benchmark), w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents) SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE w IN (SELECT w FROM v)) AS known FROM w WHERE length(w) >= 3 GROUP BY doc_id"),
    "spread_sample": (spread_sample, "SELECT doc_id, md5(doc_id::VARCHAR || 's7') AS h FROM documents WHERE length(text) >= 200 ORDER BY h LIMIT 10"),
    "continuation_flag": (continuation, f"WITH {LAY} SELECT doc_id, pg, max(ord) AS ord, NOT regexp_matches(arg_max(text, ord), '[.!?:]$') AS continues FROM lay GROUP BY ALL"),
    "page_content": (page_content, f"WITH {LAY}, b AS (SELECT doc_id, pg, y0, 0 AS image, ord FROM lay UNION ALL SELECT DISTINCT doc_id, pg, 150.0::DOUBLE, 1, -1 FROM lay) SELECT doc_id, pg, image, ord, row_number() OVER (PARTITION BY doc_id, pg ORDER BY y0, image, ord)::INT AS place FROM b"),
    "wave_plan": (wave_plan, f"WITH {SEG}, k AS (SELECT doc_id, ord, ((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 10)::INT AS chunk FROM seg) SELECT doc_id, ord, chunk, (chunk // 4)::INT AS wave FROM k"),
    "first_examples": (first_examples, f"WITH {TR}, t AS (SELECT *, CASE WHEN target = '' THEN 'missing' WHEN source = target THEN 'echo' WHEN regexp_matches(target, '\\p{{Cyrillic}}') THEN 'script' END AS kind FROM tr) SELECT kind, k::INT AS k, doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, ord) AS k FROM t WHERE kind IS NOT NULL) WHERE k <= 3"),
    "marked_spans": (marked_spans, MARKED_SQL),
    "soft_hyphens": (soft_hyphens, None),
    "missing_glyphs": (missing_glyphs, "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(text), '')), lambda c: regexp_matches(c, '\\p{L}') AND NOT contains('abcdefghijklmnopqrstuvwxyzäöüß', c))), '') AS missing FROM documents"),
    "font_ladder": (font_ladder, "WITH p AS (SELECT p_partkey, 'Font' || (p_size % 7)::VARCHAR AS font, p_size % 3 AS cls FROM part), own(font) AS (VALUES ('Font1'), ('Font2')), sub(font, s) AS (VALUES ('Font3', 'Sub3')), c(cls, c) AS (VALUES (0, 'Sans'), (1, 'Serif')) SELECT p_partkey, coalesce('own:' || own.font, sub.s, c.c, 'none') AS used FROM p LEFT JOIN own ON own.font = p.font LEFT JOIN sub ON sub.font = p.font LEFT JOIN c ON c.cls = p.cls"),
    "glossary_fingerprint": (glossary_fingerprint, "SELECT c_mktsegment, substr(sha256(string_agg(c_name || '=' || c_nationkey::VARCHAR, '|' ORDER BY c_name || '=' || c_nationkey::VARCHAR)), 1, 12) AS print FROM customer GROUP BY 1"),
    "review_reasons": (review_reasons, f"WITH {TR}, r AS (SELECT doc_id, ord, source, target, len(regexp_extract_all(source, '[0-9]+')) - len(regexp_extract_all(target, '[0-9]+')) AS lost FROM tr) SELECT * FROM (SELECT doc_id, ord, concat_ws('; ', CASE WHEN target = '' THEN 'MISSING' END, CASE WHEN target <> '' AND source = target THEN 'ECHO' END, CASE WHEN target <> '' AND lost > 0 THEN 'NUMBERS|' || lost::VARCHAR END) AS reason FROM r) WHERE reason <> ''"),
    "wrapped_lines": (wrapped_lines_count, None),
    "timeouts": (timeouts, f"WITH {SEG}, g AS (SELECT doc_id, sum(length(text)) AS n FROM seg GROUP BY doc_id) SELECT doc_id, least(900.0::DOUBLE, greatest(30.0::DOUBLE, 10 + n / 40)) AS timeout, least(60, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE doc_id % 100 END)::INT AS delay FROM g"),
    "settings": (settings, "SELECT o_orderkey, least(90000, greatest(1000, floor(CASE WHEN o_orderkey % 5 = 0 THEN 50000 ELSE o_totalprice END)))::INT AS v FROM orders"),
    "piece_rescue": (piece_rescue, PIECE_SQL),
    "glossary_verify": (glossary_verify, f"WITH {TR}, t(term) AS (VALUES ('the'), ('und'), ('que'), ('les')) SELECT term, count(*) AS checked, count(*) FILTER (WHERE contains(' ' || target || ' ', ' ' || term || ' ') OR contains(' ' || target || ' ', ' ' || upper(term) || ' ')) AS honoured FROM tr, t WHERE target <> '' AND contains(' ' || source || ' ', ' ' || term || ' ') GROUP BY term"),
    "off_figures": (off_figures, f"WITH {LAY}, f AS (SELECT doc_id, ord, x1 - x0 AS w, greatest(0.0::DOUBLE, least(x1, 120) - x0, x1 - greatest(x0, 200)) AS free FROM lay) SELECT doc_id, ord, free, free >= 36 AND free >= 0.25::DOUBLE * w AS ok FROM f"),
    "required_expansion": (required_expansion, f"WITH {TR}, {LAY.replace(SEG + ', ', '')}, k AS (SELECT tr.doc_id, tr.ord, length(target) AS n, x1 - x0 AS w, y1 - y0 AS h, unnest(range(5))::INT AS k FROM tr JOIN lay ON tr.doc_id = lay.doc_id AND tr.ord = lay.ord WHERE target <> '') SELECT doc_id, ord, min(k) AS step FROM k WHERE floor(w / 5.5::DOUBLE) * floor(h * (1 + k * 0.25::DOUBLE) / 12) >= n GROUP BY ALL"),
    "splice_edits": (splice_edits, f"WITH {SEG}, e AS (SELECT *, (4 + length(text) % 5)::INT AS a, (5 + length(text) % 5)::INT AS b FROM seg WHERE length(text) >= 30) SELECT doc_id, ord, CASE WHEN b <= 6 THEN substr(text, 1, 2) || '[A]' || substr(text, 7, 4) || '[C]' || substr(text, 15) ELSE substr(text, 1, 2) || '[A]' || substr(text, 7, greatest(0, a - 6)) || '[B]' || substr(text, b + 1, 10 - b) || '[C]' || substr(text, 15) END AS text FROM e"),
    "boxes_to_lines": (boxes_to_lines, None),
    "reading_order": (reading_order, None),
    "wrapped_merge": (wrapped_merge, None),
    "set_operations": (set_operations, "SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'either' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)"),
    "squeezed_lines": (squeezed_lines, f"WITH {LAY}, {OVER} SELECT doc_id, pg, count(*) AS n FROM ov WHERE shared > 0.3::DOUBLE * small AND xa = xb GROUP BY ALL"),
}
