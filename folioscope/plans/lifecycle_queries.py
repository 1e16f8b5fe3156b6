"""Catalogue, part 8: providers and wrappers, glossaries and keyword maps, budgets and the fit ladder, remaining text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments as S
from ..operators import sequential as Q
from ..operators import wrappers as W
from ..sources.tables import LAY, SEG, TR, boxes, replies, segments, table
from .segment_queries import KEY, _terms_sql, term_candidates


def _seg(spark, d):
    return segments(spark, d)


def _tr(spark, d):
    return replies(segments(spark, d))


def _lay(spark, d):
    return boxes(segments(spark, d))


# ---- N1, N6, N9, N17, N18, W2


def provider_contract(spark, d):
    """A provider that loses every 19th request, answers every 23rd twice and invents a reply for each document."""
    tr = _tr(spark, d).select("doc_id", "ord", "source", "target")
    got = tr.where("(doc_id + ord) % 19 > 0")
    got = got.union(got.where("(doc_id + ord) % 23 = 0")).union(tr.where("ord = 0").withColumn("ord", F.lit(-1)))
    return W.contract(tr, got)


CONTRACT_SQL = f"""WITH {TR}, g AS (SELECT doc_id, ord FROM tr WHERE (doc_id + ord) % 19 > 0), r AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE (doc_id + ord) % 23 = 0 UNION ALL SELECT doc_id, -1 FROM tr WHERE ord = 0)
SELECT (SELECT count(*) FROM tr WHERE (doc_id, ord) NOT IN (SELECT (doc_id, ord) FROM r)) AS missing, (SELECT count(*) FROM r WHERE (doc_id, ord) NOT IN (SELECT (doc_id, ord) FROM tr)) AS unasked, (SELECT count(*) FROM (SELECT doc_id, ord FROM r GROUP BY ALL HAVING count(*) > 1)) AS twice"""

ADDED = " see https://example.org/p?a=1 on 2024-05-06, 45% of $1,200"


def _requests(spark, d):
    """Lines with literals; of every sixth line only the number differs."""
    source = F.when(F.col("ord") % 6 == 0, F.concat(F.lit("total of version 1.2."), (F.col("doc_id") % 50).cast("string"), F.lit(" is due today"))).otherwise(F.concat("text", F.lit(ADDED)))
    return _seg(spark, d).select("doc_id", "ord", "lang", source.alias("source"))


def _shout(requests):
    """A provider that writes capitals and, in every seventh document, loses the first token."""
    up = F.translate("source", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lost = F.replace(up, F.lit(f"{T.OPEN}0{T.CLOSE}"), F.lit(""))
    return requests.withColumn("target", F.when(F.col("doc_id") % 7 == 0, lost).otherwise(up))


def protected_replies(spark, d):
    """Replies of a provider that sees tokens instead of literals, with lost tokens and confidence."""
    return W.protected(_shout)(_requests(spark, d)).select("doc_id", "ord", "target", "lost", "confidence")


_ALL = T._ALL.replace("'", "''")
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
REQUESTS = SEG + f""", rq AS (SELECT doc_id, ord, lang, CASE WHEN ord % 6 = 0 THEN 'total of version 1.2.' || (doc_id % 50)::VARCHAR || ' is due today' ELSE text || '{ADDED}' END AS source FROM seg),
rp AS (SELECT *, regexp_extract_all(source, '({_ALL})', 1) AS lits, string_split_regex(source, '{_ALL}') AS parts FROM rq)"""
# parts and literals in turn, parts in capitals; the first literal is gone where the document loses it
PROTECTED_SQL = f"""WITH {REQUESTS}, t AS (SELECT doc_id, ord, lits, doc_id % 7 = 0 AS loses, list_transform(parts, lambda p: {_UP.format('p')}) AS parts FROM rp)
SELECT doc_id, ord, array_to_string(flatten(list_transform(range(len(parts)), lambda i: [parts[i + 1], CASE WHEN i < len(lits) AND NOT (loses AND i = 0) THEN lits[i + 1] ELSE '' END])), '') AS target,
  (CASE WHEN loses AND len(lits) > 0 THEN 1 ELSE 0 END)::INT AS lost, CASE WHEN loses AND len(lits) > 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM t"""


def wrapper_order(spark, d):
    """Requests that reach the provider with the wrappers in their order, by language: lines that differ in values alone are asked once, remembered ones never."""
    requests = _requests(spark, d)
    tokens = requests.withColumn("source", T.protect(F.col("source")))
    known = tokens.where("doc_id % 5 = 0").select(S.memory_key(F.col("source"), F.col("lang"), F.lit("xx"), F.lit("m")).alias("key"), F.col("source").alias("target")).dropDuplicates(["key"])
    asked = {}

    def base(r):
        asked["r"] = r
        return _shout(r)

    W.wrapped(base, known)(requests)
    return asked["r"].groupBy("lang").agg(F.count(F.lit(1)).alias("asked"), F.countDistinct("source").alias("texts"))


ORDER_SQL = f"""WITH {REQUESTS}, t AS (SELECT doc_id, ord, lang, array_to_string(flatten(list_transform(range(len(parts)), lambda i: [CASE WHEN i = 0 THEN '' ELSE chr(57344) || (i - 1)::VARCHAR || chr(57345) END, parts[i + 1]])), '') AS source FROM rp),
n AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM t k WHERE k.doc_id % 5 = 0 AND k.source = t.source AND k.lang = t.lang)), k AS (SELECT *, coalesce({KEY.format(t='source')}, doc_id || ':' || ord) AS key FROM n),
f AS (SELECT key, min((doc_id, ord)) AS f FROM k GROUP BY key) SELECT lang, count(*) AS asked, count(DISTINCT source) AS texts FROM k JOIN f ON f.key = k.key AND f.f = (k.doc_id, k.ord) GROUP BY lang"""


def automatic_glossary(spark, d):
    """The corpus's terms, a model's answers (most of them in another case, some never asked for, some empty), and what is taken of these."""
    terms = term_candidates(spark, d).select("phrase")
    n = F.length("phrase")
    answers = terms.select(F.when(n % 3 == 0, F.upper("phrase")).otherwise(F.concat(F.lit(" "), "phrase")).alias("term"), F.when(n % 5 == 0, "").otherwise(F.reverse("phrase")).alias("value"))
    return W.automatic_glossary(terms, answers.union(spark.createDataFrame([("never asked", "x")], "term string, value string")))


def keyword_map(spark, d):
    """Stretches of a document and the three longest words of each (of equal ones the first by alphabet), as a model's keywords."""
    s = Q.stretches(_seg(spark, d), 40, 1000).join(_seg(spark, d).select("doc_id", "ord", "text"), S.READING)
    words = s.select("doc_id", "grp", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("length(w) >= 4").distinct()
    top = words.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "grp").orderBy(F.desc(F.length("w")), "w"))).where("k <= 3")
    return top.groupBy("doc_id", "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), ", ").alias("words"))


STRETCHES = f"""{SEG}, o AS (SELECT doc_id, ord, text, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM seg WHERE length(text) >= 40),
f AS (SELECT doc_id, ord, i, 0 AS grp, CASE WHEN n >= 1000 THEN 1 ELSE 0 END AS nextg, CASE WHEN n >= 1000 THEN 0 ELSE n END AS run FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.ord, o.i, f.nextg, CASE WHEN f.run + o.n >= 1000 THEN f.nextg + 1 ELSE f.nextg END, CASE WHEN f.run + o.n >= 1000 THEN 0 ELSE f.run + o.n END FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1),
kw AS (SELECT DISTINCT f.doc_id, grp, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS w FROM f JOIN o ON o.doc_id = f.doc_id AND o.ord = f.ord),
km AS (SELECT doc_id, grp, string_agg(w, ', ' ORDER BY k) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY length(w) DESC, w) AS k FROM kw WHERE length(w) >= 4) WHERE k <= 3 GROUP BY ALL)"""


def topic_prefix(spark, d):
    """The line before each segment, after a line that names the topic of the stretch it stands in, if it stands in one."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = _seg(spark, d).select("doc_id", "ord", F.coalesce(F.lag("text").over(w), F.lit("")).alias("before"))
    topic = Q.stretches(_seg(spark, d), 40, 1000).join(keyword_map(spark, d), ["doc_id", "grp"]).select("doc_id", "ord", "words")
    return before.join(topic, S.READING, "left").select("doc_id", "ord", F.concat(F.coalesce(F.concat(F.lit("Topic: "), "words", F.lit("\n")), F.lit("")), "before").alias("context"))


# ---- A9, N19, N20


def prefit_budgets(spark, d):
    """Characters a box holds (lines of 12 points, 5 points a character) and the length to ask for: a tenth less, 8 at least."""
    room = F.floor((F.col("x1") - F.col("x0")) / 5) * F.floor((F.col("y1") - F.col("y0")) / 12)
    return _lay(spark, d).select("doc_id", "ord", room.cast("long").alias("budget"), F.greatest(F.lit(8), F.floor(room * 0.9)).cast("long").alias("max_len"))


def fit_ladder(spark, d):
    """What it takes to fit each reply into its box: nothing, the least of three shrinks down to 0.85, a shorter wording (its first sentence), more text
    where the box is mostly empty, else overflow; with the scale."""
    b = boxes(_tr(spark, d).withColumn("text", F.col("source")), ["target"])
    width, rows = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    holds = lambda scale: F.floor(width / (5 * scale)) * F.floor(rows / (12 * scale))
    b = b.select("doc_id", "ord", F.length("target").alias("n"), F.length(F.split_part("target", F.lit(". "), F.lit(1))).alias("short"), *[holds(s).alias(f"h{k}") for k, s in enumerate((1.0, 0.95, 0.9, 0.85))])
    fits = [F.col("n") <= F.col(f"h{k}") for k in range(4)]
    layer = F.when(fits[0] & (F.col("n") < 0.3 * F.col("h0")), "longer").when(fits[0], "as-is").when(fits[1] | fits[2] | fits[3], "shrink").when(F.col("short") <= F.col("h3"), "shorter").otherwise("overflow")
    scale = F.when(fits[0], 1.0).when(fits[1], 0.95).when(fits[2], 0.9).otherwise(0.85)
    return b.select("doc_id", "ord", layer.alias("layer"), scale.alias("scale"))


_HOLDS = [f"floor((x1 - x0) / (5 * {s}::DOUBLE)) * floor((y1 - y0) / (12 * {s}::DOUBLE)) AS h{k}" for k, s in enumerate(("1.0", "0.95", "0.9", "0.85"))]
LADDER_SQL = f"""WITH {TR}, b AS (SELECT doc_id, ord, target, x0, y0, (x0 + least(240.0::DOUBLE, 5.0 * length(source)))::DOUBLE AS x1, (y0 + 12.0 * ceil(length(source) / 48))::DOUBLE AS y1 FROM (SELECT *, (50 + 260.0 * (ord % 2))::DOUBLE AS x0, (60 + 14.0 * floor((ord % 40) / 2))::DOUBLE AS y0 FROM tr)),
h AS (SELECT doc_id, ord, length(target) AS n, length(split_part(target, '. ', 1)) AS short, {", ".join(_HOLDS)} FROM b)
SELECT doc_id, ord, CASE WHEN n <= h0 AND n < 0.3::DOUBLE * h0 THEN 'longer' WHEN n <= h0 THEN 'as-is' WHEN n <= h1 OR n <= h2 OR n <= h3 THEN 'shrink' WHEN short <= h3 THEN 'shorter' ELSE 'overflow' END AS layer,
  (CASE WHEN n <= h0 THEN 1.0 WHEN n <= h1 THEN 0.95 WHEN n <= h2 THEN 0.9 ELSE 0.85 END)::DOUBLE AS scale FROM h"""


# ---- F13/F14/G21 in SQL, F17, F18, O3, W16


def _kind(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({x}, '{p}') THEN '{k}'" for k, p in T.LITERALS) + " END"


def plain_original(spark, d):
    """the text a block had before its reply, without markers; blocks that never had one show their own."""
    had = F.when(F.col("ord") % 3 > 0, F.concat(F.lit("<0>"), "source", F.lit("</0>"))).otherwise("")
    return _tr(spark, d).select("doc_id", "ord", T.strip_markers(F.coalesce(F.nullif(had, F.lit("")), "target")).alias("text"))


def term_tokens(spark, d):
    """words with a mark for those that end in an apostrophe and letters, by document: how many, and how many marked."""
    t = F.regexp_replace("text", r"(\p{L}{2}) (\p{L}{1,2}) ", "$1's $2 ")
    word = r"(\p{L}+)('\p{L}+)?"
    s = _seg(spark, d).select("doc_id", "ord", F.regexp_extract_all(t, F.lit(word), F.lit(1)).alias("w"), F.transform(F.regexp_extract_all(t, F.lit(word), F.lit(2)), lambda x: x != "").alias("s"))
    return s.select("doc_id", "ord", F.size("w").alias("n"), F.size(F.filter("s", lambda x: x)).alias("suffixed"), F.array_join(F.transform(F.filter(F.zip_with("w", "s", lambda a, b: F.struct(a.alias("w"), b.alias("s"))), lambda x: x["s"]), lambda x: x["w"]), " ").alias("which"))


TOKENS_SQL = f"""WITH {SEG}, t AS (SELECT doc_id, ord, regexp_replace(text, '(\\p{{L}}{{2}}) (\\p{{L}}{{1,2}}) ', '\\1''s \\2 ', 'g') AS t FROM seg), w AS (SELECT doc_id, ord, regexp_extract_all(t, '(\\p{{L}}+)(''\\p{{L}}+)?') AS w FROM t)
SELECT doc_id, ord, len(w)::INT AS n, len(list_filter(w, lambda x: contains(x, '''')))::INT AS suffixed, array_to_string(list_transform(list_filter(w, lambda x: contains(x, '''')), lambda x: split_part(x, '''', 1)), ' ') AS which FROM w"""

TERMS = ["the", "of the", "in the", "and", "que", "der", "les", "los"]


def longest_first(spark, d):
    """The glossary terms of each line, the longest first, of equal length by alphabet."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    t = S.terms_in(_seg(spark, d), terms, 2).groupBy("doc_id", "ord").agg(F.collect_set("term").alias("t"))
    ranked = F.array_sort(F.transform("t", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return t.select("doc_id", "ord", F.array_join(F.transform(ranked, lambda x: x["x"]), "|").alias("terms"))


LONGEST_SQL = f"""WITH {SEG}, w AS (SELECT doc_id, ord, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS w FROM seg), t(term) AS (VALUES {", ".join(f"('{t}')" for t in TERMS)})
SELECT doc_id, ord, string_agg(term, '|' ORDER BY length(term) DESC, term) AS terms FROM w JOIN t ON contains(w, ' ' || term || ' ') GROUP BY ALL"""


def rejoined_words(spark, d):
    """The words of a page's lines, one that ends a line in a letter and a hyphen joined with the first of the next line, also over several lines; a fifth of
    the lines end so. Words are told by their place; every joined word stands at its last part."""
    text = F.when(F.col("ord") % 5 == 1, F.concat(F.regexp_replace("text", r"[^\p{L}]+$", ""), F.lit("-"))).when(F.col("ord") % 5 == 2, F.concat(F.regexp_extract("text", r"^(\p{L}+)", 1), F.lit("-"))).otherwise(F.col("text"))
    s = _seg(spark, d).select("doc_id", F.floor(F.col("ord") / 40).cast("int").alias("pg"), "ord", F.filter(F.split(text, " +"), lambda w: w != "").alias("w"))
    line = s.select("doc_id", "pg", "ord", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    w = Window.partitionBy("doc_id", "pg").orderBy("ord", "i")
    carries = (F.col("i") == F.col("n") - 1) & F.col("word").rlike(r"\p{L}-$") & F.lead("word").over(w).isNotNull()
    # a run of carried words and the one after them make one word
    marked = line.withColumn("carries", carries).withColumn("before", F.coalesce(F.lag("carries").over(w), F.lit(False)))
    runs = marked.withColumn("run", F.sum(F.when(F.col("before"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("carries"), F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
    joined = runs.groupBy("doc_id", "pg", "run").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "i", part.alias("p")))), lambda x: x["p"]), "").alias("word"))
    return joined.where("k > 1").select("doc_id", "pg", "run", "word")


REJOINED_SQL = f"""WITH {SEG}, t AS (SELECT doc_id, floor(ord / 40)::INT AS pg, ord, CASE ord % 5 WHEN 1 THEN regexp_replace(text, '[^\\p{{L}}]+$', '') || '-' WHEN 2 THEN regexp_extract(text, '^(\\p{{L}}+)', 1) || '-' ELSE text END AS text FROM seg),
l AS (SELECT doc_id, pg, ord, list_filter(string_split_regex(text, ' +'), lambda x: x <> '') AS w FROM t), e AS (SELECT doc_id, pg, ord, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM l),
c AS (SELECT *, i = n AND regexp_matches(word, '\\p{{L}}-$') AND lead(word) OVER x IS NOT NULL AS carries FROM e WINDOW x AS (PARTITION BY doc_id, pg ORDER BY ord, i)),
b AS (SELECT *, coalesce(lag(carries) OVER x, false) AS before FROM c WINDOW x AS (PARTITION BY doc_id, pg ORDER BY ord, i)),
r AS (SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pg ORDER BY ord, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT doc_id, pg, run::BIGINT AS run, string_agg(CASE WHEN carries THEN left(word, length(word) - 1) ELSE word END, '' ORDER BY ord, i) AS word FROM r GROUP BY doc_id, pg, run HAVING count(*) > 1"""


# ---- made-up inputs replaced by computed ones


def nested_terms(spark, d):
    """Of the corpus's terms those that a longer one with the same count holds are dropped; a term meets the longer ones through their words."""
    stop = sorted({x for ws in T.FUNCTION_WORDS.values() for x in ws})
    t = S.phrases(_seg(spark, d), stop).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    longer = t.where(F.contains("phrase", F.lit(" "))).select(F.col("phrase").alias("long"), "n")
    parts = longer.select("long", "n", F.split("long", " ").alias("w"))
    inside = parts.select("n", F.explode(F.array_compact(F.array(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.when(F.size("w") == 3, F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))), F.when(F.size("w") == 3, F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))))))).alias("phrase")).distinct()
    return t.join(inside, ["phrase", "n"], "left_anti")


NESTED_SQL = _terms_sql().split("g AS (SELECT phrase")[0] + "t AS (SELECT phrase, count(*) AS n FROM p WHERE lower(split_part(phrase, ' ', 1)) NOT IN ({stop}) AND lower(split_part(phrase, ' ', -1)) NOT IN ({stop}) AND length(phrase) >= 4 GROUP BY phrase HAVING count(*) >= 5), l AS (SELECT phrase AS long, n, unnest(string_split(phrase, ' ')) AS w FROM t WHERE contains(phrase, ' ')) SELECT phrase, n FROM t a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.w = split_part(a.phrase, ' ', 1) AND l.n = a.n AND l.long <> a.phrase AND contains(' ' || l.long || ' ', ' ' || a.phrase || ' '))".replace("{stop}", ", ".join(f"'{x}'" for x in sorted({x for ws in T.FUNCTION_WORDS.values() for x in ws})))


def _marked(spark, d):
    """Sources with markers around their first words; replies keep, swap, drop or double them by the hash of the line."""
    first = F.split_part("source", F.lit(" "), F.lit(1))
    rest = F.expr("substring(source, length(split_part(source, ' ', 1)) + 1, 2000)")
    h = F.pmod(F.length("source") + F.col("ord") * 3, F.lit(5))
    s = F.concat(F.lit("<0>"), first, F.lit("</0>"), rest)
    t = F.when(h == 0, F.concat(first, rest)).when(h == 1, F.concat(F.lit("</0>"), first, F.lit("<0>"), rest)).when(h == 2, F.concat(s, F.lit("<1>"))).otherwise(s)
    return _tr(spark, d).select("doc_id", "ord", s.alias("source"), t.alias("target"))


def marker_multiset(spark, d):
    """Replies whose markers are not those of the source, as multisets."""
    all_of = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("(</?[0-9]+>)"), F.lit(1)))
    return _marked(spark, d).where(all_of(F.col("source")) != all_of(F.col("target"))).select("doc_id", "ord")


_SRC = "'<0>' || split_part(source, ' ', 1) || '</0>' || substring(source, length(split_part(source, ' ', 1)) + 1, 2000)"
MARKER_SQL = f"""WITH {TR}, m AS (SELECT doc_id, ord, {_SRC} AS s, CASE (length(source) + ord * 3) % 5 WHEN 0 THEN split_part(source, ' ', 1) || substring(source, length(split_part(source, ' ', 1)) + 1, 2000) WHEN 1 THEN '</0>' || split_part(source, ' ', 1) || '<0>' || substring(source, length(split_part(source, ' ', 1)) + 1, 2000) WHEN 2 THEN {_SRC} || '<1>' ELSE {_SRC} END AS t FROM tr)
SELECT doc_id, ord FROM m WHERE list_sort(regexp_extract_all(s, '</?[0-9]+>')) <> list_sort(regexp_extract_all(t, '</?[0-9]+>'))"""


def invented_tags(spark, d):
    """Tags of the reply that the source lacks, in their order."""
    tags = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(</?[a-z0-9]+>)"), F.lit(1)))
    return _marked(spark, d).select("doc_id", "ord", F.array_join(F.array_except(tags(F.concat("target", F.when(F.length("target") % 4 == 0, F.lit(" <b>x</b><b>")).otherwise(""))), tags(F.col("source"))), "").alias("tags")).where("tags <> ''")


INVENTED_SQL = f"""WITH {TR}, m AS (SELECT doc_id, ord, {_SRC} AS s, CASE (length(source) + ord * 3) % 5 WHEN 0 THEN split_part(source, ' ', 1) || substring(source, length(split_part(source, ' ', 1)) + 1, 2000) WHEN 1 THEN '</0>' || split_part(source, ' ', 1) || '<0>' || substring(source, length(split_part(source, ' ', 1)) + 1, 2000) WHEN 2 THEN {_SRC} || '<1>' ELSE {_SRC} END AS t FROM tr),
e AS (SELECT doc_id, ord, tag, min(i) AS i FROM (SELECT doc_id, ord, unnest(regexp_extract_all(u, '</?[a-z0-9]+>')) AS tag, generate_subscripts(regexp_extract_all(u, '</?[a-z0-9]+>'), 1) AS i FROM (SELECT doc_id, ord, t || CASE WHEN length(t) % 4 = 0 THEN ' <b>x</b><b>' ELSE '' END AS u FROM m)) GROUP BY ALL)
SELECT e.doc_id, e.ord, string_agg(tag, '' ORDER BY i) AS tags FROM e JOIN m ON m.doc_id = e.doc_id AND m.ord = e.ord WHERE NOT list_contains(regexp_extract_all(s, '</?[a-z0-9]+>'), tag) GROUP BY ALL"""


def data_only(spark, d):
    """P4 over cells: lines as they are, their digits and punctuation alone, and their numbers."""
    cells = F.array(F.col("text"), F.regexp_replace("text", r"\p{L}+", ""), F.concat("ord", F.lit(" %")))
    c = _seg(spark, d).select("doc_id", "ord", F.posexplode(cells).alias("cell", "text"))
    return c.where(T.is_data_only(F.col("text"))).select("doc_id", "ord", "cell")


def dead_settings(spark, d):
    """Declared keys that nothing refers to: customers' names against the numbers that orders refer to."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return c.join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


def prompts(spark, d):
    """Batches of eight segments as JSON, with only the glossary terms that stand in the batch."""
    s = _seg(spark, d).withColumn("b", F.floor(F.col("ord") / 8).cast("int"))
    g = s.groupBy("doc_id", "b").agg(F.array_sort(F.collect_list(F.struct("ord", F.regexp_replace("text", r'[\\"/\x00-\x1f]', "").alias("text")))).alias("items"))
    have = F.filter(F.array(*[F.lit(x) for x in ("the", "und", "que", "les")]), lambda t: F.exists("items", lambda i: F.contains(i["text"], t)))
    return g.select("doc_id", "b", F.size("items").alias("n"), F.array_join(have, ",").alias("terms"), F.to_json("items").alias("request"))


PROMPTS_SQL = f"""WITH {SEG}, s AS (SELECT doc_id, ord, floor(ord / 8)::INT AS b, regexp_replace(text, '[\\\\"/\\x00-\\x1f]', '', 'g') AS t FROM seg),
g AS (SELECT doc_id, b, count(*)::INT AS n, string_agg(t, chr(10)) AS t, '[' || string_agg('{{"ord":' || ord || ',"text":"' || t || '"}}', ',' ORDER BY ord) || ']' AS request FROM s GROUP BY ALL)
SELECT doc_id, b, n, concat_ws(',', CASE WHEN contains(t, 'the') THEN 'the' END, CASE WHEN contains(t, 'und') THEN 'und' END, CASE WHEN contains(t, 'que') THEN 'que' END, CASE WHEN contains(t, 'les') THEN 'les' END) AS terms, request FROM g"""

WRAP_SQL = f"""WITH RECURSIVE {SEG}, w AS (SELECT doc_id, ord, list_transform(list_filter(string_split_regex(text, ' +'), lambda x: x <> ''), lambda x: length(x)) AS w FROM seg),
f AS (SELECT doc_id, ord, w, 1 AS i, 0::BIGINT AS lines, 0::BIGINT AS p FROM w
  UNION ALL SELECT doc_id, ord, w, i + 1, CASE WHEN lines > 0 AND p + 1 + w[i] <= 60 THEN lines ELSE lines + 1 END, CASE WHEN lines > 0 AND p + 1 + w[i] <= 60 THEN p + 1 + w[i] ELSE w[i] END FROM f WHERE i <= len(w))
SELECT doc_id, ord, lines::INT AS lines FROM f WHERE i = len(w) + 1"""

CEILING_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id % 5 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, 1 AS size, 64 AS cap FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT o.user_id, o.i, CASE WHEN o.ok THEN least(s.size + 1, s.cap) ELSE greatest(1, least(s.cap, s.size - 1)) END, CASE WHEN o.ok THEN s.cap ELSE greatest(1, least(s.cap, s.size - 1)) END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT user_id, arg_max(size, i) AS size, arg_max(cap, i) AS cap FROM s GROUP BY user_id"""

ISLANDS_SQL = f"""WITH {LAY}, g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, pg, x0 ORDER BY y0, ord) AS gap FROM lay), m AS (SELECT doc_id, pg, quantile_cont(gap, 0.5) FILTER (WHERE gap > 0) AS mid, quantile_cont(y1 - y0, 0.5) AS line FROM g GROUP BY ALL),
n AS (SELECT g.doc_id, g.pg, g.ord, g.x0, g.y0, CASE WHEN gap >= greatest(coalesce(mid, 0) * 3, line / 2) THEN 1 ELSE 0 END AS new FROM g JOIN m ON m.doc_id = g.doc_id AND m.pg = g.pg)
SELECT doc_id, pg, ord, sum(new) OVER (PARTITION BY doc_id, pg, x0 ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS paragraph FROM n"""

_LIT = " see https://example.org/a?b=1 or mail x.y@example.org on 2024-05-06 at 12:30, v1.2.3, 45% of $1,200 {name} file_name 0xFF"
PROTECT_SQL = f"""WITH {SEG}, t AS (SELECT doc_id, ord, regexp_extract_all(text || '{_LIT}', '({_ALL})', 1) AS l FROM seg)
SELECT doc_id, ord, len(l)::INT AS n, true AS same, (len(l) > 0)::INT AS lost, array_to_string(list_sort(list_distinct(list_transform(l, lambda x: {_kind('x')}))), ',') AS kinds FROM t"""
KINDS_SQL = f"WITH {SEG}, t AS (SELECT unnest(regexp_extract_all(text, '({_ALL})', 1)) AS x FROM seg) SELECT {_kind('x')} AS kind, count(*) AS n FROM t GROUP BY 1"

#: SQL of queries that stand in other parts.
MORE_SQL = {"wrapped_lines": WRAP_SQL, "adaptive_ceiling": CEILING_SQL, "paragraph_islands": ISLANDS_SQL, "protect_roundtrip": PROTECT_SQL, "literal_kinds": KINDS_SQL}

QUERIES = {
    "provider_contract": (provider_contract, CONTRACT_SQL),
    "protected_replies": (protected_replies, PROTECTED_SQL),
    "wrapper_order": (wrapper_order, ORDER_SQL),
    "automatic_glossary": (automatic_glossary, f"SELECT phrase, reverse(phrase) AS value FROM ({_terms_sql()}) WHERE length(phrase) % 5 <> 0"),
    "keyword_map": (keyword_map, f"WITH RECURSIVE {STRETCHES} SELECT * FROM km"),
    "topic_prefix": (topic_prefix, f"WITH RECURSIVE {STRETCHES}, b AS (SELECT doc_id, ord, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY ord), '') AS b FROM seg) SELECT b.doc_id, b.ord, coalesce('Topic: ' || words || chr(10), '') || b AS context FROM b LEFT JOIN (SELECT f.doc_id, f.ord, words FROM f JOIN km ON km.doc_id = f.doc_id AND km.grp = f.grp) t ON t.doc_id = b.doc_id AND t.ord = b.ord"),
    "prefit_budgets": (prefit_budgets, f"WITH {LAY}, r AS (SELECT doc_id, ord, floor((x1 - x0) / 5) * floor((y1 - y0) / 12) AS room FROM lay) SELECT doc_id, ord, room::BIGINT AS budget, greatest(8, floor(room * 0.9::DOUBLE))::BIGINT AS max_len FROM r"),
    "fit_ladder": (fit_ladder, LADDER_SQL),
    "plain_original": (plain_original, f"WITH {TR} SELECT doc_id, ord, regexp_replace(CASE WHEN ord % 3 > 0 THEN source ELSE target END, '</?[0-9]+>', '', 'g') AS text FROM tr"),
    "term_tokens": (term_tokens, TOKENS_SQL),
    "longest_first": (longest_first, LONGEST_SQL),
    "rejoined_words": (rejoined_words, REJOINED_SQL),
    "nested_terms": (nested_terms, NESTED_SQL),
    "marker_multiset": (marker_multiset, MARKER_SQL),
    "invented_tags": (invented_tags, INVENTED_SQL),
    "data_only": (data_only, f"WITH {SEG}, c AS (SELECT doc_id, ord, unnest([0, 1, 2])::INT AS cell, unnest([text, regexp_replace(text, '\\p{{L}}+', '', 'g'), ord || ' %']) AS t FROM seg) SELECT doc_id, ord, cell FROM c WHERE trim(t) <> '' AND NOT regexp_matches(t, '\\p{{L}}')"),
    "dead_settings": (dead_settings, "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "prompts": (prompts, PROMPTS_SQL),
}
