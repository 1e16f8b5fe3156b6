"""Catalogue, part 7: formats, roles by fonts, replies of models, units, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from ..operators import layout as L
from ..sources import formats
from ..sources.tables import LAY, SEG, boxes, segments, table
from .sql import among


def _seg(spark, d):
    return segments(spark, d)


def _lay(spark, d):
    return boxes(segments(spark, d))


def _pick(values, at):
    """The value at a place (from 0, modulo their number)."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


# ---- S1, S2, K1, K7, K8: formats

ENDINGS = ["pdf", "PDF", "epub", "docx", "html", "png", "Jpeg", "txt", "csv", "tar.gz", ""]


def format_dispatch(spark, d):
    """Reader and writer of file names by their ending; unknown endings have none."""
    name = F.concat(F.lit("book."), F.col("o_orderkey").cast("string"), F.lit("."), _pick(ENDINGS, F.col("o_orderkey")))
    o = table(spark, d, "orders").select("o_orderkey", name.alias("name"))
    return o.select("o_orderkey", formats.reader_of(F.col("name")).alias("reader"), formats.writer_of(F.col("name")).alias("writer"), formats.is_supported(F.col("name")).alias("supported"))


def _case(table_, t="e"):
    return "CASE " + " ".join(f"WHEN {t} IN ({among(v)}) THEN '{k}'" for k, v in table_.items()) + " END"


DISPATCH_SQL = f"""WITH e AS (SELECT o_orderkey, lower(split_part([{among(ENDINGS)}][o_orderkey % {len(ENDINGS)} + 1], '.', -1)) AS e FROM orders)
SELECT o_orderkey, {_case(formats.READERS)} AS reader, {_case(formats.WRITERS)} AS writer, e IN ({among(formats.SUPPORTED)}) AS supported FROM e"""


def page_files(spark, d):
    """K7: file names of a document's pages: the first keeps the name, others are numbered from 002."""
    p = _lay(spark, d).select("doc_id", "pg").distinct()
    base = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return p.select("doc_id", "pg", F.when(F.col("pg") == 0, F.concat(base, F.lit(".png"))).otherwise(F.format_string("%s-%03d.png", base, F.col("pg") + 1)).alias("file"))


def dual_pages(spark, d):
    """K8: source and written pages in turn, over the pages that both have (a page without any reply is not written)."""
    lay = _lay(spark, d)
    both = lay.groupBy("doc_id", "pg").agg(F.bool_or(F.col("ord") % 40 > 0).alias("written")).where("written")
    sides = both.select("doc_id", "pg", F.explode(F.array(F.lit("source"), F.lit("written"))).alias("side"))
    return sides.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pg", "side")) - 1)


# ---- S12: styles by rules

RULES = [("p", "", "11pt", 0), ("h2", "", "1.5em", 1), ("", "note", "75%", 2), ("p", "lead", "16px", 3), ("", "lead", "2rem", 4)]
DEFAULTS = {"h1": 24.0, "h2": 18.0, "p": 12.0}


def css_sizes(spark, d):
    """Font sizes in points: inline style, else the first rule that matches tag and class, else the tag's default; em, rem and % of 12 points, a pixel is 0.75."""
    tag, cls = _pick(["p", "h1", "h2", "p", "li"], F.col("ord")), _pick(["", "note", "lead"], F.col("doc_id") + F.col("ord"))
    inline = F.when(F.col("ord") % 13 == 0, F.lit("20px"))
    e = _seg(spark, d).select("doc_id", "ord", tag.alias("tag"), cls.alias("cls"), inline.alias("inline"))
    rules = spark.createDataFrame(RULES, "rtag string, rcls string, size string, k int")
    hit = ((F.col("rtag") == "") | (F.col("rtag") == F.col("tag"))) & ((F.col("rcls") == "") | (F.col("rcls") == F.col("cls")))
    # rules are few, and each task tests its own elements against all of them
    first = e.join(F.broadcast(rules), hit, "left").groupBy("doc_id", "ord", "tag", "cls", "inline").agg(F.min(F.struct("k", "size")).alias("r"))
    default = F.coalesce(*[F.when(F.col("tag") == k, F.lit(v)) for k, v in DEFAULTS.items()], F.lit(12.0))
    return first.select("doc_id", "ord", F.coalesce(R.points(F.coalesce("inline", "r.size")), default).alias("size"))


_UNIT = "CASE WHEN s LIKE '%pt' THEN v WHEN s LIKE '%px' THEN v * 0.75 WHEN s LIKE '%\\%' ESCAPE '\\' THEN v * 0.12 WHEN s LIKE '%em' THEN v * 12 END"
CSS_SQL = f"""WITH {SEG}, e AS (SELECT doc_id, ord, ['p', 'h1', 'h2', 'p', 'li'][ord % 5 + 1] AS tag, ['', 'note', 'lead'][(doc_id + ord) % 3 + 1] AS cls, CASE WHEN ord % 13 = 0 THEN '20px' END AS inl FROM seg),
r(rtag, rcls, size, k) AS (VALUES {", ".join(str(x) for x in RULES)}),
f AS (SELECT doc_id, ord, tag, coalesce(inl, arg_min(size, k)) AS s FROM e LEFT JOIN r ON (rtag = '' OR rtag = tag) AND (rcls = '' OR rcls = cls) GROUP BY doc_id, ord, tag, inl),
n AS (SELECT *, try_cast(regexp_extract(s, '^[0-9.]+') AS DOUBLE) AS v FROM f)
SELECT doc_id, ord, coalesce({_UNIT}, CASE tag WHEN 'h1' THEN 24.0 WHEN 'h2' THEN 18.0 ELSE 12.0 END)::DOUBLE AS size FROM n"""


# ---- S17, K10, K11: glossaries and keyword maps

FORMS = ["json", "csv", "tsv", "semicolon"]


def _glossary_files(spark, d):
    """A file's text for each nation: pairs of customers' names, some twice (later ones win), in one of four forms, half with a header."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("Term "), (F.col("c_custkey") % 97).cast("string")).alias("k"), "c_mktsegment")
    g = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "k", F.col("c_mktsegment").alias("v")))).alias("p"))
    form = _pick(FORMS, F.col("c_nationkey"))
    line = lambda sep: F.array_join(F.transform("p", lambda x: F.concat(x["k"], F.lit(sep), x["v"])), "\n")
    head = lambda sep: F.when(F.col("c_nationkey") % 8 >= 4, F.lit(f"source{sep}target\n")).otherwise("")
    pair = F.transform("p", lambda x: F.concat(F.lit('"'), x["k"], F.lit('": "'), x["v"], F.lit('"')))
    text = F.when(form == "json", F.concat(F.lit("{"), F.array_join(pair, ", "), F.lit("}"))).when(form == "csv", F.concat(head(","), line(","))).when(form == "tsv", F.concat(head("\t"), line("\t"))).otherwise(F.concat(head(";"), line(";")))
    return g.select("c_nationkey", text.alias("text"))


def glossary_source(spark, d):
    """Glossaries read from text: JSON or two columns, the separator told from header or first line, header skipped, later pairs win."""
    return _glossary_files(spark, d).select("c_nationkey", F.explode(R.glossary_pairs(F.col("text"))).alias("source", "target"))


GLOSSARY_SQL = "SELECT c_nationkey, 'Term ' || (c_custkey % 97)::VARCHAR AS source, arg_max(c_mktsegment, c_custkey) AS target FROM customer GROUP BY ALL"


def glossary_sink(spark, d):
    """A glossary as JSON, CSV and TSV text, pairs in the order of their keys."""
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_set(F.struct(F.col("c_nationkey").alias("k"), F.concat(F.lit("n "), F.col("c_nationkey").cast("string")).alias("v")))).alias("p"))
    rows = lambda sep: F.array_join(F.transform("p", lambda x: F.concat(x["k"].cast("string"), F.lit(sep), x["v"])), "\n")
    return g.select("c_mktsegment", F.to_json(F.map_from_entries(F.transform("p", lambda x: F.struct(x["k"].cast("string"), x["v"])))).alias("json"), rows(",").alias("csv"), rows("\t").alias("tsv"))


SINK_SQL = """WITH p AS (SELECT DISTINCT c_mktsegment, c_nationkey AS k FROM customer)
SELECT c_mktsegment, '{' || string_agg('"' || k || '":"n ' || k || '"', ',' ORDER BY k) || '}' AS json, string_agg(k || ',n ' || k, chr(10) ORDER BY k) AS csv, string_agg(k || chr(9) || 'n ' || k, chr(10) ORDER BY k) AS tsv FROM p GROUP BY 1"""


# ---- S21: run registry


def run_registry(spark, d):
    """Each field of a run with the place it came from: recorded, else inferred from the name, else unknown."""
    p = F.get_json_object("props", "$.k")
    recorded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("m"), p))
    inferred = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("from-"), F.col("event_type")))
    value = F.coalesce(recorded, inferred, F.lit("?"))
    origin = F.when(recorded.isNotNull(), "recorded").when(inferred.isNotNull(), "inferred").otherwise("unknown")
    return table(spark, d, "events").select("event_id", value.alias("value"), origin.alias("origin"))


REGISTRY_SQL = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'm' || json_extract_string(props, '$.k') WHEN 1 THEN 'from-' || event_type ELSE '?' END AS value,
CASE event_id % 3 WHEN 0 THEN 'recorded' WHEN 1 THEN 'inferred' ELSE 'unknown' END AS origin FROM events"""


# ---- K13, K14: provenance, reports


def endpoints(spark, d):
    """Addresses without userinfo and key-like parameters."""
    u = F.concat(F.regexp_replace("url", "^(https?://)", "$1user:pw@"), F.when(F.col("page_id") % 2 == 0, F.lit("?api_key=abc&lang=en&Token=1")).otherwise("?page=2&mode=x"), F.when(F.col("page_id") % 5 == 0, F.lit("#top")).otherwise(""))
    return table(spark, d, "pages").select("page_id", R.sanitised(F.when(F.col("page_id") % 7 == 0, F.lit("localhost:1234/v1?key=1")).otherwise(u)).alias("endpoint"))


ENDPOINT_SQL = f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'localhost:1234/v1?key=1' ELSE regexp_replace(url, '^(https?://)', '\\1user:pw@') || CASE WHEN page_id % 2 = 0 THEN '?api_key=abc&lang=en&Token=1' ELSE '?page=2&mode=x' END || CASE WHEN page_id % 5 = 0 THEN '#top' ELSE '' END END AS u FROM pages),
s AS (SELECT page_id, u, split_part(u, '#', 1) AS a FROM u), q AS (SELECT page_id, u, regexp_replace(split_part(a, '?', 1), '^([a-z]+://)[^/]*@', '\\1') AS b, array_to_string(list_filter(string_split(CASE WHEN contains(a, '?') THEN substr(a, strpos(a, '?') + 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '{R.SECRET}')), '&') AS p FROM s)
SELECT page_id, CASE WHEN NOT contains(u, '://') THEN u ELSE b || CASE WHEN p <> '' THEN '?' || p ELSE '' END END AS endpoint FROM q"""


def report_table(spark, d):
    """A markdown row for each event type with counts of four classes of value."""
    e = table(spark, d, "events").withColumn("q", F.concat(F.lit("q"), F.pmod(F.floor("value"), F.lit(4)).cast("string")))
    p = e.groupBy("event_type").pivot("q", ["q0", "q1", "q2", "q3"]).agg(F.count(F.lit(1)))
    cells = [F.coalesce(F.col(q).cast("string"), F.lit("-")) for q in ("q0", "q1", "q2", "q3")]
    return p.select(F.concat(F.lit("| "), F.concat_ws(" | ", "event_type", *cells), F.lit(" |")).alias("row"))


REPORT_SQL = """WITH e AS (SELECT event_type, ((floor(value)::BIGINT % 4) + 4) % 4 AS q FROM events), c AS (SELECT event_type, q, count(*) AS n FROM e GROUP BY ALL)
SELECT '| ' || event_type || ' | ' || concat_ws(' | ', coalesce(max(n) FILTER (WHERE q = 0)::VARCHAR, '-'), coalesce(max(n) FILTER (WHERE q = 1)::VARCHAR, '-'), coalesce(max(n) FILTER (WHERE q = 2)::VARCHAR, '-'), coalesce(max(n) FILTER (WHERE q = 3)::VARCHAR, '-')) || ' |' AS row FROM c GROUP BY event_type"""


# ---- P3, P10, P16, P17, P19, P22: predicates

KEPT_ROLES = ["formula", "code", "figure"]


def translatable(spark, d):
    """Blocks with text whose role is to be translated, by role."""
    t = F.col("text")
    role = F.when(T.is_formula_like(t), "formula").when(T.is_code_like(t), "code").when(F.col("ord") % 23 == 0, "figure").otherwise("body")
    s = _seg(spark, d).withColumn("role", role)
    return s.groupBy("role").agg(F.count_if(~F.col("role").isin(*KEPT_ROLES) & (F.trim("text") != "")).alias("n"), F.count(F.lit(1)).alias("blocks"))


CODE = r"[A-Za-z_]+\(|[a-z]+_[a-z]+|[{};]|=|#|\$|%"
TRANSLATABLE_SQL = f"""WITH {SEG}, r AS (SELECT CASE WHEN len(string_split_regex(trim(text), ' +')) <= 8 AND regexp_matches(text, '[=+*/<>^|]') AND NOT regexp_matches(text, '[.!?]$') THEN 'formula'
  WHEN length(text) <= 300 AND NOT regexp_matches(text, '[.!?]$') AND len(list_filter(string_split_regex(text, ' +'), lambda w: regexp_matches(w, '^\\p{{L}}+[,.]?$'))) < 10 AND regexp_matches(text, '{CODE}') AND length(regexp_replace(text, '[\\p{{L}}\\p{{N}} ]', '', 'g')) / length(text) >= 0.08 THEN 'code'
  WHEN ord % 23 = 0 THEN 'figure' ELSE 'body' END AS role FROM seg) SELECT role, count(*) FILTER (WHERE role = 'body') AS n, count(*) AS blocks FROM r GROUP BY role"""


def page_filter(spark, d):
    """P10: the blocks on the pages that a document's selection names; a document without a selection keeps everything."""
    pages = _lay(spark, d).select("doc_id", "pg").distinct().where((F.col("doc_id") % 3 > 0) & (F.col("pg") % 2 == 0))
    chosen = pages.select("doc_id").distinct().withColumn("some", F.lit(True))
    lay = _lay(spark, d).select("doc_id", "pg", "ord").join(chosen, "doc_id", "left").join(pages.withColumn("hit", F.lit(True)), ["doc_id", "pg"], "left")
    return lay.where(F.col("some").isNull() | F.col("hit")).select("doc_id", "ord")


FONTS = ["NimbusRomNo9L", "CMMI10", "CMR10", "CMSY7", "Courier", "DejaVuSans"]


def _spans(spark, d):
    """Lines as spans of one word; the font of a line's words follows the line's place, one word in five has the next font."""
    words = F.filter(F.split("text", " +"), lambda w: w != "")
    span = lambda w, i: F.struct(w.alias("text"), _pick(FONTS, F.col("ord") + F.when(i % 5 == 4, 1).otherwise(0)).alias("font"))
    return _seg(spark, d).select("doc_id", "ord", F.transform(words, span).alias("spans"))


def equation_blocks(spark, d):
    """Blocks with a math face and no prose face; with the text face of mathematicians only up to 200 characters."""
    font = lambda p: F.exists("spans", lambda s: F.lower(s["font"]).rlike(p))
    chars = F.aggregate("spans", F.lit(0), lambda n, s: n + F.length(s["text"]))
    return _spans(spark, d).where(font("cmmi|cmsy|cmex|msam|msbm") & ~font("nimbus|times|dejavu|courier") & (~font("cmr") | (chars <= 200))).select("doc_id", "ord")


def monospace_blocks(spark, d):
    """Blocks all of whose spans that are not blank have a face of one width."""
    inked = F.filter("spans", lambda s: F.trim(s["text"]) != "")
    return _spans(spark, d).where((F.size(inked) > 0) & F.forall(inked, lambda s: T.font_class(s["font"]) == "monospace")).select("doc_id", "ord")


SPANS = f"""{SEG}, sp AS (SELECT doc_id, ord, w, lower([{among(FONTS)}][(ord + CASE WHEN (i - 1) % 5 = 4 THEN 1 ELSE 0 END) % 6 + 1]) AS font FROM (SELECT doc_id, ord, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, ord, list_filter(string_split_regex(text, ' +'), lambda x: x <> '') AS l FROM seg)))"""


def measured_pair(spark, d):
    """The measurement of a language pair: the exact one; without a source language the only one of the target."""
    pairs = spark.createDataFrame([("en", "tr", 93), ("de", "en", 88), ("fr", "en", 91)], "src string, tgt string, score int")
    ask = table(spark, d, "orders").select("o_orderkey", _pick(["en", "auto", "de", "xx"], F.col("o_orderkey")).alias("src"), _pick(["tr", "en", "fr"], F.col("o_orderkey")).alias("tgt"))
    only = pairs.groupBy("tgt").agg(F.count(F.lit(1)).alias("c"), F.max("score").alias("alone")).where("c = 1")
    found = ask.join(F.broadcast(pairs), ["src", "tgt"], "left").join(F.broadcast(only), "tgt", "left")
    return found.select("o_orderkey", F.coalesce("score", F.when(F.col("src") == "auto", F.col("alone"))).alias("score"))


MEASURED_SQL = """WITH p(src, tgt, score) AS (VALUES ('en', 'tr', 93), ('de', 'en', 88), ('fr', 'en', 91)), a AS (SELECT o_orderkey, ['en', 'auto', 'de', 'xx'][o_orderkey % 4 + 1] AS src, ['tr', 'en', 'fr'][o_orderkey % 3 + 1] AS tgt FROM orders)
SELECT o_orderkey, CASE WHEN src = 'auto' THEN (SELECT CASE WHEN count(*) = 1 THEN max(score) END FROM p WHERE p.tgt = a.tgt) ELSE (SELECT max(score) FROM p WHERE p.src = a.src AND p.tgt = a.tgt) END AS score FROM a"""


def mirrored_runs(spark, d):
    """Runs whose glyphs stand on the wrong side of their baseline: of the first 12 glyphs those with a clear side (0.15) vote. Glyph offsets are the
    first dimensions of vectors, two by two; the direction turns with the row."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dx, dy = _pick([1.0, 0.0, -1.0, 0.6], F.col("vec_id")), _pick([0.0, 1.0, 0.0, 0.8], F.col("vec_id"))
    glyphs = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(F.get("v", 2 * i).alias("x"), F.get("v", 2 * i + 1).alias("y")))
    long = lambda g: F.sqrt(g["x"] * g["x"] + g["y"] * g["y"])
    side = lambda g: (dy * g["x"] - dx * g["y"]) / long(g)
    clear = F.filter(F.transform(F.filter(glyphs, lambda g: long(g) > 1e-9), side), lambda p: F.abs(p) >= 0.15)
    votes = F.aggregate(clear, F.lit(0), lambda n, p: n + F.when(p < 0, 1).otherwise(-1))
    return e.select("vec_id", votes.alias("votes"), (votes > 0).alias("mirrored"))


MIRROR_SQL = """WITH g AS (SELECT vec_id, unnest(range(12)) AS i, embedding AS v, [1.0, 0.0, -1.0, 0.6][vec_id % 4 + 1]::DOUBLE AS dx, [0.0, 1.0, 0.0, 0.8][vec_id % 4 + 1]::DOUBLE AS dy FROM embeddings),
o AS (SELECT vec_id, dx, dy, v[2 * i + 1]::DOUBLE AS x, v[2 * i + 2]::DOUBLE AS y FROM g), p AS (SELECT vec_id, (dy * x - dx * y) / sqrt(x * x + y * y) AS p FROM o WHERE sqrt(x * x + y * y) > 1e-9),
n AS (SELECT vec_id, coalesce(sum(CASE WHEN p < 0 THEN 1 ELSE -1 END) FILTER (WHERE abs(p) >= 0.15), 0)::INT AS votes FROM p GROUP BY vec_id) SELECT vec_id, votes, votes > 0 AS mirrored FROM n"""


# ---- A2-A5, A7, A12, A17: replies, units, colours, profiles


def _wrapped(body, k):
    """What models put around an answer: nothing, a fence, prose, or they break off."""
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return F.when(k == 0, body).when(k == 1, fence).when(k == 2, F.concat(F.lit("Here you are: "), body, F.lit(" Done."))).otherwise(F.expr("left(body, cast(length(body) * 3 / 4 as int))"))


def _word_lists(spark, d):
    words = F.slice(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != ""), 1, 9)
    s = _seg(spark, d).select("doc_id", "ord", words.alias("w")).where("size(w) >= 2")
    return s


def keyword_parse(spark, d):
    """A3: keywords from a reply: a list inside fences or prose, six at most, blank ones out; anything else gives none."""
    s = _word_lists(spark, d).withColumn("body", F.to_json(F.concat("w", F.array(F.lit(" ")))))
    reply = _wrapped(F.col("body"), (F.col("doc_id") + F.col("ord")) % 4)
    return s.select("doc_id", "ord", F.array_join(R.keywords(reply, 6), "|").alias("words")).where("words <> ''")


WORDS9 = f"""{SEG}, w AS (SELECT doc_id, ord, list_filter(string_split_regex(text, '[^\\p{{L}}]+'), lambda x: x <> '')[:9] AS w FROM seg), l AS (SELECT * FROM w WHERE len(w) >= 2)"""


def glossary_parse(spark, d):
    """A4: pairs from a reply: an object inside fences or prose; of a reply that broke off the pairs that are whole, the first of each key."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.lit('"'), F.get("w", i), F.lit('": "'), F.upper(F.get("w", i + 1)), F.lit('"')))
    s = _word_lists(spark, d).withColumn("body", F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('": "'), F.get("w", i), F.lit('"'))), ", "), F.lit("}")))
    del pairs
    reply = _wrapped(F.col("body"), (F.col("doc_id") + F.col("ord")) % 4)
    return s.select("doc_id", "ord", F.array_join(F.transform(R.glossary_reply(reply), lambda x: F.concat(x["term"], F.lit("="), x["value"])), "|").alias("pairs")).where("pairs <> ''")


_BODY = "'{' || array_to_string(list_transform(range(len(w) - 1), lambda i: '\"k' || i || '\": \"' || w[i + 1] || '\"'), ', ') || '}'"
GLOSSARY_PARSE_SQL = f"""WITH {WORDS9}, b AS (SELECT doc_id, ord, w, (doc_id + ord) % 4 AS k, {_BODY} AS body FROM l), r AS (SELECT *, left(body, (length(body) * 3 // 4)::INT) AS cut FROM b)
SELECT * FROM (SELECT doc_id, ord, array_to_string(CASE WHEN k < 3 THEN list_transform(range(len(w) - 1), lambda i: 'k' || i || '=' || w[i + 1])
  ELSE list_transform(regexp_extract_all(cut, '"k[0-9]+": "[^"]*"'), lambda p: regexp_replace(p, '"(k[0-9]+)": "([^"]*)"', '\\1=\\2')) END, '|') AS pairs FROM r) WHERE pairs <> ''"""

LABELS = ["text", "title", "table", "picture", "banner"]


def verdict_parse(spark, d):
    """A5: verdicts from a reply: from the first bracket to the last; items without a number or with an unknown label out, unknown sizes ``same``, the last of a number wins."""
    item = lambda n, j: F.concat(F.lit('{"n": '), n, F.lit(', "label": "'), _pick(LABELS, F.col("ord") + j), F.lit('", "size": "'), _pick(["large", "same", "huge"], F.col("doc_id") + j), F.lit('"}'))
    body = F.concat(F.lit("["), F.array_join(F.array(item(F.lit("1"), 0), item(F.lit("2"), 1), item(F.lit('"x"'), 2), item((F.col("ord") % 3).cast("string"), 3)), ", "), F.lit("]"))
    s = _seg(spark, d).select("doc_id", "ord", body.alias("body"))
    reply = _wrapped(F.col("body"), (F.col("doc_id") + F.col("ord")) % 4)
    return s.select("doc_id", "ord", F.explode(R.verdicts(reply, LABELS[:4], ["large", "same", "small"])).alias("v")).select("doc_id", "ord", "v.n", "v.label", "v.size")


VERDICT_SQL = f"""WITH {SEG}, i AS (SELECT doc_id, ord, unnest([0, 1, 3]) AS j FROM seg WHERE (doc_id + ord) % 4 < 3),
v AS (SELECT doc_id, ord, j, (CASE j WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE ord % 3 END)::INT AS n, [{among(LABELS)}][(ord + j) % 5 + 1] AS label, ['large', 'same', 'same'][(doc_id + j) % 3 + 1] AS size FROM i)
SELECT doc_id, ord, n, arg_max(label, j) AS label, arg_max(size, j) AS size FROM v WHERE label <> 'banner' GROUP BY doc_id, ord, n"""


def unit_conversion(spark, d):
    """Box edges from pixels at 200 dots an inch and from EMU to points."""
    return _lay(spark, d).select("doc_id", "ord", F.round(R.px_to_pt(F.col("x1"), 200.0), 6).alias("from_px"), F.round(R.emu_to_pt(F.col("y1") * 12700), 6).alias("from_emu"))


def two_colours(spark, d):
    """The values of each row in two classes by eight rounds of 2-means from its extremes; the smaller class is the ink."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", R.two_means(v, 8).alias("m")).select("vec_id", F.round("m.paper", 5).alias("paper"), F.round("m.ink", 5).alias("ink"), F.col("m.n_ink").alias("n_ink"))


def _means_sql() -> str:
    steps = ["m0 AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_min(embedding)::DOUBLE AS a, list_max(embedding)::DOUBLE AS b FROM embeddings)"]
    near, far = "list_filter(v, lambda x: abs(x - a) <= abs(x - b))", "list_filter(v, lambda x: abs(x - a) > abs(x - b))"
    for k in range(1, 9):
        steps.append(f"m{k} AS (SELECT vec_id, v, coalesce(list_avg({near}), a) AS a, coalesce(list_avg({far}), b) AS b FROM m{k - 1})")
    return f"WITH {', '.join(steps)}, c AS (SELECT *, len({near}) AS na, len({far}) AS nb FROM m8) SELECT vec_id, round(CASE WHEN na >= nb THEN a ELSE b END, 5) AS paper, round(CASE WHEN na >= nb THEN b ELSE a END, 5) AS ink, least(na, nb)::INT AS n_ink FROM c"


def profile_match(spark, d):
    """The profile all of whose settings an order has; null without one."""
    profiles = spark.createDataFrame([("fast", "o_orderstatus", "F"), ("fast", "o_orderpriority", "1-URGENT"), ("open", "o_orderstatus", "O"), ("calm", "o_orderstatus", "F"), ("calm", "o_orderpriority", "5-LOW")], "profile string, key string, value string")
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("own")) for k in ("o_orderstatus", "o_orderpriority")])).alias("s")).select("o_orderkey", "s.*")
    m = o.join(F.broadcast(profiles), "key").groupBy("o_orderkey", "profile").agg(F.bool_and(F.col("own") == F.col("value")).alias("all"))
    return m.groupBy("o_orderkey").agg(F.min(F.when(F.col("all"), F.col("profile"))).alias("profile"))


PROFILE_SQL = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'calm' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'fast' WHEN o_orderstatus = 'O' THEN 'open' END AS profile FROM orders"


# ---- G30: layout regions


def region_quality(spark, d):
    """Boxes in no region, in several, and regions with one line alone, by document. Regions stand on each page: two columns and a band."""
    lay = _lay(spark, d)
    r = spark.createDataFrame([(1, 40.0, 50.0, 300.0, 200.0), (2, 300.0, 50.0, 560.0, 260.0), (3, 0.0, 90.0, 600.0, 130.0)], "region int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    a = lay.select("doc_id", "pg", "ord", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    # three regions, inlined: every page has the same
    held = a.join(F.broadcast(r), (L.intersection("a", "r") >= 0.5 * L.area("a")), "left").groupBy("doc_id", "pg", "ord").agg(F.count("region").alias("n"), F.min("region").alias("first"))
    per = held.where("first is not null").groupBy("doc_id", "pg", "first").agg(F.count(F.lit(1)).alias("c")).groupBy("doc_id").agg(F.count_if(F.col("c") == 1).alias("fragments"))
    return held.groupBy("doc_id").agg(F.count_if(F.col("n") == 0).alias("orphans"), F.count_if(F.col("n") > 1).alias("shared")).join(per, "doc_id", "left").withColumn("fragments", F.coalesce("fragments", F.lit(0)))


QUALITY_SQL = f"""WITH {LAY}, r(region, rx0, ry0, rx1, ry1) AS (VALUES (1, 40.0::DOUBLE, 50.0::DOUBLE, 300.0::DOUBLE, 200.0::DOUBLE), (2, 300, 50, 560, 260), (3, 0, 90, 600, 130)),
h AS (SELECT doc_id, pg, ord, count(region) AS n, min(region) AS first FROM lay LEFT JOIN r ON greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) >= 0.5::DOUBLE * (x1 - x0) * (y1 - y0) GROUP BY ALL),
f AS (SELECT doc_id, count(*) FILTER (WHERE c = 1) AS fragments FROM (SELECT doc_id, pg, first, count(*) AS c FROM h WHERE first IS NOT NULL GROUP BY ALL) GROUP BY doc_id)
SELECT h.doc_id, count(*) FILTER (WHERE n = 0) AS orphans, count(*) FILTER (WHERE n > 1) AS shared, coalesce(max(fragments), 0) AS fragments FROM h LEFT JOIN f USING (doc_id) GROUP BY h.doc_id"""


def caption_near(spark, d):
    """Narrow boxes within 24 points under a figure of their page (a semi join on page and geometry). Pages have a figure each, at a place of their own."""
    lay = _lay(spark, d)
    top = 60.0 + 14 * ((F.col("doc_id") + F.col("pg")) % 7)
    fig = lay.select("doc_id", "pg").distinct().select("doc_id", "pg", F.lit(50.0).alias("fx0"), top.alias("fy0"), F.lit(290.0).alias("fx1"), (top + 40).alias("fy1"))
    near = (F.least("x1", "fx1") > F.greatest("x0", "fx0")) & (F.col("x1") - F.col("x0") <= 2.5 * (F.col("fx1") - F.col("fx0"))) & (F.col("y0") - F.col("fy1")).between(0, 24)
    a, f = lay.alias("a"), fig.alias("f")
    return a.join(f, (F.col("a.doc_id") == F.col("f.doc_id")) & (F.col("a.pg") == F.col("f.pg")) & near, "left_semi").select("doc_id", "pg", "ord")


QUERIES = {
    "format_dispatch": (format_dispatch, DISPATCH_SQL),
    "page_files": (page_files, f"WITH {LAY} SELECT DISTINCT doc_id, pg, 'doc' || doc_id || CASE WHEN pg = 0 THEN '' ELSE printf('-%03d', pg + 1) END || '.png' AS file FROM lay"),
    "dual_pages": (dual_pages, f"WITH {LAY}, p AS (SELECT doc_id, pg FROM lay GROUP BY ALL HAVING bool_or(ord % 40 > 0)), s AS (SELECT doc_id, pg, unnest(['source', 'written']) AS side FROM p) SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pg, side) - 1)::INT AS place FROM s"),
    "css_sizes": (css_sizes, CSS_SQL),
    "glossary_source": (glossary_source, GLOSSARY_SQL),
    "glossary_sink": (glossary_sink, SINK_SQL),
    "run_registry": (run_registry, REGISTRY_SQL),
    "endpoints": (endpoints, ENDPOINT_SQL),
    "report_table": (report_table, REPORT_SQL),
    "translatable": (translatable, TRANSLATABLE_SQL),
    "page_filter": (page_filter, f"WITH {LAY} SELECT doc_id, ord FROM lay WHERE doc_id % 3 = 0 OR pg % 2 = 0"),
    "equation_blocks": (equation_blocks, f"WITH {SPANS} SELECT doc_id, ord FROM sp GROUP BY ALL HAVING bool_or(regexp_matches(font, 'cmmi|cmsy|cmex|msam|msbm')) AND NOT bool_or(regexp_matches(font, 'nimbus|times|dejavu|courier')) AND (NOT bool_or(contains(font, 'cmr')) OR sum(length(w)) <= 200)"),
    "monospace_blocks": (monospace_blocks, f"WITH {SPANS} SELECT doc_id, ord FROM sp GROUP BY ALL HAVING bool_and(font = 'courier')"),
    "measured_pair": (measured_pair, MEASURED_SQL),
    "mirrored_runs": (mirrored_runs, MIRROR_SQL),
    "keyword_parse": (keyword_parse, f"WITH {WORDS9} SELECT doc_id, ord, array_to_string(w[:6], '|') AS words FROM l WHERE (doc_id + ord) % 4 < 3"),
    "glossary_parse": (glossary_parse, GLOSSARY_PARSE_SQL),
    "verdict_parse": (verdict_parse, VERDICT_SQL),
    "unit_conversion": (unit_conversion, f"WITH {LAY} SELECT doc_id, ord, round(x1 * 72 / 200, 6) AS from_px, round(y1 * 12700 / 12700, 6) AS from_emu FROM lay"),
    "two_colours": (two_colours, _means_sql()),
    "profile_match": (profile_match, PROFILE_SQL),
    "region_quality": (region_quality, QUALITY_SQL),
    "caption_near": (caption_near, f"WITH {LAY}, t AS (SELECT *, 100.0::DOUBLE + 14 * ((doc_id + pg) % 7) AS fy1 FROM lay) SELECT doc_id, pg, ord FROM t WHERE least(x1, 290) > greatest(x0, 50) AND x1 - x0 <= 600 AND y0 - fy1 BETWEEN 0 AND 24"),
}
