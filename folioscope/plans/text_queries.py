"""Catalogue, part 1: scans, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import PAIRS, SEG, TR, chat_pairs, replies, segments, spread, table
from .sql import GARBLED, joined, lost_sql, numbers, spelled_sql, wrong_sql

CODE = r"[A-Za-z_]+\(|[a-z]+_[a-z]+|[{};]|=|#|\$|%"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _among(words):
    return lambda w: w.isin(*words)


def _seg(spark, d):
    return segments(spark, d)


def seg_flatten(spark, d):
    return _seg(spark, d)


def job_estimate(spark, d):
    """G1: segments, characters, input tokens with one neighbour of context, output tokens, half-even rounding."""
    per_token = F.when(F.col("lang") == "en", 4.0).when(F.col("lang") == "de", 3.5).otherwise(3.75)
    g = _seg(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text").cast("long")).alias("chars"))
    return g.select("lang", "segments", "chars", F.bround(F.col("chars") / per_token).cast("long").alias("tokens_in"), F.bround(F.col("chars") * 0.931 / 2.5).cast("long").alias("tokens_out"))


def role_histogram(spark, d):
    """G4 over roles told from the line itself."""
    t = F.col("text")
    role = F.when(T.is_bibliography_heading(t), "bibliography").when(T.is_data_only(t), "data").when(T.is_formula_like(t), "formula").when(F.length(t) <= 40, "label").otherwise("body")
    return _seg(spark, d).groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


def checked_blocks(spark, d):
    return _seg(spark, d).groupBy("lang").agg(F.sum(T.is_checked(F.col("text")).cast("long")).alias("checked"), F.count(F.lit(1)).alias("n"))


def page_range_parse(spark, d):
    """P7 over specs made from orders: "a-b, c" with reversed and out-of-range parts."""
    spec = F.concat((F.col("o_orderkey") % 17).cast("string"), F.lit("-"), (F.col("o_custkey") % 13).cast("string"), F.lit(", "), (F.col("o_orderkey") % 29).cast("string"), F.lit(", x"))
    o = table(spark, d, "orders").select("o_orderkey", spec.alias("spec"))
    part = o.select("o_orderkey", F.explode(F.split("spec", ",")).alias("part")).select("o_orderkey", F.trim("part").alias("part")).where(F.col("part").rlike("^[0-9]+(-[0-9]+)?$"))
    a, b = F.split_part("part", F.lit("-"), F.lit(1)).cast("int"), F.split_part("part", F.lit("-"), F.lit(-1)).cast("int")
    pages = part.select("o_orderkey", F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("page"))
    return pages.where("page between 1 and 20").distinct()


def page_range_format(spark, d):
    """The shortest text of a page set, by gaps and islands."""
    from pyspark.sql import Window

    p = page_range_parse(spark, d)
    i = p.withColumn("g", F.col("page") - F.row_number().over(Window.partitionBy("o_orderkey").orderBy("page"))).groupBy("o_orderkey", "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    return i.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", part.alias("t")))), lambda x: x["t"]), ", ").alias("spec"))


PAGES_SQL = """spec AS (SELECT o_orderkey, (o_orderkey % 17)::VARCHAR || '-' || (o_custkey % 13)::VARCHAR || ', ' || (o_orderkey % 29)::VARCHAR || ', x' AS spec FROM orders),
part AS (SELECT o_orderkey, trim(p) AS part FROM (SELECT o_orderkey, unnest(string_split(spec, ',')) AS p FROM spec) WHERE regexp_matches(trim(p), '^[0-9]+(-[0-9]+)?$')),
ab AS (SELECT o_orderkey, split_part(part, '-', 1)::INTEGER AS a, split_part(part, '-', -1)::INTEGER AS b FROM part),
pages AS (SELECT DISTINCT o_orderkey, page::INTEGER AS page FROM (SELECT o_orderkey, unnest(range(least(a, b), greatest(a, b) + 1)) AS page FROM ab) WHERE page BETWEEN 1 AND 20)"""


def scalar_text(spark, d):
    """F1, F2, F24, F25, F30 on every reply."""
    t = F.col("target")
    return replies(_seg(spark, d)).select(
        "doc_id", "ord", T.strip_markers(F.concat(F.lit("<0>"), t, F.lit("</0>"))).alias("plain"), T.normalised(t).alias("norm"), T.clean_reply(F.concat(F.lit("<b>"), t, F.lit("</b><br/>"))).alias("clean"),
        T.xml_safe(t).alias("xml"), T.preview(t).alias("preview"),
    )


SCALAR_SQL = f"""WITH {TR}
SELECT doc_id, ord, target AS plain, lower(trim(regexp_replace(regexp_replace(target, '</?[0-9]+>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS norm,
  trim(regexp_replace(target || ' ', '[ \\t\\r\\n]+', ' ', 'g')) AS clean,
  replace(replace(replace(target, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml,
  CASE WHEN length(target) > 100 THEN substr(target, 1, 97) || '...' ELSE target END AS preview FROM tr"""


def content_words(spark, d):
    return _seg(spark, d).select("doc_id", "ord", F.size(T.content_words(F.col("text"))).cast("long").alias("n"))


def ordinary_words(spark, d):
    return _seg(spark, d).select("doc_id", "ord", F.array_join(T.ordinary_words(F.col("text")), " ").alias("words"))


ORDINARY = """array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({t}, '"[^"]*"', ' ', 'g'), ' *([/:.]) *', '\\1', 'g'), '[^ ]*[@/][^ ]*', ' ', 'g'), ' +'), lambda w: regexp_replace(w, '[^\\p{{L}}]', '', 'g')), lambda w: w <> '' AND w = lower(w) AND w <> upper(w)), ' ')"""


def digit_groups(spark, d):
    """F7 after F8, with a fraction glyph on every fifth line."""
    return _fractions(spark, d).select("doc_id", "ord", F.array_join(T.numbers_needed(F.col("t")), ",").alias("groups")).where("groups <> ''")


def _fractions(spark, d):
    t = F.when(F.col("ord") % 5 == 0, F.concat("source", F.lit(" 1½ <2>⅞</2>"))).otherwise(F.col("source"))
    return replies(_seg(spark, d)).select("doc_id", "ord", t.alias("t"))


FRACTIONS_SQL = f"""WITH {TR}, t AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 0 THEN source || ' 1½ <2>⅞</2>' ELSE source END AS t FROM tr)
SELECT * FROM (SELECT doc_id, ord, array_to_string({numbers('t')}, ',') AS groups FROM t) WHERE groups <> ''"""


def _figures(spark, d):
    """Lines with a large number that is grouped with either separator, a decimal and a section number."""
    n = F.format_number(F.col("doc_id") * 7919 + F.col("ord") * 13 + 5, 0)
    grouped = F.when(F.col("ord") % 2 == 0, n).otherwise(F.replace(n, F.lit(","), F.lit(".")))
    return _seg(spark, d).select("doc_id", "ord", "lang", "text", F.concat("text", F.lit(" "), grouped, F.lit(", 3.14 and 5.2.1")).alias("source"))


FIGURES = SEG + """, figs AS (SELECT doc_id, ord, lang, text, text || ' ' || CASE WHEN ord % 2 = 0 THEN format('{:,}', doc_id * 7919 + ord * 13 + 5) ELSE replace(format('{:,}', doc_id * 7919 + ord * 13 + 5), ',', '.') END || ', 3.14 and 5.2.1' AS source FROM seg)"""


def joined_thousands(spark, d):
    """F8."""
    return _figures(spark, d).select("doc_id", "ord", T.joined_thousands(F.col("source")).alias("joined"))


JOINED_SQL = f"""WITH {FIGURES}, p AS (SELECT doc_id, ord, string_split_regex(source, '{T.NUMBER}') AS p, list_transform(regexp_extract_all(source, '({T.NUMBER})', 1), lambda r: {joined('r')}) AS r FROM figs)
SELECT doc_id, ord, array_to_string(flatten(list_transform(list_zip(p, r), lambda x: [x[1], coalesce(x[2], '')])), '') AS joined FROM p"""


def drops_numbers(spark, d):
    """F10/O10/L6 on the replies."""
    return replies(_seg(spark, d)).where((F.col("target") != "") & T.drops_numbers(F.col("source"), F.col("target"), F.lit("xx"))).select("doc_id", "ord")


def _spelled(spark, d):
    """Sources with a grouped number and a small one; replies write the first without separators and the second in words, in digits, wrong or not at all."""
    small = F.col("ord") % 11
    word = F.coalesce(*[F.when(F.col("lang") == lg, F.get(F.array(*[F.lit(w) for w in T.CARDINALS[lg].split()]), small.cast("int"))) for lg in T.FUNCTION_WORDS])
    k = (F.col("doc_id") + F.col("ord")) % 4
    ending = F.when(k == 0, word).when(k == 1, small.cast("string")).when(k == 2, (small + 1).cast("string")).otherwise("")
    big = (F.col("doc_id") * 7919 + F.col("ord") * 13 + 5).cast("string")
    return _figures(spark, d).select("doc_id", "ord", "lang", F.concat("source", F.lit(" ("), small.cast("string"), F.lit(")")).alias("source"), F.concat("text", F.lit(" "), big, F.lit(", 3,14; 5.2.1 ("), ending, F.lit(")")).alias("target"))


def drops_spelled(spark, d):
    """F8, F9 and F10 together: numbers that the reply has neither in digits nor in its language's words."""
    return _spelled(spark, d).where(T.drops_numbers(F.col("source"), F.col("target"), F.col("lang"))).select("doc_id", "ord")


_WORD = "CASE lang " + " ".join(f"WHEN '{lg}' THEN [{_list(T.CARDINALS[lg].split())}][ord % 11 + 1]" for lg in T.FUNCTION_WORDS) + " END"
SPELLED_TABLE = f"""{FIGURES}, sp AS (SELECT doc_id, ord, lang, source || ' (' || (ord % 11)::VARCHAR || ')' AS source, text || ' ' || (doc_id * 7919 + ord * 13 + 5)::VARCHAR || ', 3,14; 5.2.1 (' ||
  CASE (doc_id + ord) % 4 WHEN 0 THEN {_WORD} WHEN 1 THEN (ord % 11)::VARCHAR WHEN 2 THEN (ord % 11 + 1)::VARCHAR ELSE '' END || ')' AS target FROM figs)"""
DROPS_SPELLED_SQL = f"WITH {SPELLED_TABLE}, {spelled_sql('sp', 'target')}, {lost_sql('sp', ' UNION ALL SELECT doc_id, ord, value::VARCHAR FROM spelled')} SELECT * FROM lost"


def spelled_numbers(spark, d):
    """F9 over the lines of the corpus, each with a spelled number of its own at the end."""
    lines = _spelled(spark, d).select("doc_id", "ord", "lang", F.concat("target", F.coalesce(*[F.when(F.col("lang") == lg, F.lit(x)) for lg, x in LARGE.items()])).alias("t"))
    return lines.select("doc_id", "ord", F.array_join(T.spelled_numbers(F.col("t"), F.col("lang")), ",").alias("numbers")).where("numbers <> ''")


#: Spelled numbers with hundreds and thousands; another word ends each.
LARGE = {
    "en": " two thousand five hundred twenty one, thousand; nineteen hundred seven and third", "de": " zweitausend fünfhundert einundzwanzig, tausend; neunzehn hundert sieben und dritte",
    "fr": " deux mille cinq cent vingt, mille; trois cent sept et troisième", "es": " dos mil quinientos, mil cien veintiuno; tres mil cien siete y tercero",
}
SPELLED_SQL = f"""WITH {SPELLED_TABLE}, big AS (SELECT doc_id, ord, lang, target || CASE lang {" ".join(f"WHEN '{lg}' THEN '{x}'" for lg, x in LARGE.items())} END AS t FROM sp), {spelled_sql('big', 't')}
SELECT doc_id, ord, string_agg(value::VARCHAR, ',' ORDER BY run) AS numbers FROM spelled GROUP BY doc_id, ord"""


def predicates(spark, d):
    """P11-P15 counted by language."""
    t = F.col("text")
    flags = {"heading": T.is_bibliography_heading(t), "citation": T.is_citation(t), "code": T.is_code_like(t), "formula": T.is_formula_like(t), "label": T.is_prose_label(t)}
    return _seg(spark, d).groupBy("lang").agg(*[F.sum(v.cast("long")).alias(k) for k, v in flags.items()])


_LEN = "length(text)"
PREDICATES_SQL = f"""WITH {SEG}, f AS (SELECT lang, text,
  trim(regexp_replace(regexp_replace(lower(text), '^[0-9ivx.]+[ )]+', ''), '[:.]+$', '')) IN ({_list(T.HEADINGS)}) AS heading,
  length(text) >= 15 AND (regexp_matches(text, '^\\[[0-9]+\\]|^[0-9]+\\. [A-Z][a-z]+, [A-Z]\\.') OR
    regexp_matches(text, '\\([12][0-9]{{3}}[a-z]?\\)|, [12][0-9]{{3}}')::INT + regexp_matches(text, '(?i)doi|arxiv|isbn|https?:')::INT + regexp_matches(text, '(?i)pp?\\. ?[0-9]+|vol\\.|no\\.')::INT
    + regexp_matches(text, '[A-Z][a-z]+, [A-Z]\\.')::INT + regexp_matches(text, '(?i)et al|press|journal|proceedings')::INT >= 2) AS citation,
  length(text) <= 300 AND NOT regexp_matches(text, '[.!?]$') AND len(list_filter(string_split_regex(text, ' +'), lambda w: regexp_matches(w, '^\\p{{L}}+[,.]?$'))) < 10
    AND regexp_matches(text, '{CODE}') AND length(regexp_replace(text, '[\\p{{L}}\\p{{N}} ]', '', 'g')) / length(text) >= 0.08 AS code,
  len(string_split_regex(trim(text), ' +')) <= 8 AND regexp_matches(text, '[=+*/<>^|]') AND NOT regexp_matches(text, '[.!?]$') AS formula FROM seg)
SELECT lang, sum(heading::BIGINT)::BIGINT AS heading, sum(citation::BIGINT)::BIGINT AS citation, sum(code::BIGINT)::BIGINT AS code, sum(formula::BIGINT)::BIGINT AS formula,
  sum((len(string_split_regex(trim(text), ' +')) >= 2 AND NOT code AND len(list_filter(string_split_regex(trim(text), ' +'), lambda w: NOT (length(w) <= 4 AND w = upper(w)))) > 0)::BIGINT)::BIGINT AS label
FROM f GROUP BY lang"""


def pieces(spark, d):
    """sentence pieces, and whether they join to the line again."""
    s = _seg(spark, d).select("doc_id", "ord", "text", T.pieces(F.col("text")).alias("p")).where("size(p) > 0")
    return s.select("doc_id", "ord", F.posexplode("p").alias("k", "piece"))


PIECES_SQL = f"""WITH {SEG}, p AS (SELECT doc_id, ord, string_split(regexp_replace(text, '([.!?;:]) +', '\\1' || chr(10), 'g'), chr(10)) AS p FROM seg)
SELECT doc_id, ord, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS k, unnest(p) AS piece FROM p
WHERE len(p) BETWEEN 2 AND 12 AND len(list_filter(p, lambda x: len(string_split_regex(trim(x), ' +')) < 2)) = 0"""


def even_leaders(spark, d):
    """F22."""
    t = F.concat(F.substring("text", 1, 20), F.repeat(F.lit("."), (F.col("ord") % 9 + 1).cast("int")), F.col("ord").cast("string"))
    return _seg(spark, d).select("doc_id", "ord", T.even_leaders(t, F.lit(40)).alias("line"))


def leading_label(spark, d):
    """labels of several forms on every line; replies keep them, lose them or have another."""
    n, k = F.col("ord") % 100, F.col("ord") % 5
    mark = F.when(k == 0, F.concat((n + 1).cast("string"), F.lit(") "))).when(k == 1, F.concat(F.lit("("), n.cast("string"), F.lit(") "))).when(k == 2, F.lit("- ")).when(k == 3, F.lit("• ")).otherwise("")
    src = F.concat(mark, F.col("text"))
    return _seg(spark, d).select("doc_id", "ord", T.with_leading_label(src, F.when((F.col("doc_id") + F.col("ord")) % 2 == 0, F.col("text")).otherwise(src)).alias("fixed"))


LABEL_SQL = f"""WITH {SEG}, s AS (SELECT doc_id, ord, text, CASE ord % 5 WHEN 0 THEN (ord % 100 + 1)::VARCHAR || ') ' WHEN 1 THEN '(' || (ord % 100)::VARCHAR || ') ' WHEN 2 THEN '- ' WHEN 3 THEN '• ' ELSE '' END || text AS src FROM seg),
r AS (SELECT *, CASE WHEN (doc_id + ord) % 2 = 0 THEN text ELSE src END AS reply, regexp_extract(src, '^(\\(?[0-9a-z]{{1,3}}[.)]|[-*•]) ', 1) AS label FROM s)
SELECT doc_id, ord, CASE WHEN label <> '' AND NOT starts_with(reply, label) THEN label || ' ' || reply ELSE reply END AS fixed FROM r"""


def protect_roundtrip(spark, d):
    """literals found, tokenised and put back; lost tokens after one is dropped."""
    t = F.concat(F.col("text"), F.lit(" see https://example.org/a?b=1 or mail x.y@example.org on 2024-05-06 at 12:30, v1.2.3, 45% of $1,200 {name} file_name 0xFF"))
    s = _seg(spark, d).select("doc_id", "ord", t.alias("t")).withColumn("found", T.literals(F.col("t"))).withColumn("safe", T.protect(F.col("t")))
    dropped = F.replace(F.col("safe"), F.concat(F.lit(T.OPEN), F.lit("0"), F.lit(T.CLOSE)), F.lit(""))
    return s.select("doc_id", "ord", F.size("found").alias("n"), (T.restore(F.col("safe"), F.col("found")) == F.col("t")).alias("same"), T.lost_tokens(dropped, F.col("found")).alias("lost"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",").alias("kinds"))


def literal_kinds(spark, d):
    """Counts by kind over the corpus."""
    return _seg(spark, d).select(F.explode(T.literals(F.col("text"))).alias("x")).groupBy(F.col("x.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def copies(spark, d):
    """F5/F6/N15 on chat pairs and replies."""
    s, t = F.col("source"), F.col("target")
    return chat_pairs(table(spark, d, "conversations")).select("conv_id", "turn", T.identical(s, t).alias("same"), F.size(F.array_intersect(F.array_distinct(T.ordinary_words(s)), F.array_distinct(T.ordinary_words(t)))).cast("long").alias("shared"), T.is_copy(s, t).alias("is_copy"))


COPIES_SQL = f"""WITH {PAIRS}, n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(source, '</?[0-9]+>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS ns, lower(trim(regexp_replace(regexp_replace(target, '</?[0-9]+>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS nt,
  list_filter(string_split({ORDINARY.format(t='source')}, ' '), lambda x: x <> '') AS os, list_filter(string_split({ORDINARY.format(t='target')}, ' '), lambda x: x <> '') AS ot FROM pairs)
SELECT conv_id, turn, ns <> '' AND ns = nt AS same, len(list_intersect(list_distinct(os), list_distinct(ot)))::BIGINT AS shared,
  len(os) >= 4 AND ((ns <> '' AND ns = nt) OR len(list_intersect(list_distinct(os), list_distinct(ot))) / len(list_distinct(os)) > 0.5) AS is_copy FROM n"""


def language_guess(spark, d):
    """Hits of function words by language; the most hits win, ties go to the first in order."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.function_words_in(F.coalesce("text", F.lit(""))).alias("f"))
    hits = [F.struct(T.hits_of(F.col("f"), lg).alias("n"), F.lit(-i).alias("i"), F.lit(lg).alias("lang")) for i, lg in enumerate(T.FUNCTION_WORDS)]
    return docs.select("doc_id", F.array_max(F.array(*hits)).alias("b")).select("doc_id", F.when(F.col("b.n") > 0, F.col("b.lang")).alias("guess"), F.col("b.n").cast("long").alias("hits"))


def _guess_sql() -> str:
    words = "string_split_regex(lower(text), '[^\\p{L}]+')"
    hit = ", ".join(f"len(list_filter(w, lambda x: x IN ({_list(ws)})))::BIGINT AS h{i}" for i, ws in enumerate(T.FUNCTION_WORDS.values()))
    top = f"greatest({', '.join(f'h{i}' for i in range(len(T.FUNCTION_WORDS)))})"
    case = " ".join(f"WHEN h{i} = {top} THEN '{lg}'" for i, lg in enumerate(T.FUNCTION_WORDS))
    return f"WITH w AS (SELECT doc_id, {words} AS w FROM documents), h AS (SELECT doc_id, {hit} FROM w) SELECT doc_id, CASE WHEN {top} = 0 THEN NULL {case} END AS guess, {top} AS hits FROM h"


def wrong_language(spark, d):
    """F11 on the lines of the corpus against the language of their document."""
    s = _seg(spark, d).where(T.wrong_language(F.col("text"), F.col("lang")))
    return s.select("doc_id", "ord", T.foreign_hits(T.function_words_in(F.col("text")), F.col("lang")).cast("long").alias("hits"))


def garbled(spark, d):
    """F12/L9."""
    g = T.garbled_words(F.col("source"), F.col("target"))
    return replies(_seg(spark, d)).select("doc_id", "ord", F.array_join(g, " ").alias("words")).where("words <> ''")


GARBLED_SQL = f"WITH {TR}, {GARBLED} SELECT * FROM mixed"


def codes_and_fonts(spark, d):
    """F26, F27, S1/S2 on names made from the star schema."""
    p = table(spark, d, "part")
    names = F.array(*[F.lit(x) for x in ("ABCDEF+Courier-Bold", "Times New Roman", "XYZABC+Helvetica", "BrushScript", "Unknown", "DejaVuSansMono")])
    codes = F.array(*[F.lit(x) for x in ("en-US", "DE", "auto", "pt_BR", "", "fr")])
    i = (F.col("p_partkey") % 6 + 1).cast("int")
    return p.select("p_partkey", T.font_class(F.element_at(names, i)).alias("font"), T.lang_code(F.element_at(codes, i)).alias("code"))


CODES_SQL = """WITH p AS (SELECT p_partkey, lower(regexp_replace(['ABCDEF+Courier-Bold', 'Times New Roman', 'XYZABC+Helvetica', 'BrushScript', 'Unknown', 'DejaVuSansMono'][p_partkey % 6 + 1], '^([A-Z]{6}\\+)+', '')) AS n, ['en-US', 'DE', 'auto', 'pt_BR', '', 'fr'][p_partkey % 6 + 1] AS c FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(n, 'mono|courier|consol|typewriter') THEN 'monospace' WHEN regexp_matches(n, 'script|hand|brush') THEN 'script' WHEN regexp_matches(n, 'sans|arial|helvet|verdana|calibri') THEN 'sans'
  WHEN regexp_matches(n, 'serif|times|roman|georgia|garamond') THEN 'serif' ELSE 'unknown' END AS font, CASE lower(split_part(replace(c, '_', '-'), '-', 1)) WHEN 'auto' THEN '' ELSE lower(split_part(replace(c, '_', '-'), '-', 1)) END AS code FROM p"""

NORM = "lower(trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g')))"

QUERIES = {
    "seg_flatten": (seg_flatten, f"WITH {SEG} SELECT * FROM seg"),
    "job_estimate": (job_estimate, f"WITH {SEG}, g AS (SELECT lang, count(*) AS segments, sum(length(text))::BIGINT AS chars FROM seg GROUP BY lang) SELECT lang, segments, chars, round_even(chars / CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 3.5::DOUBLE ELSE 3.75::DOUBLE END, 0)::BIGINT AS tokens_in, round_even(chars * 0.931::DOUBLE / 2.5::DOUBLE, 0)::BIGINT AS tokens_out FROM g"),
    "role_histogram": (role_histogram, f"""WITH {SEG} SELECT CASE WHEN trim(regexp_replace(regexp_replace(lower(text), '^[0-9ivx.]+[ )]+', ''), '[:.]+$', '')) IN ({_list(T.HEADINGS)}) THEN 'bibliography' WHEN NOT regexp_matches(text, '\\p{{L}}') THEN 'data'
        WHEN len(string_split_regex(trim(text), ' +')) <= 8 AND regexp_matches(text, '[=+*/<>^|]') AND NOT regexp_matches(text, '[.!?]$') THEN 'formula' WHEN length(text) <= 40 THEN 'label' ELSE 'body' END AS role, count(*) AS n FROM seg GROUP BY 1"""),
    "checked_blocks": (checked_blocks, f"WITH {SEG} SELECT lang, sum((regexp_matches(text, '\\p{{L}}') AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.3)::BIGINT)::BIGINT AS checked, count(*) AS n FROM seg GROUP BY lang"),
    "page_range_parse": (page_range_parse, f"WITH {PAGES_SQL} SELECT * FROM pages"),
    "page_range_format": (page_range_format, f"""WITH {PAGES_SQL}, i AS (SELECT o_orderkey, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY o_orderkey ORDER BY page) AS g FROM pages) GROUP BY o_orderkey, g)
        SELECT o_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS spec FROM i GROUP BY o_orderkey"""),
    "scalar_text": (scalar_text, SCALAR_SQL),
    "content_words": (content_words, f"WITH {SEG} SELECT doc_id, ord, len(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')))::BIGINT AS n FROM seg"),
    "ordinary_words": (ordinary_words, f"WITH {SEG} SELECT doc_id, ord, {ORDINARY.format(t='text')} AS words FROM seg"),
    "digit_groups": (digit_groups, FRACTIONS_SQL),
    "joined_thousands": (joined_thousands, JOINED_SQL),
    "drops_numbers": (drops_numbers, f"WITH {TR}, {lost_sql('tr')} SELECT lost.* FROM lost JOIN tr USING (doc_id, ord) WHERE target <> ''"),
    "drops_spelled": (drops_spelled, DROPS_SPELLED_SQL),
    "spelled_numbers": (spelled_numbers, SPELLED_SQL),
    "predicates": (predicates, PREDICATES_SQL),
    "pieces": (pieces, PIECES_SQL),
    "even_leaders": (even_leaders, f"""WITH {SEG}, t AS (SELECT doc_id, ord, substr(text, 1, 20) || repeat('.', ord % 9 + 1) || ord::VARCHAR AS t FROM seg),
        p AS (SELECT *, regexp_extract(t, '^(.*?)\\.{{3,}}(.*)$', 1) AS a, regexp_extract(t, '^(.*?)\\.{{3,}}(.*)$', 2) AS b FROM t)
        SELECT doc_id, ord, CASE WHEN regexp_matches(t, '\\.{{3,}}') THEN a || repeat('.', greatest(3, 40 - length(a) - length(b))) || b ELSE t END AS line FROM p"""),
    "leading_label": (leading_label, LABEL_SQL),
    "protect_roundtrip": (protect_roundtrip, None),
    "literal_kinds": (literal_kinds, None),
    "copies": (copies, COPIES_SQL),
    "language_guess": (language_guess, _guess_sql()),
    "wrong_language": (wrong_language, f"WITH {SEG}, {wrong_sql('seg', 'text')} SELECT * FROM wrong"),
    "garbled": (garbled, GARBLED_SQL),
    "codes_and_fonts": (codes_and_fonts, CODES_SQL),
}
