"""Shared SQL of the predicates on replies, for the comparison of the catalogue's queries."""

from __future__ import annotations

from ..functions import text as T
from ..sources.tables import TR


def among(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def norm(t: str) -> str:
    """F2."""
    return f"lower(trim(regexp_replace(regexp_replace({t}, '</?[0-9]+>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')))"


def ordinary(t: str) -> str:
    """F4, as a list."""
    plain = f"regexp_replace(regexp_replace(regexp_replace({t}, '\"[^\"]*\"', ' ', 'g'), ' *([/:.]) *', '\\1', 'g'), '[^ ]*[@/][^ ]*', ' ', 'g')"
    return f"list_filter(list_transform(string_split_regex({plain}, ' +'), lambda w: regexp_replace(w, '[^\\p{{L}}]', '', 'g')), lambda w: w <> '' AND w = lower(w) AND w <> upper(w))"


def joined(run: str) -> str:
    return f"CASE WHEN regexp_matches({run}, '{T.GROUPED}') THEN regexp_replace({run}, '[.,]', '', 'g') ELSE {run} END"


def numbers(t: str) -> str:
    """F7 after F8, as a list."""
    t = f"regexp_replace({t}, '</?[0-9]+>', '', 'g')"
    for glyph, digits in T.FRACTIONS.items():
        t = f"replace({t}, '{glyph}', ' {digits[0]} {digits[1]} ')"
    return f"flatten(list_transform(regexp_extract_all({t}, '({T.NUMBER})', 1), lambda r: regexp_extract_all({joined('r')}, '[0-9]+')))"


def lost_sql(table: str, extra: str = "") -> str:
    """CTEs that end in lost(doc_id, ord): replies that lack a number; ``extra`` adds rows of (doc_id, ord, g) that the replies have."""
    count = "SELECT doc_id, ord, g, count(*) AS n FROM ({}) GROUP BY ALL"
    need = count.format(f"SELECT doc_id, ord, unnest({numbers('source')}) AS g FROM {table}")
    have = count.format(f"SELECT doc_id, ord, unnest({numbers('target')}) AS g FROM {table}{extra}")
    return f"need AS ({need}), have AS ({have}), lost AS (SELECT DISTINCT need.doc_id, need.ord FROM need LEFT JOIN have USING (doc_id, ord, g) WHERE coalesce(have.n, 0) < need.n)"


def spelled_sql(table: str, text: str) -> str:
    """CTEs that end in spelled(doc_id, ord, run, value): numbers that texts write in the words of ``lang``, by position: what a unit adds is
    multiplied by each hundred after it; a hundred or thousand with nothing before it counts for one."""
    values = ", ".join(f"('{lg}', '{w}', {n})" for lg in T.CARDINALS for w, n in T.number_words(lg).items())
    words = f"regexp_extract_all(lower(regexp_replace({text}, '</?[0-9]+>', '', 'g')), '(\\p{{L}}+)', 1)"
    run = "PARTITION BY doc_id, ord"
    part = f"{run}, run, sec"
    return f"""vals(lg, word, v) AS (VALUES {values}),
ws AS (SELECT doc_id, ord, lang, unnest({words}) AS word, generate_subscripts({words}, 1) AS i FROM {table}),
wv AS (SELECT ws.doc_id, ws.ord, ws.i, v FROM ws LEFT JOIN vals ON lg = lang AND vals.word = ws.word),
wr AS (SELECT *, sum((v IS NULL)::INT) OVER ({run} ORDER BY i) AS run FROM wv),
wc AS (SELECT *, coalesce(sum((v = 1000)::INT) OVER ({run}, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM wr WHERE v IS NOT NULL),
wh AS (SELECT *, coalesce(sum((v = 100)::INT) OVER ({part} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after,
  coalesce(sum(v) OVER ({part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM wc),
sv AS (SELECT doc_id, ord, run, sec, bool_or(v = 1000) AS thousand, sum(CASE WHEN v = 1000 THEN 0 WHEN v = 100 THEN CASE WHEN before = 0 THEN power(100, after + 1) ELSE 0 END ELSE v * power(100, after) END)::BIGINT AS cur FROM wh GROUP BY ALL),
spelled AS (SELECT doc_id, ord, run, sum(CASE WHEN thousand THEN 1000 * CASE WHEN cur = 0 THEN 1 ELSE cur END ELSE cur END)::BIGINT AS value FROM sv GROUP BY ALL)"""


def wrong_sql(table: str, text: str) -> str:
    """CTEs that end in wrong(doc_id, ord, hits): texts in another language than ``lang``."""
    own = " ".join(f"WHEN lang = '{lg}' THEN len(list_filter(w, lambda x: x IN ({among(ws)})))" for lg, ws in T.FUNCTION_WORDS.items())
    foreign = []
    for lg, ws in T.FUNCTION_WORDS.items():
        for own_lg, own_ws in T.FUNCTION_WORDS.items():
            if lg != own_lg:
                h = f"list_filter(w, lambda x: x IN ({among([x for x in ws if x not in own_ws])}))"
                foreign.append(f"CASE WHEN lang = '{own_lg}' AND len(list_distinct({h})) >= 2 THEN len({h}) END")
    return f"""lw AS (SELECT doc_id, ord, lang, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM {table}),
lh AS (SELECT doc_id, ord, len(w) AS n, CASE {own} END AS own, greatest({', '.join(foreign)}) AS f FROM lw WHERE len(w) >= 6),
wrong AS (SELECT doc_id, ord, f::BIGINT AS hits FROM lh WHERE f / n >= 0.12 AND f > own)"""


GARBLED = """gw AS (SELECT doc_id, ord, source, unnest(string_split_regex(target, '[ \\t\\r\\n]+')) AS w, generate_subscripts(string_split_regex(target, '[ \\t\\r\\n]+'), 1) AS i FROM tr),
gf AS (SELECT *, regexp_matches(w, '\\p{Latin}') AS l, regexp_matches(w, '\\p{Cyrillic}') AS c, regexp_matches(w, '\\p{Greek}') AS g FROM gw),
mixed AS (SELECT doc_id, ord, string_agg(w, ' ' ORDER BY i) AS words FROM gf
  WHERE l::INT + c::INT + g::INT >= 2 AND ((l AND NOT regexp_matches(source, '\\p{Latin}')) OR (c AND NOT regexp_matches(source, '\\p{Cyrillic}')) OR (g AND NOT regexp_matches(source, '\\p{Greek}')))
  GROUP BY doc_id, ord)"""

def judged_sql(base: str) -> str:
    """CTEs that end in judged: every reply of the CTE tr, which ``base`` ends in, with its flags."""
    return f"""{base}, {lost_sql('tr')}, {wrong_sql('tr', 'target')}, {GARBLED},
two AS (SELECT *, {norm('source')} AS ns, {norm('target')} AS nt, {ordinary('source')} AS os, {ordinary('target')} AS ot FROM tr),
judged AS (SELECT two.doc_id, two.ord, two.lang, two.source, two.target, len(os) AS n_words, two.target = '' AS missing, two.target <> '' AND ns <> '' AND ns = nt AS identical, ns <> '' AND ns = nt AS same,
    two.target <> '' AND len(os) >= 4 AND ((ns <> '' AND ns = nt) OR len(list_intersect(list_distinct(os), list_distinct(ot))) > 0.5 * len(list_distinct(os))) AS copy,
    two.target <> '' AND lost.doc_id IS NOT NULL AS numbers, two.target <> '' AND mixed.doc_id IS NOT NULL AS garbled, two.target <> '' AND wrong.doc_id IS NOT NULL AS "foreign"
  FROM two LEFT JOIN lost ON lost.doc_id = two.doc_id AND lost.ord = two.ord LEFT JOIN wrong ON wrong.doc_id = two.doc_id AND wrong.ord = two.ord LEFT JOIN mixed ON mixed.doc_id = two.doc_id AND mixed.ord = two.ord)"""


JUDGED = judged_sql(TR)
