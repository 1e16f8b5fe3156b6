"""Catalogue, part 3: boxes, reading order, audit, input and output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import pages as P
from ..sources import html as H
from ..sources.tables import LAY, SEG, boxes, segments, table


def _lay(spark, d):
    return boxes(segments(spark, d))


def box_overlap(spark, d):
    return L.overlaps(_lay(spark, d)).select("doc_id", "pg", "a_ord", "b_ord", F.round("shared", 3).alias("shared"))


OVERLAP = """ov AS (SELECT a.doc_id, a.pg, a.ord AS a_ord, b.ord AS b_ord, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.pg = b.pg AND a.ord < b.ord)"""


def _regions(spark, lay):
    """Stand-in regions: a page's columns and halves."""
    r = spark.createDataFrame([(1, 40.0, 50.0, 300.0, 700.0), (2, 300.0, 50.0, 560.0, 700.0), (3, 0.0, 0.0, 600.0, 200.0)], "region int, x0 double, y0 double, x1 double, y1 double")
    return lay.select("doc_id", "pg").distinct().join(F.broadcast(r))


def box_owner(spark, d):
    lay = _lay(spark, d)
    return L.owners(lay, _regions(spark, lay))


OWNER_SQL = f"""WITH {LAY}, r(region, rx0, ry0, rx1, ry1) AS (VALUES (1, 40.0::DOUBLE, 50.0::DOUBLE, 300.0::DOUBLE, 700.0::DOUBLE), (2, 300, 50, 560, 700), (3, 0, 0, 600, 200))
SELECT doc_id, pg, ord, arg_min(region, ((rx1 - rx0) * (ry1 - ry0), region)) AS region FROM lay, r
WHERE greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) >= 0.5::DOUBLE * (x1 - x0) * (y1 - y0) GROUP BY doc_id, pg, ord"""


def free_below(spark, d):
    return L.free_below(_lay(spark, d), 80.0)


def free_right(spark, d):
    return L.free_right(_lay(spark, d), 120.0)


def _free_sql(kind: str, limit: float) -> str:
    lo, hi, a, b = ("y0", "y1", "x0", "x1") if kind == "below" else ("x0", "x1", "y0", "y1")
    return f"""WITH {LAY} SELECT a.doc_id, a.pg, a.ord, least({limit}::DOUBLE, coalesce(min(b.{lo} - a.{hi}), {limit}::DOUBLE)) AS room FROM lay a LEFT JOIN lay b ON a.doc_id = b.doc_id AND a.pg = b.pg AND a.ord <> b.ord AND b.{lo} >= a.{hi} AND b.{a} < a.{b} AND a.{a} < b.{b} GROUP BY a.doc_id, a.pg, a.ord"""


def column_reflow(spark, d):
    """W22 with a growth of a third of each box's height, in whole points."""
    return L.reflow(_lay(spark, d), F.floor((F.col("y1") - F.col("y0")) / 3).cast("double"), 400.0)


REFLOW_SQL = f"""WITH {LAY}, g AS (SELECT *, floor((y1 - y0) / 3)::DOUBLE AS grow FROM lay)
SELECT a.doc_id, a.pg, a.ord, coalesce(sum(b.grow), 0)::DOUBLE AS shift, a.y1 + coalesce(sum(b.grow), 0) > 400 AS past FROM g a LEFT JOIN g b ON a.doc_id = b.doc_id AND a.pg = b.pg AND b.ord < a.ord
  AND (least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.4::DOUBLE * least(a.x1 - a.x0, b.x1 - b.x0) OR abs(a.x0 - b.x0) <= 20) GROUP BY a.doc_id, a.pg, a.ord, a.y1"""


def _spaced(lay):
    """The boxes with room between them: one line in three is moved down by its number of characters."""
    down = F.when(F.col("ord") % 3 == 0, F.length("text").cast("double")).otherwise(0.0)
    return lay.withColumn("y0", F.col("y0") + down).withColumn("y1", F.col("y1") + down)


def interval_gaps(spark, d):
    """W4."""
    return L.gaps(_spaced(_lay(spark, d)), 1.0)


GAPS_SQL = f"""WITH {LAY}, m AS (SELECT doc_id, pg, ord, y0 + CASE WHEN ord % 3 = 0 THEN length(text)::DOUBLE ELSE 0 END AS y0, y1 + CASE WHEN ord % 3 = 0 THEN length(text)::DOUBLE ELSE 0 END AS y1 FROM lay),
g AS (SELECT doc_id, pg, y0, max(y1) OVER (PARTITION BY doc_id, pg ORDER BY y0, y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m)
SELECT doc_id, pg, max(y0 - reach) AS gap, arg_max(reach, (y0 - reach, -reach)) AS gap_from FROM g WHERE y0 - reach > 1 GROUP BY doc_id, pg"""


def union_area(spark, d):
    return L.union_area(_lay(spark, d)).select("doc_id", "pg", F.round("covered", 2).alias("covered"))


UNION_SQL = f"""WITH {LAY}, e AS (SELECT DISTINCT doc_id, pg, x FROM (SELECT doc_id, pg, x0 AS x FROM lay UNION ALL SELECT doc_id, pg, x1 FROM lay)), s AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, pg ORDER BY x) AS t FROM e),
i AS (SELECT s.doc_id, s.pg, s.x, s.t, l.y0, l.y1, max(l.y1) OVER (PARTITION BY s.doc_id, s.pg, s.x ORDER BY l.y0, l.y1, l.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN lay l ON l.doc_id = s.doc_id AND l.pg = s.pg AND l.x0 <= s.x AND l.x1 >= s.t WHERE s.t IS NOT NULL)
SELECT doc_id, pg, round(sum(greatest(0, y1 - greatest(y0, coalesce(reach, y0))) * (t - x)), 2) AS covered FROM i GROUP BY doc_id, pg"""


def paragraph_islands(spark, d):
    return L.paragraphs(_lay(spark, d))


def xy_cut(spark, d):
    return P.xy_cut(_lay(spark, d))


def table_grid(spark, d):
    return P.table_grid(_lay(spark, d))


def nms(spark, d):
    """J17 over the boxes and, on every page, one that holds the first column; the score is the text's length."""
    lay = _lay(spark, d).withColumn("score", F.length("text").cast("double")).drop("text")
    wide = lay.where("x0 < 300").groupBy("doc_id", "pg").agg(F.lit(100000).alias("ord"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))], F.lit(1000.0).alias("score"))
    return P.greedy_nms(lay.unionByName(wide), 0.3)


def closure_reach(spark, d):
    """K4: what the blocks at every fifth place reach over overlapping boxes."""
    lay = _lay(spark, d)
    return P.closure(L.overlaps(lay), lay.where("ord % 5 = 0"))


CLOSURE_SQL = f"""WITH RECURSIVE {LAY}, {OVERLAP}, p AS (SELECT doc_id, pg, a_ord AS a, b_ord AS b FROM ov WHERE shared > 0.3::DOUBLE * small), e AS (SELECT doc_id, pg, a, b FROM p UNION ALL SELECT doc_id, pg, b, a FROM p),
r AS (SELECT doc_id, pg, ord FROM lay WHERE ord % 5 = 0 UNION SELECT e.doc_id, e.pg, e.b FROM r JOIN e ON e.doc_id = r.doc_id AND e.pg = r.pg AND e.a = r.ord) SELECT * FROM r"""


def lines_to_paragraphs(spark, d):
    """W11."""
    return P.paragraphs(_lay(spark, d))


def _wide_blocks(lay):
    return lay.withColumn("block", F.floor(F.col("ord") / 6).cast("int"))


def side_by_side(spark, d):
    """W13 over blocks of six lines; every ninth line ends in a hyphen and its successor starts in lower case."""
    lay = _wide_blocks(_lay(spark, d))
    return P.side_by_side(lay.withColumn("text", F.when(F.col("ord") % 9 == 0, F.concat("text", F.lit("a-"))).when(F.col("ord") % 9 == 1, F.lower("text")).otherwise(F.col("text"))))


def side_rows(spark, d):
    """W14."""
    return P.side_rows(_lay(spark, d))


def table_cells(spark, d):
    """W19 with a rule across the first column at y 130."""
    lay = _lay(spark, d)
    rules = lay.select("doc_id", "pg").distinct().select("doc_id", "pg", F.lit(40.0).alias("x0"), F.lit(130.0).alias("y0"), F.lit(300.0).alias("x1"))
    return P.table_cells(lay, rules)


def region_blocks(spark, d):
    """Lines go to their region, and a region's lines make one block: its box, its lines in order; lines of no region stay blocks of their own."""
    return _region_blocks(spark, d).select("doc_id", "pg", "block", "x0", "y0", "x1", "y1", "n", "text")


def _region_blocks(spark, d):
    lay = _lay(spark, d)
    own = lay.join(L.owners(lay, _regions(spark, lay)), ["doc_id", "pg", "ord"], "left").withColumn("block", F.coalesce("region", F.col("ord") + 10))
    g = own.groupBy("doc_id", "pg", "block").agg(*[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))], F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    return g.withColumn("text", F.array_join(F.transform("l", lambda x: x["text"]), " "))


REGION_SQL = f"""WITH {LAY}, r(region, rx0, ry0, rx1, ry1) AS (VALUES (1, 40.0::DOUBLE, 50.0::DOUBLE, 300.0::DOUBLE, 700.0::DOUBLE), (2, 300, 50, 560, 700), (3, 0, 0, 600, 200)),
o AS (SELECT doc_id, pg, ord, arg_min(region, ((rx1 - rx0) * (ry1 - ry0), region)) AS region FROM lay, r
  WHERE greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) >= 0.5::DOUBLE * (x1 - x0) * (y1 - y0) GROUP BY doc_id, pg, ord)
SELECT lay.doc_id, lay.pg, coalesce(region, lay.ord + 10)::INT AS block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, string_agg(text, ' ' ORDER BY lay.ord) AS text
FROM lay LEFT JOIN o ON o.doc_id = lay.doc_id AND o.pg = lay.pg AND o.ord = lay.ord GROUP BY 1, 2, 3"""


def block_order(spark, d):
    """The blocks of regions in reading order, cut at the page's own line height."""
    line = _lay(spark, d).groupBy("doc_id", "pg").agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("line"))
    return P.block_order(_region_blocks(spark, d).withColumnRenamed("block", "ord").join(line, ["doc_id", "pg"]))


def alignment(spark, d):
    """Alignment of each page's column from its edges."""
    g = _lay(spark, d).groupBy("doc_id", "pg", "x0").agg(F.count(F.lit(1)).alias("n"), (F.max("x1") - F.min("x1")).alias("spread"))
    return g.select("doc_id", "pg", "x0", F.when(F.col("n") < 2, "single").when(F.col("spread") <= 9, "justify").otherwise("left").alias("align"))


def layout_losses(spark, d):
    """Boxes past the page's edges, and overlapping boxes, by page."""
    lay = _lay(spark, d)
    off = lay.where((F.col("x1") > 545) | (F.col("y1") > 340)).groupBy("doc_id", "pg").agg(F.count(F.lit(1)).alias("off"))
    over = L.overlaps(lay).groupBy("doc_id", "pg").agg(F.count(F.lit(1)).alias("over"))
    return off.join(over, ["doc_id", "pg"], "full").select("doc_id", "pg", F.coalesce("off", F.lit(0)).alias("l4"), F.coalesce("over", F.lit(0)).alias("l7"))


def moved_text(spark, d):
    """Source boxes with no written box of the same text within a tolerance; the written page is moved down by a point, every seventh line by 20."""
    lay = _lay(spark, d)
    out = lay.select("doc_id", "pg", "text", (F.col("y0") + F.when(F.col("ord") % 7 == 0, 20.0).otherwise(1.0)).alias("oy"), F.col("x0").alias("ox"))
    near = (F.abs(F.col("y0") - F.col("oy")) <= F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) / 2)) & (F.abs(F.col("x0") - F.col("ox")) <= 6)
    a, o = lay.alias("a"), out.alias("o")
    return a.join(o, (F.col("a.doc_id") == F.col("o.doc_id")) & (F.col("a.pg") == F.col("o.pg")) & (F.col("a.text") == F.col("o.text")) & near, "left_anti").select("doc_id", "pg", "ord")


MOVED_SQL = f"""WITH {LAY} SELECT doc_id, pg, ord FROM lay a WHERE NOT EXISTS (SELECT 1 FROM lay o WHERE o.doc_id = a.doc_id AND o.pg = a.pg AND o.text = a.text
  AND abs(a.y0 - (o.y0 + CASE WHEN o.ord % 7 = 0 THEN 20 ELSE 1 END)) <= greatest(1, (a.y1 - a.y0) / 2) AND abs(a.x0 - o.x0) <= 6)"""


def rotated_fit(spark, d):
    """Whether a run of each line's length fits its box at 30 degrees."""
    c, s = 0.8660254037844387, 0.5
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    run = F.least(w / c, h / s)
    return _lay(spark, d).select("doc_id", "ord", F.round(run, 4).alias("run"), (run >= 2.0 * F.length("text")).alias("fits"))


ROTATED_SQL = f"""WITH {LAY} SELECT doc_id, ord, round(least((x1 - x0) / 0.8660254037844387::DOUBLE, (y1 - y0) / 0.5::DOUBLE), 4) AS run, least((x1 - x0) / 0.8660254037844387::DOUBLE, (y1 - y0) / 0.5::DOUBLE) >= 2.0 * length(text) AS fits FROM lay"""


def shrink_scale(spark, d):
    """The first of 16 even steps from 1.0 to 0.7 at which the text's lines fit the box."""
    w, h, n = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.length("text")
    step = F.explode(F.sequence(F.lit(0), F.lit(15)))
    rows = _lay(spark, d).withColumn("k", step).withColumn("scale", 1 - F.col("k") * 0.02)
    fits = F.ceil(n / F.floor(w / (5.5 * F.col("scale")))) * 12.0 * F.col("scale") <= h
    return rows.where((w >= 12) & fits).groupBy("doc_id", "ord").agg(F.min("k").alias("steps"))


SHRINK_SQL = f"""WITH {LAY}, k AS (SELECT *, unnest(range(16))::INT AS k FROM lay), s AS (SELECT *, 1 - k * 0.02::DOUBLE AS scale FROM k)
SELECT doc_id, ord, min(k) AS steps FROM s WHERE x1 - x0 >= 12 AND ceil(length(text) / floor((x1 - x0) / (5.5::DOUBLE * scale))) * 12.0::DOUBLE * scale <= y1 - y0 GROUP BY doc_id, ord"""


def html_blocks(spark, d):
    """Blocks of raw pages with roles by tag, by an Arrow-fed parser."""
    return H.html_blocks(table(spark, d, "pages"))


def html_roles(spark, d):
    return html_blocks(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def html_sink(spark, d):
    """K3: lines as escaped HTML, lists of bullet lines kept together, in document order."""
    s = segments(spark, d).withColumn("tag", F.when(F.length("text") <= 25, "h2").otherwise("p"))
    line = F.concat(F.lit("<"), F.col("tag"), F.lit(">"), T.xml_safe(F.col("text")), F.lit("</"), F.col("tag"), F.lit(">"))
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("l"))
    return g.select("doc_id", F.concat(F.lit("<body>"), F.array_join(F.transform("l", lambda x: x["l"]), ""), F.lit("</body>")).alias("html"))


def project_roundtrip(spark, d):
    """S3/K2: documents nested as JSON and read back; every line must survive."""
    g = segments(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("blocks"))
    j = g.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), "blocks")).alias("j"))
    back = j.select("doc_id", F.from_json("j", "version int, blocks array<struct<ord:int,text:string>>").alias("p")).where("p.version = 1")
    return back.select("doc_id", F.explode("p.blocks").alias("b")).select("doc_id", "b.ord", "b.text")


def reply_decode(spark, d):
    """A1-A5: properties read leniently: an object, an array or broken text."""
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.col("props"))
    body = F.regexp_extract(raw, r"(?s)(\{[^{}]*\})", 1)
    return table(spark, d, "events").select("event_id", F.from_json(body, "map<string,bigint>").alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


DECODE_SQL = """SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"""

QUERIES = {
    "box_overlap": (box_overlap, f"WITH {LAY}, {OVERLAP} SELECT doc_id, pg, a_ord, b_ord, round(shared, 3) AS shared FROM ov WHERE shared > 0.3::DOUBLE * small"),
    "box_owner": (box_owner, OWNER_SQL),
    "free_below": (free_below, _free_sql("below", 80.0)),
    "free_right": (free_right, _free_sql("right", 120.0)),
    "column_reflow": (column_reflow, REFLOW_SQL),
    "interval_gaps": (interval_gaps, GAPS_SQL),
    "union_area": (union_area, UNION_SQL),
    "paragraph_islands": (paragraph_islands, None),
    "lines_to_paragraphs": (lines_to_paragraphs, None),
    "side_by_side": (side_by_side, None),
    "side_rows": (side_rows, None),
    "table_cells": (table_cells, None),
    "region_blocks": (region_blocks, REGION_SQL),
    "block_order": (block_order, None),
    "xy_cut": (xy_cut, None),
    "table_grid": (table_grid, None),
    "nms": (nms, None),
    "closure_reach": (closure_reach, CLOSURE_SQL),
    "infer_alignment": (alignment, f"WITH {LAY} SELECT doc_id, pg, x0, CASE WHEN count(*) < 2 THEN 'single' WHEN max(x1) - min(x1) <= 9 THEN 'justify' ELSE 'left' END AS align FROM lay GROUP BY doc_id, pg, x0"),
    "layout_losses": (layout_losses, f"WITH {LAY}, {OVERLAP}, o AS (SELECT doc_id, pg, count(*) AS l4 FROM lay WHERE x1 > 545 OR y1 > 340 GROUP BY ALL), v AS (SELECT doc_id, pg, count(*) AS l7 FROM ov WHERE shared > 0.3::DOUBLE * small GROUP BY ALL) SELECT doc_id, pg, coalesce(l4, 0) AS l4, coalesce(l7, 0) AS l7 FROM o FULL JOIN v USING (doc_id, pg)"),
    "moved_text": (moved_text, MOVED_SQL),
    "rotated_fit": (rotated_fit, ROTATED_SQL),
    "shrink_scale": (shrink_scale, SHRINK_SQL),
    "html_blocks": (html_blocks, None),
    "html_roles": (html_roles, None),
    "html_sink": (html_sink, f"WITH {SEG} SELECT doc_id, '<body>' || string_agg('<' || tag || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>', '' ORDER BY ord) || '</body>' AS html FROM (SELECT *, CASE WHEN length(text) <= 25 THEN 'h2' ELSE 'p' END AS tag FROM seg) GROUP BY doc_id"),
    "project_roundtrip": (project_roundtrip, f"WITH {SEG} SELECT doc_id, ord, text FROM seg"),
    "reply_decode": (reply_decode, DECODE_SQL),
}
