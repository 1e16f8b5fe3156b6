"""Box algebra and layout operators: band joins within a page, free room, columns, islands, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "pg"]


def _as(df: DataFrame, p: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{p}_{c}") for c in ("ord", "x0", "y0", "x1", "y1")])


def area(p: str) -> Column:
    return (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}_x1"), F.col(f"{b}_x1")) - F.greatest(F.col(f"{a}_x0"), F.col(f"{b}_x0"))
    h = F.least(F.col(f"{a}_y1"), F.col(f"{b}_y1")) - F.greatest(F.col(f"{a}_y0"), F.col(f"{b}_y0"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def overlaps(lay: DataFrame, share: float = 0.3, band: float = 60.0, carry: list[str] | None = None) -> DataFrame:
    """Pairs of boxes of a page whose intersection exceeds a share of the smaller one; with ``carry`` also these columns of the first
    box, and both left edges.

    A band join: a box is put in every y-band that it touches, so the equi keys are (document, page, band); a pair is kept in
    the band where the lower of both tops lies, once.
    """
    bands = F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))
    rows = lay.withColumn("band", F.explode(bands))
    a, b = (rows.select(*PAGE, "band", *(carry or [] if p == "a" else []), *[F.col(c).alias(f"{p}_{c}") for c in ("ord", "x0", "y0", "x1", "y1")]) for p in "ab")
    pair = a.join(b, [*PAGE, "band"]).where((F.col("a_ord") < F.col("b_ord")) & (F.col("band") == F.floor(F.greatest("a_y0", "b_y0") / band)))
    return pair.where(intersection("a", "b") > share * F.least(area("a"), area("b"))).select(*PAGE, "a_ord", "b_ord", intersection("a", "b").alias("shared"), *([*carry, "a_x0", "b_x0"] if carry else []))


def free_below(lay: DataFrame, limit: float) -> DataFrame:
    """The room under each box down to the nearest box that shares its columns, ``limit`` at most."""
    a, b = _as(lay, "a"), _as(lay, "b")
    gap = a.join(b, PAGE).where((F.col("a_ord") != F.col("b_ord")) & (F.col("b_y0") >= F.col("a_y1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_x0") < F.col("b_x1")))
    near = gap.groupBy(*PAGE, F.col("a_ord").alias("ord")).agg(F.min(F.col("b_y0") - F.col("a_y1")).alias("gap"))
    return lay.join(near, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.least(F.lit(limit), F.coalesce("gap", F.lit(limit))).alias("room"))


def free_right(lay: DataFrame, limit: float) -> DataFrame:
    """The same to the right, over boxes that share a box's rows."""
    a, b = _as(lay, "a"), _as(lay, "b")
    gap = a.join(b, PAGE).where((F.col("a_ord") != F.col("b_ord")) & (F.col("b_x0") >= F.col("a_x1")) & (F.col("b_y0") < F.col("a_y1")) & (F.col("a_y0") < F.col("b_y1")))
    near = gap.groupBy(*PAGE, F.col("a_ord").alias("ord")).agg(F.min(F.col("b_x0") - F.col("a_x1")).alias("gap"))
    return lay.join(near, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.least(F.lit(limit), F.coalesce("gap", F.lit(limit))).alias("room"))


def owners(lay: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """The smallest region of the page that holds a share of each box. regions: doc_id, pg, region, x0, y0, x1, y1."""
    r = regions.select(*PAGE, "region", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    held = _as(lay, "a").join(r, PAGE).where(intersection("a", "r") >= share * area("a"))
    best = held.groupBy(*PAGE, F.col("a_ord").alias("ord")).agg(F.min(F.struct(area("r").alias("area"), F.col("region"))).alias("b"))
    return best.select(*PAGE, "ord", F.col("b.region").alias("region"))


def column_mates(lay: DataFrame) -> DataFrame:
    """Earlier boxes of the page in the same column (0.4 of the narrower width, or left edges within 20)."""
    a, b = _as(lay, "a"), _as(lay, "b")
    shared = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    same = (shared >= 0.4 * F.least(F.col("a_x1") - F.col("a_x0"), F.col("b_x1") - F.col("b_x0"))) | (F.abs(F.col("a_x0") - F.col("b_x0")) <= 20)
    return a.join(b, PAGE).where((F.col("b_ord") < F.col("a_ord")) & same)


def reflow(lay: DataFrame, grow: Column, bottom: float) -> DataFrame:
    """A box moves down by the growth of its earlier column-mates; past the bottom it is flagged."""
    g = lay.withColumn("grow", grow)
    moved = column_mates(lay).join(g.select(*PAGE, F.col("ord").alias("b_ord"), "grow"), [*PAGE, "b_ord"]).groupBy(*PAGE, F.col("a_ord").alias("ord")).agg(F.sum("grow").alias("shift"))
    out = lay.join(moved, [*PAGE, "ord"], "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    return out.select(*PAGE, "ord", "shift", (F.col("y1") + F.col("shift") > bottom).alias("past"))


def gaps(lay: DataFrame, minimum: float) -> DataFrame:
    """The widest vertical gap of each page that exceeds the minimum (the first of equal ones), by a running maximum."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "y1", "ord")
    g = lay.withColumn("reach", F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap", F.col("y0") - F.col("reach")).where(F.col("gap") > minimum)
    return g.groupBy(*PAGE).agg(F.max(F.struct("gap", (-F.col("reach")).alias("at"))).alias("b")).select(*PAGE, F.col("b.gap").alias("gap"), (-F.col("b.at")).alias("gap_from"))


def union_area(lay: DataFrame) -> DataFrame:
    """The exact area that the boxes of a page cover: strips between neighbouring x edges, and inside a strip the union of y
    intervals by a running maximum."""
    edges = lay.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    w = Window.partitionBy(*PAGE).orderBy("x")
    strips = edges.withColumn("to", F.lead("x").over(w)).where("to is not null")
    inside = strips.join(lay, PAGE).where((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("to")))
    v = Window.partitionBy(*PAGE, "x").orderBy("y0", "y1", "ord").rowsBetween(Window.unboundedPreceding, -1)
    cover = inside.withColumn("reach", F.max("y1").over(v)).withColumn("h", F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce("reach", F.col("y0")))))
    return cover.groupBy(*PAGE).agg(F.sum(F.col("h") * (F.col("to") - F.col("x"))).alias("covered"))


def paragraphs(lay: DataFrame, times: float = 3.0) -> DataFrame:
    """A new paragraph starts where the gap above a line reaches ``times`` the page's median gap and half a line."""
    w = Window.partitionBy(*PAGE, "x0").orderBy("y0", "ord")
    g = lay.withColumn("gap", F.col("y0") - F.lag("y1").over(w))
    m = g.groupBy(*PAGE).agg(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("mid"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("line"))
    flagged = g.join(m, PAGE).withColumn("new", F.when(F.col("gap") >= F.greatest(F.coalesce(F.col("mid"), F.lit(0.0)) * times, F.col("line") / 2), 1).otherwise(0))
    return flagged.select(*PAGE, "ord", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("paragraph"))
