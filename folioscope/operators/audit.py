"""Audit of written documents: every kind of loss, found over columns of one frame of blocks or by joins that carry the page.

Blocks: doc_id, lang, pg, ord, source, target (empty: none), x0, y0, x1, y1 (source box) and oy (top of the written box).
Findings: doc_id, lang, kind, pg, ord (null for whole pages and documents).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import materialise, shared_dir
from . import layout as L
from .segments import READING, judged

PAGE = ["doc_id", "pg"]
FOUND = ["doc_id", "lang", "kind", "pg", "ord"]
#: Page edges, one point of slack included by the check.
RIGHT, BOTTOM = 545.0, 340.0
#: Width of a character and height of a line in points, and how far text may shrink to fit.
ADVANCE, LEADING, SHRINK = 5.0, 12.0, 0.85
#: Tag-like tokens.
TAG = "(</?[A-Za-z][A-Za-z0-9]*>)"


def written(blocks: DataFrame) -> DataFrame:
    """A block shows its reply, or its source where there is none."""
    return blocks.withColumn("written", F.when(F.col("target") == "", F.col("source")).otherwise(F.col("target")))


def block_losses(blocks: DataFrame) -> DataFrame:
    """L2 (untranslated prose: no reply, the same, a copy, or in another language), L6 (numbers), L9 (garbled), L4 (off the page), D1 (did not
    fit its box) and D2 (short and unchanged), in one pass without a join."""
    j = judged(blocks)
    prose = F.col("n_words") >= 4
    room = F.floor((F.col("x1") - F.col("x0")) / ADVANCE) * F.round((F.col("y1") - F.col("y0")) / LEADING)
    fit = F.length("target") * SHRINK > room
    same = (T.normalised(F.col("source")) != "") & (T.normalised(F.col("source")) == T.normalised(F.col("target")))
    checked = T.is_checked(F.col("source"))
    kinds = F.array_compact(F.array(
        F.when(checked & prose & (F.col("missing") | F.col("copy") | F.col("identical") | F.col("foreign")), "L2"), F.when(F.col("numbers"), "L6"), F.when(F.col("garbled"), "L9"),
        F.when((F.col("x1") > RIGHT + 1) | (F.col("y1") > BOTTOM + 1), "L4"), F.when(fit, "D1"), F.when(checked & ~prose & (F.size(F.split("source", " ")) >= 2) & same, "D2"),
    ))
    return j.select("doc_id", "lang", F.explode(kinds).alias("kind"), "pg", "ord")


def page_counts(blocks: DataFrame) -> DataFrame:
    """L1: documents whose written pages are fewer than the source's: a page counts when a reply stands on it."""
    g = blocks.groupBy("doc_id", "lang", "pg").agg(F.bool_or(F.col("target") != "").alias("shown"))
    n = g.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("pages"), F.count_if("shown").alias("shown")).where("pages <> shown")
    return n.select("doc_id", "lang", F.lit("L1").alias("kind"), F.lit(None).cast("int").alias("pg"), F.lit(None).cast("int").alias("ord"))


def dropped_text(blocks: DataFrame, drawn, share: float = 0.9) -> DataFrame:
    """L3: pages on which less than ``share`` of the words that should be written are drawn, counted with repeats; scanned documents are
    exempt. ``drawn``: what is on the page of a block."""
    w = written(blocks).where(~F.col("scanned"))
    count = lambda c, name: w.select(*PAGE, "lang", F.explode(F.filter(F.split(c, " +"), lambda x: x != "")).alias("w")).groupBy(*PAGE, "lang", "w").agg(F.count(F.lit(1)).alias(name))
    j = count(F.col("written"), "need").join(count(drawn, "have"), [*PAGE, "lang", "w"], "left")
    g = j.groupBy(*PAGE, "lang").agg((F.sum(F.least("need", F.coalesce("have", F.lit(0)))) / F.sum("need")).alias("share")).where(F.col("share") < share)
    return g.select("doc_id", "lang", F.lit("L3").alias("kind"), "pg", F.lit(None).cast("int").alias("ord"))


def leaked_markup(blocks: DataFrame) -> DataFrame:
    """Blocks with a tag-like token that stands nowhere in the source of their document."""
    tags = lambda c: F.explode(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(TAG), F.lit(1)), F.lower))).alias("tag")
    own = blocks.where(F.contains("source", F.lit("<"))).select("doc_id", tags(F.col("source"))).distinct()
    out = blocks.where(F.contains("target", F.lit("<"))).select("doc_id", "lang", "pg", "ord", tags(F.col("target")))
    return out.join(own, ["doc_id", "tag"], "left_anti").select("doc_id", "lang", F.lit("L5").alias("kind"), "pg", "ord").distinct()


def overlapping(blocks: DataFrame) -> DataFrame:
    """L7 (boxes of different columns) and D3 (lines of one column squeezed together), once for each pair, at the earlier box."""
    o = L.overlaps(blocks, carry=["lang"])
    return o.select("doc_id", "lang", F.when(F.col("a_x0") == F.col("b_x0"), "D3").otherwise("L7").alias("kind"), "pg", F.col("a_ord").alias("ord"))


def moved(blocks: DataFrame) -> DataFrame:
    """Blocks kept as they were that are not drawn where they stood (half a line down, six points aside)."""
    kept = blocks.where((F.col("target") == F.col("source")) | (F.col("target") == "")).select(*PAGE, "lang", "ord", "source", "x0", "y0", "y1")
    out = written(blocks).select(*PAGE, F.col("written").alias("source"), "oy", F.col("x0").alias("ox"))
    near = (F.abs(F.col("y0") - F.col("oy")) <= F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) / 2)) & (F.abs(F.col("x0") - F.col("ox")) <= 6)
    a, o = kept.alias("a"), out.alias("o")
    on = [F.col(f"a.{c}") == F.col(f"o.{c}") for c in (*PAGE, "source")]
    return a.join(o, [*on, near], "left_anti").select("doc_id", "lang", F.lit("L8").alias("kind"), "pg", "ord")


def over_figures(blocks: DataFrame, figures: DataFrame, share: float = 0.55, cover: float = 0.85, page_area: float = 600.0 * 350.0, slack: float = 3.0) -> DataFrame:
    """Blocks written over a figure by more than ``share`` of their area, unless the source drew the same text at that place (``slack``
    points), or figures cover the page to ``cover``. figures: doc_id, pg, ord, x0, y0, x1, y1."""
    full = L.union_area(figures).where(F.col("covered") >= cover * page_area)
    f = figures.join(full, PAGE, "left_anti").select(*PAGE, *[F.col(c).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1")])
    h = F.col("y1") - F.col("y0")
    out = written(blocks).select(*PAGE, "lang", "ord", "written", F.col("x0").alias("a_x0"), F.col("oy").alias("a_y0"), F.col("x1").alias("a_x1"), (F.col("oy") + h).alias("a_y1"))
    on = out.join(f, PAGE).where(L.intersection("a", "f") > share * L.area("a")).select(*PAGE, "lang", "ord", "written", "a_x0", "a_y0").distinct()
    there = blocks.select(*PAGE, F.col("source").alias("written"), F.col("x0").alias("sx"), F.col("y0").alias("sy"))
    same = (F.abs(F.col("a_x0") - F.col("sx")) <= slack) & (F.abs(F.col("a_y0") - F.col("sy")) <= slack)
    a, o = on.alias("a"), there.alias("o")
    left = a.join(o, [*[F.col(f"a.{c}") == F.col(f"o.{c}") for c in (*PAGE, "written")], same], "left_anti")
    return left.select("doc_id", "lang", F.lit("L10").alias("kind"), "pg", "ord")


def findings(blocks: DataFrame, figures: DataFrame, drawn) -> DataFrame:
    """All kinds of loss, a row each."""
    parts = [block_losses(blocks), page_counts(blocks), dropped_text(blocks, drawn), leaked_markup(blocks), overlapping(blocks), moved(blocks), over_figures(blocks, figures)]
    out = parts[0].select(*FOUND)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FOUND))
    return out


def with_loss(tr: DataFrame) -> DataFrame:
    """Replies and whether they have a loss that asking again can mend: L2, L6, L9."""
    prose = F.col("n_words") >= 4
    loss = (prose & (F.col("missing") | F.col("copy") | F.col("identical") | F.col("foreign"))) | F.col("numbers") | F.col("garbled")
    return judged(tr).select(*tr.columns, F.coalesce(loss, F.lit(False)).alias("loss"))


def failing(tr: DataFrame) -> DataFrame:
    """Replies with a loss that asking again can mend."""
    return with_loss(tr).where("loss").select(*tr.columns)


def verify_and_repair(tr: DataFrame, ask: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """Replies with a loss are asked again, at most ``rounds`` times; an answer without a loss is taken, any other leaves the block as
    it was. ``ask``: (failing replies, round) to the same rows with new targets. Returns the replies and the failing ones of each round.

    What fails and what is answered is written to the shared folder, so every reply is judged and every failing one asked once a round."""
    spark, folder = tr.sparkSession, shared_dir(tr.sparkSession)
    open_, history, mended = materialise(spark, failing(tr), folder, "failing-0"), [], None
    for k in range(1, rounds + 1):
        history.append(open_)
        answers = materialise(spark, with_loss(ask(open_, k)), folder, f"answers-{k}")
        still = answers.where("loss").select(*READING)
        good = materialise(spark, answers.where("not loss").join(still, READING, "left_anti").select(*READING, F.col("target").alias("better")), folder, f"mended-{k}")
        mended = good if mended is None else mended.unionByName(good)
        open_ = materialise(spark, open_.join(still, READING, "left_semi").select(*tr.columns), folder, f"failing-{k}")
    history.append(open_)
    if mended is None:
        return tr, history
    return tr.join(mended, READING, "left").withColumn("target", F.coalesce("better", "target")).drop("better"), history
