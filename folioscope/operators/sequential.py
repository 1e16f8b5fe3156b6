"""Sequential algorithms of one page or document (SURVEY tier B), as folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def stretches(seg: DataFrame, least: int, size: int) -> DataFrame:
    """Segments of ``least`` characters put in groups that close when their running size reaches ``size``: a fold per document."""
    g = seg.where(F.length("text") >= least).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.length("text").cast("int").alias("n")))).alias("s"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.array().cast("array<struct<ord:int,grp:int>>").alias("out"))

    def step(a, x):
        full = a["n"] + x["n"] >= size
        return F.struct(F.when(full, a["g"] + 1).otherwise(a["g"]).alias("g"), F.when(full, 0).otherwise(a["n"] + x["n"]).alias("n"), F.concat(a["out"], F.array(F.struct(x["ord"].alias("ord"), a["g"].alias("grp")))).alias("out"))

    return g.select("doc_id", F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("o")).select("doc_id", "o.ord", "o.grp")


def wrap_count(text: Column, width: int) -> Column:
    """A10: lines of a greedy word wrap at ``width`` characters; a longer word stands alone."""
    zero = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("at"))

    def step(a, w):
        n = F.length(w)
        fits = (a["lines"] > 0) & (a["at"] + 1 + n <= width)
        return F.struct(F.when(fits, a["lines"]).otherwise(a["lines"] + 1).alias("lines"), F.when(fits, a["at"] + 1 + n).otherwise(n).alias("at"))

    return F.aggregate(F.filter(F.split(text, " +"), lambda w: w != ""), zero, step, lambda a: a["lines"])


def parse_marked(df: DataFrame, column: str) -> DataFrame:
    """F16: spans of marked text as (k, style, text); style -1 is plain. A crossing, unknown or unclosed marker makes the text unusable (no rows)."""
    mark = r"(?=</?[0-9]+>)|(?<=[0-9]>)"
    parts = F.filter(F.split(F.col(column), mark), lambda x: x != "")
    state = "struct<open:array<int>,ok:boolean,out:array<struct<style:int,text:string>>>"

    def put(open_, ok, out):
        return F.struct(open_.alias("open"), ok.alias("ok"), out.alias("out")).cast(state)

    def step(a, x):
        number = F.regexp_extract(x, "^</?([0-9]+)>$", 1)
        top = F.try_element_at(a["open"], F.lit(-1))
        style = F.coalesce(top, F.lit(-1))
        closes = F.startswith(x, F.lit("</"))
        return (
            F.when(number == "", put(a["open"], a["ok"], F.concat(a["out"], F.array(F.struct(style.alias("style"), x.alias("text"))))))
            .when(closes, put(F.slice(a["open"], 1, F.greatest(F.lit(0), F.size(a["open"]) - 1)), a["ok"] & F.coalesce(top == number.try_cast("int"), F.lit(False)), a["out"]))
            .otherwise(put(F.concat(a["open"], F.array(number.try_cast("int"))), a["ok"], a["out"]))
        )

    start = put(F.array().cast("array<int>"), F.lit(True), F.array().cast("array<struct<style:int,text:string>>"))
    spans = F.aggregate(parts, start, step, lambda a: F.when(a["ok"] & (F.size(a["open"]) == 0), a["out"]).otherwise(F.slice(a["out"], 1, 0)))
    keys = [c for c in df.columns if c != column]
    return df.select(*keys, F.posexplode(spans).alias("k", "s")).select(*keys, "k", "s.style", "s.text")


def soft_hyphens(t: Column) -> Column:
    """a soft hyphen before every consonant that a vowel follows, inside words of ten letters without capitals, three letters off both ends."""
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.when(w.rlike(r"^\p{Ll}{10,}$"), F.regexp_replace(w, r"(?<=\p{L}{3})(?<=[aeiouäöüéèêíóúñ])([bcdfghjklmnpqrstvwxzß])(?=[aeiouäöüéèêíóú])(?=\p{L}{3})", "­$1")).otherwise(w)), " ")
