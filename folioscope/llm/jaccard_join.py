"""Exact n-gram Jaccard join over a token-group matrix, and the connected components of its links.

Method. Equal shingle sets collapse to one representative (a sum with map-side combine, so a group of
copies of any size costs one row a task). Every representative keeps the first tokens of its set under a
global order that puts corpus-wide frequent tokens last. A *group* is a leader and the representatives that
share such tokens with it and half of their union. The token-group matrix holds one row for each (token, group)
of the groups' token unions. A query document meets a group it is not in only through that matrix; the number of
its tokens found in the union, and the tokens before the first of them, bound its overlap with every member; only
groups whose bound reaches the least possible overlap are opened.

An opened group, and a document's own, is compared through its leader: each set in it is known by its difference
from the leader's. Two differences a and b of sets that link share r = (|a| + |b| - c * (n + m)) / 2 tokens at
least, where c = (1 - t) / (1 + t). Where r <= 0 both sets link to the leader, so nothing need be compared; all
other pairs share one of the first |a| - r + 1 tokens of the differences, and what stands before a shared one bounds
the rest. So neither copies nor the many unlike edits of one text are paired with each other.

Why nothing is lost: with overlap of at least a = ceil(t*n) tokens, the first n - a + k tokens of both sets,
under any common order, share at least k tokens. The order is a fixed function of the token, so it may rest
on estimated frequencies: an estimate changes the work, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, chunks, claim, connected_components, discard, materialise, mix, rows_of, shared_dir, ship, shingle_set

LEVELS = 1 << 20
LOCAL_TOKENS = 1_000_000
#: Least similarity to the leader, in percent, of the members of a group.
HOME = 50
SALTS = 32


def _frequent(docs: DataFrame, words: int, least: int = 16) -> np.ndarray:
    """Levels (0 to 255) of token frequency by a hash of 20 bits: at most 2**20 rows reach the driver at any corpus size.
    Each task sends only tokens that repeat among its own documents."""

    def repeated(batches):
        claim("jaccard_join")
        def flush(held):
            t, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= 2
            return pa.record_batch({"t": t[many].view(np.int64), "c": c[many].astype(np.int64)})

        held, size = [], 0
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                w = Words(part)
                for i in range(len(part)):
                    s = w.shingles(i, words)
                    held.append(s)
                    size += len(s)
                if size >= LOCAL_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = (
        docs.select("text").mapInArrow(repeated, "t long, c long")
        .groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        .groupBy(F.expr(f"cast(t & {LEVELS - 1} as int)").alias("b")).agg(F.max("c").alias("c")).toArrow()
    )
    out = np.zeros(LEVELS, np.uint8)
    out[rows["b"].to_numpy()] = np.minimum(255, 1 + 8 * np.log2(rows["c"].to_numpy() / least)).astype(np.uint8)
    return out


def _ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens as numbers in the global order: the frequent ones last."""
    return (levels[(tokens & np.uint64(LEVELS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (tokens >> np.uint64(9))


def least_overlap(n, percent: int):
    """ceil(percent * n / 100)"""
    return -(-percent * n // 100)


def needed(n, percent: int):
    """How many of its leading tokens a set of n must share with any set it may link to (and the longer prefix that makes it so)."""
    return 1 + 2 * n // 100


def _signatures(docs: DataFrame, words: int, percent: int, levels) -> DataFrame:
    """A row for each document: n, a 128-bit digest of the set, and the leading tokens under the global order."""

    def sign(batches):
        claim("jaccard_join")
        table = levels.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                w = Words(part)
                n, x, y, lead = [], [], [], []
                for i in range(len(part)):
                    s = w.shingles(i, words)
                    m = len(s)
                    n.append(m)
                    x.append(int(mix(s).sum().view(np.int64)) if m else 0)
                    y.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if m else 0)
                    keep = min(m, m - int(least_overlap(m, percent)) + int(needed(m, percent)))
                    if m:
                        key = _ordered(s, table)
                        key = np.sort(np.partition(key, keep - 1)[:keep] if keep < m else key)
                        lead.append(key.view(np.int64))
                    else:
                        lead.append(np.empty(0, np.int64))
                sizes = np.concatenate([[0], np.cumsum([len(k) for k in lead])]).astype(np.int32)
                yield pa.record_batch([
                    ids.slice(at, len(part)), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lead) if lead else np.empty(0, np.int64))),
                ], ["doc_id", "n", "x", "y", "lead"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, x long, y long, lead array<long>")


def shared_at_least(n: int, m: int, d: int, linked: bool, percent: int) -> int:
    """Of a set of n tokens whose difference from a leader's m tokens has d: how many of the d any set shares that links to it while one
    of both does not link to the leader."""
    if linked:
        return max(1, -((-(100 + percent) * d + (100 - percent) * (n - m)) // (2 * (100 + percent))))
    return max(1, -((-(100 + percent) * d + (100 - percent) * (n + m)) // 200))


def _compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int, levels=None) -> DataFrame:
    """For each pair (a, b): n, whether it links, whether it shares HOME percent, and, with ``levels``, the size d of the difference of
    both sets with the first of its tokens. Texts travel to the pairs by two equi joins; a hot b is split by AQE."""

    def compare(batches):
        claim("jaccard_join")
        last, kept = None, None
        table = levels.value if levels is not None else None
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            n, d, ok, half, lead = (np.zeros(len(a), t) for t in (np.int64, np.int64, bool, bool, np.int32))
            tokens = []
            for i in range(len(a)):
                if last is None or tb[i] != last:
                    last, kept = tb[i], shingle_set(Words([(tb[i] or "").encode("utf-8", "surrogatepass")]).h, words)
                s = shingle_set(Words([(ta[i] or "").encode("utf-8", "surrogatepass")]).h, words)
                if not len(s) or not len(kept):
                    continue
                both = np.intersect1d(s, kept, assume_unique=True)
                union = len(s) + len(kept) - len(both)
                n[i], d[i], ok[i], half[i] = len(s), union - len(both), 100 * len(both) >= percent * union, 100 * len(both) >= HOME * union
                if table is not None:
                    # what the leader lacks first, then what it alone has
                    more, less = (np.setdiff1d(x, both, assume_unique=True) for x in (s, kept))
                    key = np.sort(np.concatenate([_ordered(more, table) >> np.uint64(1), (_ordered(less, table) >> np.uint64(1)) | np.uint64(1 << 63)]))
                    key = key[: max(0, int(d[i]) - shared_at_least(len(s), len(kept), int(d[i]), bool(ok[i]), percent) + 1)]
                    tokens.append(key.view(np.int64))
                    lead[i] = len(key)
            sizes = np.concatenate([[0], np.cumsum(lead)]).astype(np.int32)
            yield pa.record_batch([
                pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n), pa.array(d), pa.array(ok), pa.array(half),
                pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64))),
            ], ["a", "b", "n", "d", "linked", "half", "tokens"])

    near = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    far = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return far.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, n long, d long, linked boolean, half boolean, tokens array<long>")


def _within(visits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in one group that may link and of which one does not link to the leader: home, a visitor or a member; b is a member.
    ``visits``: a (set), b (the group's leader), n, d, linked, home, tokens."""
    # groups with such a set; a group's members are many, so they meet its key in SALTS parts
    busy = visits.where("not linked").select("b").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = visits.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(busy, ["b", "s"], "left_semi").select("a", "b", "n", "d", "linked", "home", F.posexplode("tokens").alias("pos", "token"))
    x, y = rows.alias("x"), rows.where("home").alias("y")
    col = lambda k: F.col(k)
    # tokens before the first shared one are in one difference alone
    rest = F.least(col("x.d") - col("x.pos"), col("y.d") - col("y.pos"))
    asked = (col("x.d") + col("y.d")) * (100 + percent) - (col("x.n") + col("y.n")) * (100 - percent)
    apart = ~(col("x.linked") & col("y.linked")) & (~col("x.home") | (col("x.a") > col("y.a")))
    met = x.join(y, (col("x.b") == col("y.b")) & (col("x.token") == col("y.token")) & apart & (rest * (2 * (100 + percent)) >= asked))
    return met.select(col("x.a").alias("a"), col("y.a").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Every document's set size and component.

    ``docs``: doc_id, text and any other columns. Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set holds the
    distinct shingles of ``words`` words, of a shorter text the whole sequence. Two documents link when
    100 * |intersection| >= percent * |union|. Returns doc_id, n_shingles, component_id (the smallest linked doc_id,
    over any number of links).

    Null, empty or blank text: an empty set, linked with nothing. A null doc_id: a row of its own with component null,
    linking nothing. Rows that share a doc_id are one node: a row is returned for each. Empty input: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = spark.sparkContext.broadcast(_frequent(docs, words))
    sig = materialise(spark, _signatures(docs, words, percent, levels), folder, "sig")
    # one representative for each distinct set
    reps = materialise(spark, sig.where("n > 0 and doc_id is not null").groupBy("n", "x", "y").agg(F.min("doc_id").alias("rep")), folder, "reps")
    own = sig.where("n > 0").select("doc_id", "n", "x", "y", "lead").join(reps, ["n", "x", "y"]).where("doc_id = rep").dropDuplicates(["rep", "x", "y"])
    rows = own.select("rep", F.col("n").cast("int").alias("n"), F.posexplode("lead").alias("pos", "token"))
    # the leader of a token is the set in which the fewest rarer tokens stand before it, the one most like what the others were copied from
    by_token = Window.partitionBy("token").orderBy("pos", "rep")
    shared = (
        rows.select("rep", "n", "pos", "token", F.first("rep").over(by_token).alias("lead"), F.lead("rep").over(by_token).alias("more"))
        .where("lead <> rep or more <> rep").select("token", "rep", "n", "pos", "lead")
    )
    postings = materialise(spark, shared, folder, "postings")
    # groups: each representative may join the leader it shares most with
    best = Window.partitionBy("rep").orderBy(F.desc("shared"), "lead")
    stars = (
        postings.where("lead <> rep").groupBy("rep", "lead", "n").agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") * 100 >= F.col("n")).withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    )
    stars = materialise(spark, stars, folder, "stars")
    wanted = postings.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where(F.col("c") * 100 >= F.col("n")).select("rep")
    texts = materialise(spark, rows_of(docs, wanted.union(stars.select("b"))), folder, "texts")
    compared = materialise(spark, _compared(stars, texts, words, percent, levels), folder, "compared")
    star_links = compared.where("linked").select("a", "b")
    # a leader is at home in its own group alone
    leaders = compared.where("half").select(F.col("b").alias("a")).distinct()
    members = materialise(spark, compared.where("half").join(leaders, "a", "left_anti"), folder, "members")
    known = connected_components(spark, star_links, folder, "known")
    # token-group matrix: the sets that link to a leader and those that don't are two groups of it; queries meet groups other than their own
    held = (
        postings.join(members.select(F.col("a").alias("rep"), F.col("b").alias("home"), F.col("linked").alias("near")), "rep", "left")
        .join(known.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .select("token", "rep", "n", "pos", F.coalesce("home", "rep").alias("group"), F.coalesce("near", F.lit(True)).alias("near"), F.coalesce("label", "rep").alias("label"))
    )
    several = held.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1").select("token")
    held = materialise(spark, held.join(several, "token", "left_semi"), folder, "held")
    matrix = held.groupBy("token", "group", "near").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("pos")).alias("room"), F.min("label").alias("l0"), F.max("label").alias("l1")
    )
    q = held.select("token", "rep", "n", "pos", "label", F.col("group").alias("own"))
    fits = (F.col("most_n") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least_n") * percent)
    # a pair is looked for from the side whose group is the larger id, unless all that the group has of the token is known to be connected
    other = (F.col("own") > F.col("group")) & ((F.col("l0") != F.col("label")) | (F.col("l1") != F.col("label")))
    met = q.join(matrix, "token").where(other & fits).groupBy("rep", "n", "group", "near").agg(
        F.count(F.lit(1)).alias("found"), F.min("pos").alias("pos"), F.max("room").alias("room"), F.min("least_n").alias("least_n")
    )
    # tokens before the first shared one are missing from every member, so at most n - pos are shared (and no more than ``room`` on
    # the member's side); a member of m tokens asks for percent / (100 + percent) of n + m, and m is no smaller than fits allows
    smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100))
    asked = F.ceil((F.col("n") + smallest) * percent / (100 + percent))
    opened = met.where((F.col("found") >= 1 + F.floor(F.col("n") * percent * 2 / 10000)) & (F.least(F.col("n") - F.col("pos"), F.col("room")) >= asked))
    opened = materialise(spark, opened.select(F.col("rep").alias("a"), F.col("group").alias("b")).distinct(), folder, "opened")
    visits = materialise(spark, _compared(opened, texts, words, percent, levels).withColumn("home", F.lit(False)), folder, "visits")
    inside = materialise(spark, _within(visits.unionByName(members.withColumn("home", F.lit(True))), percent), folder, "inside")
    more_links = materialise(spark, _compared(inside, texts, words, percent).where("linked").select("a", "b"), folder, "more-links")
    labels = connected_components(spark, star_links.union(visits.where("linked").select("a", "b")).union(more_links), folder, "labels")
    discard(spark, folder, "postings", "texts", "held", "opened", "stars", "compared", "members", "visits", "inside", "more-links", "known")
    return (
        sig.select("doc_id", "n", "x", "y").join(reps, ["n", "x", "y"], "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """The document with the smallest doc_id of each component, all its columns. Rows without doc_id stay.

    Rows that share a doc_id stay or go together: of those with equal text one stays, those with different texts stay all.
    """
    parts = jaccard_components(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(parts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def sql(words: int = 4, percent: int = 85) -> str:
    """The components in DuckDB, by counting the shingles that documents share and following links; for tables of a few thousand rows."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    following = "".join(f", lead(w, {k}) OVER x" for k in range(1, words))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
g AS (SELECT doc_id, i, n, concat_ws(' ', w{following}) AS t FROM e WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
t AS MATERIALIZED (SELECT DISTINCT doc_id, hash(t) AS t FROM g WHERE i <= greatest(1, n - {words - 1})),
n AS (SELECT d.doc_id, count(t.t) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""
