"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimiser positions of the words, which depend on content alone, so equal passages keep equal
suffixes. They are sorted by a hash of their first block of words, then by document; a neighbour in the order that shares
the block, but not the document, is a match. Matches of a document with the same neighbour at the same distance that meet
form a chain, which proves a passage; all matches that meet form a run. Runs are extended left and right by windows of the
least length: those that hold a block of the run and lie in no proven passage are open, and their hashes are looked up
among the windows of all documents. So each suffix meets one neighbour, a text is shuffled once, and work is linear in a
passage's copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bits_of, chunks, claim, discard, in_bits, materialise, rolling, rows_of, run_hashes, shared_dir, ship

KMER = 6


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest k-word hash of every ``window`` positions in a row; of equal ones the first. Where one word repeats,
    only the first position and every ``window``-th counted back from the last one take part, so such stretches keep few suffixes."""
    k = rolling(h, KMER)
    if len(k) == 0:
        return np.empty(0, np.int64)
    at = np.arange(len(k))
    other = k[1:] != k[:-1]
    first = np.concatenate([[True], other])
    last = np.minimum.accumulate(np.where(np.concatenate([other, [True]]), at, len(k))[::-1])[::-1]
    k = np.where(first | ((last - at) % window == 0), k, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(k) <= window:
        return np.array([int(np.argmin(k))])
    at = np.arange(len(k) - window + 1) + np.lib.stride_tricks.sliding_window_view(k, window).argmin(1)
    return np.unique(at)


def _suffixes(docs: DataFrame, block: int, window: int) -> DataFrame:
    """doc_id, pos and key: the hash of the first ``block`` words."""

    def run(batches):
        claim("suffix_dedup")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in chunks(batch.column(1).to_pylist()):
                w = Words(part)
                keys = run_hashes(w.h, block)
                out_d, out_p = [], []
                for i in range(len(part)):
                    a, b = w.first[i], w.first[i + 1]
                    if b - a >= block:
                        p = minimisers(w.h[a:b], window)
                        p = p[p + block <= b - a]
                        out_p.append(p)
                        out_d.append(np.full(len(p), i))
                if out_p:
                    p, d = np.concatenate(out_p), np.concatenate(out_d)
                    yield pa.record_batch({"doc_id": pa.array(ids[at + d].astype(np.int64)), "pos": pa.array(p.astype(np.int32)), "key": pa.array(keys[p + w.first[d]].view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, key long")


def _neighbours(ordered: DataFrame) -> DataFrame:
    """For every suffix the nearest one before it in the order, else after it, with the same key in another document.

    The stream of a partition is read once. ``loose`` rows found no partner inside their partition but stand in its first
    or last run of equal keys, where the neighbour may lie in another partition; ``edge`` rows stand for those runs.
    """

    def run(batches):
        claim("suffix_dedup")
        held = None  # rows of the run's first document, waiting for a second one
        prev = None  # (key, doc, pos) of the last row, and the partner that its document has in this run
        partner = None
        first_key, last = None, None
        names = ["doc_id", "pos", "key", "other", "other_pos", "kind"]

        def out(d, p, k, o, op, kind):
            n = len(d)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(d, np.int64)), pa.array(np.asarray(p, np.int32)), pa.array(np.asarray(k, np.int64)), pa.array(np.asarray(o, np.int64)), pa.array(np.asarray(op, np.int32)), pa.array(np.full(n, kind, np.int32))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            d, p, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = len(d)
            new_key = np.concatenate([[prev is None or k[0] != prev[0]], k[1:] != k[:-1]])
            new_doc = new_key | np.concatenate([[prev is None or d[0] != prev[1]], d[1:] != d[:-1]])
            if first_key is None:
                first_key = k[0]
                yield out([d[0]], [p[0]], [k[0]], [-1], [-1], 2)
            block = np.maximum.accumulate(np.where(new_doc, np.arange(n), -1))  # -1: the block goes on from the last batch
            before = block - 1
            o, op = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            ok = block > 0
            same = np.zeros(n, bool)
            same[ok] = (k[before[ok]] == k[ok]) & (d[before[ok]] != d[ok])
            o[same], op[same] = d[before[same]], p[before[same]]
            found = same.copy()
            if prev is not None:
                start = block == 0
                if start.any() and not new_key[0] and prev[1] != d[0]:
                    o[start], op[start], found[start] = prev[1], prev[2], True
                on = block == -1
                if on.any() and partner is not None:
                    o[on], op[on], found[on] = partner[0], partner[1], True
            # rows of the first document of a run look forward to the next block
            nxt = np.full(n, n)
            starts = np.flatnonzero(new_doc)
            after = np.searchsorted(starts, np.arange(n), "right")
            has = after < len(starts)
            nxt[has] = starts[after[has]]
            look = ~found & (nxt < n)
            idx = np.flatnonzero(look)
            good = k[nxt[idx]] == k[idx]
            o[idx[good]], op[idx[good]], found[idx[good]] = d[nxt[idx[good]]], p[nxt[idx[good]]], True
            if held is not None:
                first_new = starts[0] if len(starts) else n
                if first_new < n:
                    if k[first_new] == held[2][0]:
                        yield out(*held, np.full(len(held[0]), d[first_new]), np.full(len(held[0]), p[first_new]), 0)
                    elif held[2][0] == first_key:
                        yield out(*held, np.full(len(held[0]), -1), np.full(len(held[0]), -1), 1)
                    held = None
            if found.any():
                yield out(d[found], p[found], k[found], o[found], op[found], 0)
            left = np.flatnonzero(~found)
            tail = left[nxt[left] == n]
            gone = left[(nxt[left] < n) & (k[left] == first_key)]
            if len(gone):
                yield out(d[gone], p[gone], k[gone], np.full(len(gone), -1), np.full(len(gone), -1), 1)
            if len(tail):
                keep = (d[tail], p[tail], k[tail])
                held = keep if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, keep))
            partner = (o[-1], op[-1]) if found[-1] else None
            prev = (k[-1], d[-1], p[-1])
            last = prev
        if held is not None:
            yield out(*held, np.full(len(held[0]), -1), np.full(len(held[0]), -1), 1)
        if last is not None:
            yield out([last[1]], [last[2]], [last[0]], [-1], [-1], 2)

    return ordered.select("doc_id", "pos", "key").mapInArrow(run, "doc_id long, pos int, key long, other long, other_pos int, kind int")


def _extend(runs: DataFrame, least: int, block: int, window: int) -> DataFrame:
    """Passages that a document's chains of matches prove, with code points at both ends, and (rows with a hash) its open windows of ``least``
    words: those that hold a block of a run and are not part of a proven passage. A shared window keeps its first minimiser, so it starts at
    most ``window`` - 1 words before a run and ``block`` before its end."""

    def run(batches):
        claim("suffix_dedup")
        for batch in batches:
            rows, passing = [], []
            for doc, text, pos, other, at in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw = text.encode("utf-8", "surrogatepass")
                words = Words([raw])
                n = len(words.h)
                ends = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                order = np.argsort(np.array(pos), kind="stable")
                p, o = np.array(pos)[order], np.array(other)[order]
                d = np.array(at)[order] - p
                meets = p[1:] <= p[:-1] + block
                chain = np.flatnonzero(np.concatenate([[True], ~(meets & (o[1:] == o[:-1]) & (d[1:] == d[:-1]))]))
                spans = [(s, e, k) for s, e, k in zip(p[chain].tolist(), (p[np.append(chain[1:], len(p)) - 1] + block).tolist(), o[chain].tolist()) if e - s >= least]
                open_ = np.zeros(max(0, n - least + 1), bool)
                first = np.flatnonzero(np.concatenate([[True], ~meets]))
                for s, e in zip(p[first].tolist(), (p[np.append(first[1:], len(p)) - 1] + block).tolist()):
                    open_[max(0, s - window + 1) : e - block + 1] = True
                for s, e, k in spans:
                    open_[s : e - least + 1] = False
                    rows.append((doc, s, e, int(ends[words.start[s]]) - 1, int(ends[words.end[e - 1] - 1]), k))
                w = np.flatnonzero(open_)
                if len(w):
                    passing.append((np.full(len(w), doc, np.int64), w, w + least, ends[words.start[w]] - 1, ends[words.end[w + least - 1] - 1], run_hashes(words.h, least)[w].view(np.int64)))
            names = ["doc_id", "w0", "w1", "c0", "c1", "other", "hash"]
            types = [pa.int64(), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)), pa.nulls(len(rows), pa.int64())], names)
            if passing:
                doc_id, x, y, c0, c1, h = (np.concatenate(c) for c in zip(*passing))
                yield pa.RecordBatch.from_arrays([pa.array(doc_id), *(pa.array(c.astype(np.int32)) for c in (x, y, c0, c1)), pa.nulls(len(x), pa.int64()), pa.array(h)], names)

    return runs.select("doc_id", "text", "m.pos", "m.other", "m.other_pos").mapInArrow(run, "doc_id long, w0 int, w1 int, c0 int, c1 int, other long, hash long")


def _holders(docs: DataFrame, open_: DataFrame, least: int) -> DataFrame:
    """hash, lo, hi: of each open window the smallest and the largest document that has it. Every window of every document is
    tested against a filter of the open ones (beyond its size all are sent) and then counted with map-side combine."""
    held = bits_of(open_.select("hash"))

    def run(batches):
        claim("suffix_dedup")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, part in chunks(batch.column(1).to_pylist()):
                w = Words(part)
                if len(w.h) < least:
                    continue
                h, first = run_hashes(w.h, least), w.first
                d = np.searchsorted(first, np.arange(len(h)), "right") - 1  # texts without words share their first word's index with the next
                ok = np.arange(len(h)) + least <= first[d + 1]
                ok[ok] = in_bits(held, h[ok])
                yield pa.record_batch({"hash": pa.array(h[ok].view(np.int64)), "doc_id": pa.array(ids[at + d[ok]])})

    found = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, "hash long, doc_id long")
    return found.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")


def _hits(spark, suffixes: DataFrame, folder: str) -> DataFrame:
    """doc_id, pos, other, other_pos: suffixes with a neighbour, and that neighbour: the nearest before in the order, else the one after."""
    suffixes = materialise(spark, suffixes, folder, "suffixes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "pos"]
    near = materialise(spark, _neighbours(suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)), folder, "near")
    discard(spark, folder, "suffixes")
    # runs that a partition's edge cut: at most two edge rows a partition
    edges = near.where("kind = 2").groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("lo"), F.max(F.struct("doc_id", "pos")).alias("hi"))
    partner = F.when(F.col("lo.doc_id") != F.col("doc_id"), F.col("lo")).when(F.col("hi.doc_id") != F.col("doc_id"), F.col("hi"))
    loose = near.where("kind = 1").join(edges, "key").select("doc_id", "pos", partner.alias("o")).where("o is not null")
    return near.where("kind = 0").select("doc_id", "pos", "other", "other_pos").union(loose.select("doc_id", "pos", "o.doc_id", "o.pos"))


def _numbered(spark, docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with a number for each row in place of doc_id, and the numbers' doc_ids, where rows share a doc_id; else docs as they are."""
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        return docs, None
    rows = materialise(spark, docs.distinct().withColumn("row", F.monotonically_increasing_id()), folder, "rows")
    return rows.select(F.col("row").alias("doc_id"), "text"), rows.select("row", "doc_id")


def repeated_passages(docs: DataFrame, least_words: int = 50, block: int = 30, window: int = 20) -> DataFrame:
    """doc_id, start, end (code points), n_words, other_doc_id: the stretches of each document made of the passages of ``least_words``
    words or more that another document has too, joined where they meet. other_doc_id is one that shares a part.

    Words are runs between ASCII white space, A-Z lower-cased. Every window of least_words keeps its first minimiser within
    ``window`` words of its start, with a whole block, so each shared window is in a run of matches on both sides: either a chain of
    matches proves it, or it is looked up among the windows of all documents. Nothing shared is left out, and nothing is returned
    of which no other document has least_words in a row.

    Repeats inside one document alone don't count. Null or short texts give no rows; rows with a null doc_id are left out. Rows that
    share a doc_id are documents of their own, of equal ones one (their shared passages name that doc_id on both sides). Empty input: no rows.
    """
    if block + window > least_words:
        raise ValueError("block + window must not exceed least_words")
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    docs, ids = _numbered(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"), folder)
    hits = _hits(spark, _suffixes(docs, block, window), folder)
    runs = materialise(spark, hits.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "other", "other_pos")).alias("m")), folder, "runs")
    discard(spark, folder, "near")
    both = rows_of(docs, runs.select("doc_id")).join(runs, "doc_id")
    found = materialise(spark, _extend(both, least_words, block, window), folder, "found")
    discard(spark, folder, "runs")
    open_ = found.where("hash is not null")
    shared = open_.drop("other").join(_holders(docs, open_, least_words), "hash").select(
        "doc_id", "w0", "w1", "c0", "c1", F.when(F.col("lo") < F.col("doc_id"), F.col("lo")).otherwise(F.col("hi")).alias("other")
    )
    spans = found.where("hash is null").drop("hash").union(shared)
    # join what meets, inside each document; a document's spans are few, and copies of a passage are in different documents
    order = Window.partitionBy("doc_id").orderBy("w0", F.desc("w1"), "other")
    reach = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(reach >= F.col("w0"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("doc_id", "island").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.min("c0").alias("start"), F.max("c1").alias("end"), F.min("other").alias("other_doc_id"))
    out = joined.select("doc_id", "start", "end", (F.col("w1") - F.col("w0")).alias("n_words"), "other_doc_id")
    if ids is None:
        return out
    named = out.join(ids.withColumnRenamed("doc_id", "name"), F.col("doc_id") == F.col("row")).drop("doc_id", "row")
    return named.join(ids, F.col("other_doc_id") == F.col("row")).select(F.col("name").alias("doc_id"), "start", "end", "n_words", F.col("doc_id").alias("other_doc_id"))
