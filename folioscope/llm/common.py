"""Shared pieces: shipping code, shared work folders, vectorised word hashing, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir

_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch that goes to a Python worker, where the session sets none; under Spark's own limit one batch may hold all texts of a split.
BATCH = "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it; batches that go there are small."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="folioscope-")) / "folioscope.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(os.fspath(out.resolve()))
    _SHIPPED.add(sc.applicationId)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Remove written tables that nothing reads any longer."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column | str) -> Column:
    """The rows no model learns from: crc32 of the id's decimal text leaves 1 when divided by 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(docs: DataFrame, columns: list[str], max_rows: int, max_bytes: int, marks: DataFrame | None = None, by: str | None = None) -> list:
    """At most ``max_rows`` rows and ``max_bytes`` of text, in the order of a hash of doc_id; with ``marks`` (doc_id and further
    columns) only documents that have a mark; with ``by`` each value of that column has an equal share of ``max_rows`` first.

    Two passes: ids, lengths and hashes first (no text is shuffled), then the texts of the chosen ones, a set bounded by ``max_rows``:
    rows that share a doc_id are told apart by their texts, and of equal ones a task sends one. A text that does not fit is passed over.
    """
    keys = ["doc_id", "b_", "h_"]
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", *dict.fromkeys(["text", *[c for c in [*columns, by] if c in docs.columns]]), F.octet_length("text").alias("b_"), F.xxhash64("text").alias("h_"))
    head = rows.select(*keys, *([F.col(by).alias("by_")] if by else []))
    if marks is not None:
        head = head.join(marks.select("doc_id").distinct(), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id", "b_", "h_"]
    if by:
        several = max(1, head.agg(F.approx_count_distinct("by_")).first()[0])
        # first among the rows of one in 64 parts of a value, so that a common value's rows are not ranked in one task
        for part in (["by_", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(64))], ["by_"]):
            head = head.withColumn("k_", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("k_") <= -(-max_rows // several))
    chosen, total = {}, 0
    for r in head.orderBy(*order).limit(max_rows).collect():
        if total + r.b_ <= max_bytes and tuple(r[:3]) not in chosen:
            total += r.b_
            chosen[tuple(r[:3])] = None
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(chosen), "doc_id long, b_ int, h_ long"))
    texts = rows.join(wanted, keys, "left_semi")
    if marks is not None:
        texts = texts.join(F.broadcast(marks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in marks.columns if c != "doc_id"])), "doc_id")
    own = texts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])
    return sorted(own.select("doc_id", *columns).collect(), key=lambda r: (r.doc_id, str(r)))


def give_back() -> None:
    """Memory that nothing holds any longer goes back to the system; Arrow's pool and the C heap would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HOLDS: dict[str, object] = {}
_RUNS: dict[str, str] = {}


def claim(owner: str, release=None) -> None:
    """In a Python worker: let go of the tables and the memory that other operators' tasks have kept there; ``release`` is called when another one runs."""
    if _RUNS.get("owner", owner) != owner:
        for other in [k for k in _HOLDS if k != owner]:
            _HOLDS.pop(other)()
        _POW.clear()
        give_back()
    _RUNS["owner"] = owner
    if release is not None:
        _HOLDS[owner] = release


# ---------------------------------------------------------------- vectorised hashing of words
P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
CHUNK = 1 << 19
_POW: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of plain words: white space, control and ASCII punctuation.
PUNCT = np.array([i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        m = max(n, CHUNK * 2)
        one = np.ones(1, np.uint64)
        _POW["p"] = np.concatenate([one, np.cumprod(np.full(m, P))])
        _POW["q"] = np.concatenate([one, np.cumprod(np.full(m, P_INV))])
    return _POW["p"], _POW["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: list[str | None], limit: int = CHUNK):
    """(first row, list of UTF-8 texts) with about ``limit`` bytes each; a longer text stands alone."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(b) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, held


class Words:
    """Hashes of the words of several texts: ``h`` (one uint64 a word), ``first`` (index of each text's first word, and the end)."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        b = self.bytes = LOWER[raw]
        sep = separators[b]
        edge = np.diff(sep.view(np.int8), prepend=np.int8(1))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        p, q = _powers(len(b) + 1)
        c = np.empty(len(b) + 1, np.uint64)
        c[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=c[1:])
        self.h = mix((c[self.end] - c[self.start]) * q[self.start])
        self.offset = np.concatenate([[0], np.cumsum(lens)])
        self.first = np.searchsorted(self.start, self.offset)

    def stems(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word (of a shorter word all it has)."""
        code = np.full(len(self.start), n, np.uint64)
        for k in range(n):
            at = self.start + k
            code = code * P + np.where(at < self.end, self.bytes[np.minimum(at, len(self.bytes) - 1)], 0).astype(np.uint64)
        return mix(code)

    def shingles(self, i: int, n: int) -> np.ndarray:
        """Distinct sorted hashes of the n-word shingles of text i; a shorter text is one shingle, an empty one none."""
        return shingle_set(self.h[self.first[i] : self.first[i + 1]], n)


_MULT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * _MULT[k]
    return mix(out)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """As ``rolling``, at the same cost for any n."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    p, q = _powers(len(h) + 1)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h | np.uint64(1)) * p[: len(h)])])
    return mix((c[n:] - c[:-n]) * q[: len(h) - n + 1])


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < n:
        return rolling(h, len(h))
    s = np.sort(rolling(h, n))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def connected_components(spark: SparkSession, edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b). Neighbour minimum with pointer jumping;
    each round is written to the shared folder, so no lineage grows and no link is held by the driver."""
    both = materialise(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, f"{name}-edges")
    labels = materialise(spark, both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), folder, f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = (
            labels.join(near, "node", "left").join(far, "label", "left")
            .select("node", F.least("label", F.coalesce("near", "label"), F.coalesce("far", "label")).alias("next"), F.col("label").alias("was"))
        )
        k += 1
        after = materialise(spark, step.select("node", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved")), folder, f"{name}-{k}")
        discard(spark, folder, f"{name}-{k - 1}")
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            discard(spark, folder, f"{name}-edges")
            return labels


#: 2**24 bits at least and 2**28 at most: 32 MB on the driver and in each worker, for up to 2**25 numbers at eight bits each.
BLOOM_LEAST, BLOOM_MOST = 18, 22


def bits_of(numbers: DataFrame):
    """A broadcast filter of the one (long) column of numbers, eight bits a number or more; None where they are more than 2**25."""
    name = numbers.columns[0]
    numbers = numbers.distinct()
    count = numbers.agg(F.approx_count_distinct(name)).first()[0]
    level = max(BLOOM_LEAST, int(np.ceil(np.log2(max(1, count) * 8 / 64))))
    if level > BLOOM_MOST:
        return None
    h = F.xxhash64(name)
    words = (
        numbers.select(F.shiftrightunsigned(h, 64 - level).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(xxhash64({name}) & 63 as int))").alias("bit"))
        .groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    bits = np.zeros(1 << level, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return numbers.sparkSession.sparkContext.broadcast(bits)


def in_bits(held, numbers: np.ndarray) -> np.ndarray:
    """Which numbers the filter may hold; all of them without a filter."""
    if held is None:
        return np.ones(len(numbers), bool)
    words = held.value
    h, low = _xxhash64(numbers.view(np.uint64)), np.uint64(63)
    level = np.uint64(64 - (len(words).bit_length() - 1))
    return ((words[(h >> level).astype(np.int64)].view(np.uint64) >> (h & low)) & np.uint64(1)).astype(bool)


def _xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long column (seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.uint64((42 + int(p5) + 8) & 0xFFFFFFFFFFFFFFFF) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def rows_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id is in the one column of ids, and maybe some others: a filter tests Arrow batches before any shuffle;
    where the ids are too many for it, the rows meet them in a join."""
    held = bits_of(ids)
    if held is None:
        return df.join(ids.distinct().select(F.col(ids.columns[0]).alias("doc_id")), "doc_id", "left_semi").select(*df.columns)
    at = df.columns.index("doc_id")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bits(held, batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64))))

    return df.where("doc_id is not null").mapInArrow(keep, df.schema)
