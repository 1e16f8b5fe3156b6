"""Streaming operators over an event stream, and their batch forms.

Each takes a streaming or a static DataFrame with ``ts``, ``user_id``, ``value`` and ``event_id``; watermarks bound the state.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A file stream of event Parquet; a restarted query goes on from its checkpoint."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Progress counters by window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Work sessions of a user, cut at pauses."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def ema(events: DataFrame, alpha: float = 0.3, bucket: str = "hour") -> DataFrame:
    """The smoothed rate of each user after the last event.

    Smoothing composes: a stretch of n events with the sum s of its weighted values turns a rate r into s + (1 - alpha)^n * r. So a user's
    events are summed by stretches of time, each in its own task, and the stretches are put together; no row holds a user's history."""
    q = 1 - alpha
    late = Window.partitionBy("user_id", "bucket").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events.select("user_id", "ts", "event_id", "value", F.date_trunc(bucket, "ts").alias("bucket")).withColumn("k", F.row_number().over(late) - 1)
    part = rows.groupBy("user_id", "bucket").agg(F.sum(alpha * F.pow(F.lit(q), "k") * F.col("value")).alias("s"), F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id", "value")).alias("first"))
    after = F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first event has no rate before it and counts whole
    g = part.withColumn("after", after).groupBy("user_id").agg(F.sum(F.col("s") * F.pow(F.lit(q), "after")).alias("s"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return g.select("user_id", (F.col("s") + q * F.pow(F.lit(q), F.col("n") - 1) * F.col("first.value")).alias("rate"))


def ema_stream(events: DataFrame, alpha: float = 0.3, idle: str = "1 day") -> DataFrame:
    """A15 as a stateful stream: (user_id, rate, n) after each micro-batch; state is one rate and a count a user, and ends when a user has
    been idle. A user's events of one micro-batch are put in order; maxFilesPerTrigger bounds them."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rate, n = state.get if state.exists else (None, 0)
        for v in pd.concat(list(frames)).sort_values(["ts", "event_id"])["value"]:
            rate = v if rate is None else alpha * v + (1 - alpha) * rate
            n += 1
        state.update((rate, n))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame({"user_id": [key[0]], "rate": [rate], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, rate double, n long", "rate double, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def grow_memory(replies: DataFrame, folder: str, late: str = "2 hours"):
    """T4: a translation memory that grows with a stream of replies (key, target, ts): each key once within the watermark, then merged into the memory in
    ``folder`` by micro-batch, the last reply of a key winning. A batch writes the version of its number, so one that is run again leaves the
    same memory. Returns a writer to be started with a checkpoint."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = memory_at(spark, folder, number)
        every = batch.select("key", "target", "ts") if old is None else old.unionByName(batch.select("key", "target", "ts"))
        every.groupBy("key").agg(F.max(F.struct("ts", "target")).alias("last")).select("key", "last.target", "last.ts").write.mode("overwrite").parquet(f"{folder}/version={number:09d}")

    return replies.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "target"]).writeStream.outputMode("append").foreachBatch(merge)


def memory_at(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the memory (before a batch's number); None without one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    found = [n for n in found if before is None or n < before]
    return spark.read.schema("key string, target string, ts timestamp").parquet(f"{folder}/version={max(found):09d}") if found else None


def ceiling(outcomes: DataFrame) -> DataFrame:
    """The batch size after each user's outcomes: one up after a success, and a failure sets a lasting ceiling below it.
    outcomes: user_id, ts, event_id, ok. A user's outcomes stream through one task in order; the state is two numbers."""
    placed = outcomes.select("user_id", "ts", "event_id", "ok").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(batches):
        user, size, cap = None, 1, 64
        for batch in batches:
            out = []
            for u, ok in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if u != user:
                    if user is not None:
                        out.append((user, size, cap))
                    user, size, cap = u, 1, 64
                if ok:
                    size = min(size + 1, cap)
                else:
                    size = cap = max(1, min(cap, size - 1))
            yield batch_of(out)
        if user is not None:
            yield batch_of([(user, size, cap)])

    def batch_of(out):
        columns = zip(*out) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["user_id", "size", "cap"])

    return placed.mapInArrow(run, "user_id long, size int, cap int")
