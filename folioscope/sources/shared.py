"""The shared work folder of a cluster, and lineage cut by writing there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the cluster's shared checkpoint folder. Its own folder only where none is named and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_dir.get() if set_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-shared-")
    return f"{base.rstrip('/')}/folioscope-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back with the known schema."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
