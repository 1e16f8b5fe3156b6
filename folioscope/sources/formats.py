"""Formats by file name: which reader and writer serve a path, as a column and for the driver's own reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"layout": ["pdf"], "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"], "book": ["epub"], "office": ["docx"], "html": ["html", "htm"], "text": ["txt"], "csv": ["csv", "tsv"], "json": ["json", "jsonl"], "parquet": ["parquet"]}
WRITERS = {"layout": ["pdf"], "image": ["png", "jpg", "jpeg"], "book": ["epub"], "office": ["docx"], "html": ["html"], "text": ["txt"], "csv": ["csv", "tsv"], "json": ["json", "jsonl"], "parquet": ["parquet"]}
#: Documents and images that a run accepts.
SUPPORTED = [*READERS["layout"], *READERS["image"], *READERS["book"], *READERS["office"], *READERS["html"]]
#: Formats that Spark reads and writes itself.
TABULAR = {"text", "csv", "json", "parquet"}


def ending(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def _by_ending(table: dict[str, list[str]], name: Column) -> Column:
    return F.coalesce(*[F.when(ending(name).isin(*v), F.lit(k)) for k, v in table.items()])


def reader_of(name: Column) -> Column:
    """Null for an unknown ending."""
    return _by_ending(READERS, name)


def writer_of(name: Column) -> Column:
    """K1: null for an unknown ending."""
    return _by_ending(WRITERS, name)


def is_supported(name: Column) -> Column:
    """S2."""
    return ending(name).isin(*SUPPORTED)


def _named(path: str, table: dict[str, list[str]]) -> tuple[str, str]:
    end = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    kind = next((k for k, v in table.items() if end in v), None)
    if kind is None:
        raise ValueError(f"unknown format: {path}")
    if kind not in TABULAR:
        raise NotImplementedError(f"{kind} files need a reader of their own: {path}")
    return kind, end


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its path's ending; an unknown one raises."""
    kind, end = _named(path, READERS)
    r = spark.read.format(kind)
    return (r.option("header", True).option("sep", "\t" if end == "tsv" else ",") if kind == "csv" else r).load(path)


def write_any(df: DataFrame, path: str) -> None:
    """K1: a table to a path by its ending; an unknown one raises."""
    kind, end = _named(path, WRITERS)
    w = df.write.mode("overwrite").format(kind)
    (w.option("header", True).option("sep", "\t" if end == "tsv" else ",") if kind == "csv" else w).save(path)
