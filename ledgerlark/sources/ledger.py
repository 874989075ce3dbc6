"""Stores that outlive a run: documents with their chunks by checksum, and a cache of vectors by text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import delete_folder, with_package


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that are whole."""
    p, fs = _files(spark, f"{path}/whole")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of a table of all whole batches, with ``batch``; None before the first. What a broken run left is not read."""
    found = batches(spark, path)
    if not found:
        return None
    return spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/batch={b}" for b in found)).withColumn("batch", F.col("batch").cast("string"))


def _commit(spark: SparkSession, path: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """All tables of a batch are written, then one mark makes them whole together. A batch that was broken off is written anew."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    p, fs = _files(spark, f"{path}/whole/{batch}")
    fs.create(p, False).close()  # the file system lets one writer make it


def ingest(spark: SparkSession, path: str, batch: str, docs: DataFrame, chunks: Column, content: str = "content", source: str = "source") -> bool:
    """Put the documents of a batch that are new into the store at ``path``, with their chunks; False if the batch is whole already, and nothing was written.

    A document is known by the checksum of content and source; it is new if no whole batch holds that. Of equal ones in the
    batch one is put in: the least by all of its columns. Blank contents are left out, and blank chunks. Tables: ``documents`` (the columns of ``docs``, ``checksum``) and
    ``chunks`` (``checksum``, ``chunk``, ``content``). Both count from one mark on, so that a run broken off between them leaves neither, and a
    batch that is delivered again, whole or in part, gives no row twice. One writer at a time.
    """
    if batch in batches(spark, path):
        return False
    text = F.coalesce(content, F.lit(""))
    x = docs.where(F.trim(F.regexp_replace(text, r"\s", " ")) != "").withColumn("checksum", F.sha2(F.concat_ws(":", text, F.coalesce(source, F.lit(""))), 256))
    x = x.groupBy("checksum").agg(F.min(F.struct(*docs.columns)).alias("d")).select("d.*", "checksum")
    old = table(spark, path, "documents")
    if old is not None:
        x = x.join(old.select("checksum"), "checksum", "left_anti").select(*docs.columns, "checksum")
    delete_folder(spark, f"{path}/documents/batch={batch}")
    x.write.parquet(f"{path}/documents/batch={batch}")
    new = spark.read.parquet(f"{path}/documents/batch={batch}")  # read again, so that both tables hold the same documents
    parts = new.select("checksum", F.posexplode(chunks).alias("chunk", "content")).where(F.trim("content") != "")
    _commit(spark, path, batch, {"chunks": parts})
    return True


def embedded(spark: SparkSession, path: str, batch: str, texts: DataFrame, text_col: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], now: Column | None = None, days: int | None = None) -> DataFrame:
    """``texts`` with ``vector`` and ``cached``: vectors are taken from the cache at ``path``, and only texts that it lacks are embedded, each once.

    The cache is keyed by the text's SHA-256. Vectors older than ``days`` at the time ``now`` are made anew. New ones count once the batch is whole; a batch that is whole already
    is not written again, and a broken one is made anew. ``embed`` gets the texts of an Arrow batch. Blank texts have no vector.
    """
    with_package(spark)
    now = now if now is not None else F.current_timestamp()
    rows = texts.withColumn("_key", F.when(F.trim(F.coalesce(text_col, F.lit(""))) != "", F.sha2(F.col(text_col), 256)))

    def valid() -> DataFrame | None:
        t = table(spark, path, "vectors")
        if t is not None and days is not None:
            t = t.where(F.col("at") > now - F.make_dt_interval(days=F.lit(days)))
        return t if t is None else t.groupBy("_key").agg(F.max_by("vector", "at").alias("vector"), F.min("batch").alias("batch"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, v)) for v in embed(b.column(1).to_pylist())], pa.list_(pa.float64()))], ["_key", "vector"])

    if batch not in batches(spark, path):
        lacking = rows.where("_key is not null").groupBy("_key").agg(F.min(text_col).alias("t"))
        old = valid()
        lacking = lacking if old is None else lacking.join(old.select("_key"), "_key", "left_anti")
        _commit(spark, path, batch, {"vectors": lacking.mapInArrow(run, "_key string, vector array<double>").withColumn("at", now)})
    got = valid()
    out = rows.join(got, "_key", "left").withColumn("cached", F.col("batch") != batch)
    return out.select(*texts.columns, "vector", "cached")
