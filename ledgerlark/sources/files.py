"""Sources of rules and news in files, and sinks that write tables by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.bars import upsert


def read_sections(spark: SparkSession, path: str, sections: dict[str, str]) -> dict[str, DataFrame]:
    """Each named array of a JSON file (or many) as a frame, by its schema; an absent section is empty. Lists are exploded by the executors."""
    schema = ", ".join(f"{name} array<struct<{fields}>>" for name, fields in sections.items())
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return {name: doc.select(F.explode(name).alias("r")).select("r.*") for name in sections}


def read_csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header line, by ``schema``; malformed numbers are null."""
    return spark.read.schema(schema).csv(path, header=True)


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several sources; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str] | None = None, fill: list[str] | None = None) -> str:
    """Write a next version of the Parquet table at ``path`` with ``new`` put in by key; returns the version's folder.

    Versions are folders v1, v2, ...; a version counts once its _SUCCESS mark is there, so readers and a lost job never see half a table.
    """
    old = read_version(spark, path)
    merged = new.dropDuplicates(keys) if old is None and not order else upsert(old if old is not None else new.limit(0), new, keys, order, fill)
    target = f"{path}/v{(_versions(spark, path) or [0])[-1] + 1}"
    merged.write.parquet(target)
    return target


def insert_new(spark: SparkSession, path: str, new: DataFrame, checksum: str) -> str:
    """Write a next version with the rows of ``new`` whose checksums the table does not hold, one row of each."""
    old, fresh = read_version(spark, path), new.dropDuplicates([checksum])
    if old is not None:
        fresh = old.unionByName(fresh.join(old.select(checksum), checksum, "left_anti"))
    target = f"{path}/v{(_versions(spark, path) or [0])[-1] + 1}"
    fresh.write.parquet(target)
    return target


def delete_from(spark: SparkSession, path: str, ids: DataFrame, key: str) -> str:
    """Write a next version without the rows of ``ids``."""
    target = f"{path}/v{_versions(spark, path)[-1] + 1}"
    read_version(spark, path).join(ids.select(key).distinct(), key, "left_anti").write.parquet(target)
    return target


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The given or the latest whole version; None if there is none."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{version or found[-1]}") if found else None


def _versions(spark: SparkSession, path: str) -> list[int]:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    marks = p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(m.getPath().getParent().getName()[1:]) for m in marks)


def with_retry(read: Callable[[int], DataFrame], tries: int = 3) -> DataFrame:
    """The first of ``tries`` reads that has rows; the number of the try is passed on, for a wider period or a longer wait."""
    for k in range(tries):
        df = read(k)
        if not df.isEmpty() or k == tries - 1:
            return df
    return df
