"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the folder that the driver has it in."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without the setting a temporary one, for a local master only."""
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return (folder or sc.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder under the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; Spark removes the files when nothing refers to the result any more."""
    shared_folder(with_package(df.sparkSession))
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_order(df: DataFrame, *by) -> DataFrame:
    """``df`` sorted throughout and written, with ``seq``: numbers that rise with the order, without gaps within a partition (from multiples of 2^33)."""
    return cut(df.orderBy(*by).withColumn("seq", F.monotonically_increasing_id()))
