"""Shared helpers: scratch tables in the shared folder, Arrow batch size, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import with_package

#: Arrow batches sent to Python hold at most this many bytes (and Spark's own row limit).
ARROW_BATCH_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where the setting is absent, a temporary folder is set for a local master, as in
    tests; on a cluster that is an error, since executors could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return (folder or sc.getCheckpointDir()).rstrip("/")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, let workers find the package, and see to a checkpoint folder."""
    with_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    shared_folder(spark)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files.

    Spark removes the files when nothing refers to the result any more.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in a folder of the shared one: later steps read single columns of them, and each is deleted by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = prepare(spark), f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written, and read again."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                self._delete(t.scratch_path)

    def close(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a list of edges, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = (x[root[a] != root[b]] for x in (a, b))
    return nodes, nodes[root]


def connected_components(edges: DataFrame, scratch: Scratch, chunk: int = 1 << 21, rounds: int = 40) -> DataFrame:
    """Smallest id reachable from each node of an undirected graph.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node``, ``component`` for
    every node that occurs in an edge (self loops and nulls are left out). Tasks of at most
    ``chunk`` edges at a time first replace their edges by stars around the smallest
    node reached, which keeps an edge for each node at most. One task's stars are the
    answer; those of many go on in alternating large-star and small-star steps: each keeps
    at most one edge per input edge, so a hub never grows, and the depth of the trees
    halves; the loop ends when a pass changes nothing. Each pass is written to the
    shared folder. Only counts and a checksum reach the driver.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found():
            nodes, least = least_reachable(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= chunk:
                yield found()
                held, n = [], 0
        if n:
            yield found()

    real = scratch.keep(edges.where((F.col("a") != F.col("b"))).select("a", "b"))
    n = real.count()
    tasks = -(-n // chunk)
    e = scratch.keep(real.coalesce(max(1, tasks)).mapInArrow(stars, "u long, v long"))
    scratch.drop(real)
    seen = None
    for _ in range(rounds if tasks > 1 else 0):
        # large-star: every larger neighbour of u is linked to the least of u and its neighbours
        e1 = e.where("u != v").distinct()
        both = e1.unionAll(e1.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small-star: u and all smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        scratch.drop(e)
        e = after
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        if tasks > 1:
            raise RuntimeError(f"components not settled after {rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if tasks > 1:
        out = scratch.keep(found.unionAll(found.select(F.col("component").alias("node"), "component").distinct()))
        scratch.drop(e)
        return out
    found.scratch_path = e.scratch_path
    return found


def utf8_parts(array):
    """The bytes and row offsets of an Arrow string or binary array without nulls, as numpy arrays."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
