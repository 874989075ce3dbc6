"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot. Each edit makes a new version."""

    shards: tuple[int, ...]
    n_shards: int
    version: int = 1

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table at ``path``: version, n_shards, slot, shard."""
        rows = spark.range(1).select(F.posexplode(_numbers(self.shards)).alias("slot", "shard"))
        rows.select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), "slot", "shard").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("slot").collect()  # as many rows as there are slots
        return SlotMap(tuple(r.shard for r in rows), rows[0].n_shards, version)

    def rebalanced(self, weight: list[int], n_shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: slots move off overfull and removed shards to the lightest ones, and no others move."""
        n = n_shards or self.n_shards
        goal = sum(weight) / n * (1 + slack)
        load, held, homeless = [0] * n, [[] for _ in range(n)], []
        for slot, shard in enumerate(self.shards):
            if shard < n:
                load[shard] += weight[slot]
                held[shard].append(slot)
            else:
                homeless.append(slot)
        for shard in range(n):
            for slot in sorted(held[shard], key=lambda s: (weight[s], s)):
                if load[shard] <= goal:
                    break
                if weight[slot]:
                    load[shard] -= weight[slot]
                    homeless.append(slot)
        out = list(self.shards)
        _spread(homeless, weight, load, out)
        return SlotMap(tuple(out), n, self.version + 1)


def _spread(slots: list[int], weight: list[int], load: list[int], out: list[int]) -> None:
    """Heaviest slot first, each to the lightest shard."""
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(slots, key=lambda s: (-weight[s], s)):
        b, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (b + weight[slot], s))


def balanced_map(weight: list[int], n_shards: int) -> SlotMap:
    """First version for slots of the given bytes."""
    out = [0] * len(weight)
    _spread(list(range(len(weight))), weight, [0] * n_shards, out)
    return SlotMap(tuple(out), n_shards)


def _numbers(values) -> F.Column:
    """A constant array; one entry for each slot."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<bigint>")


def with_slots(df: DataFrame, id_col: str, text_col: str, n_slots: int) -> DataFrame:
    """``id``, ``size``, ``text_crc32`` and ``vslot`` of each row; rows without an id go by their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(crc, F.length(text))).otherwise(F.xxhash64(F.col(id_col)))
    return df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), crc.alias("text_crc32"), F.pmod(key, F.lit(n_slots)).cast("int").alias("vslot"))


def slot_sizes(slotted: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. At most ``n_slots`` rows reach the driver."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def current_map(spark: SparkSession, path: str, size: list[int], n_shards: int, slack: float) -> SlotMap:
    """The stored map's latest version if its shards' bytes are within ``slack`` of each other's mean; else an edited next version, which is stored. Without a stored map the first version deals the slots out."""
    sc = spark.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark):
        balanced_map([1] * len(size), n_shards).save(spark, path)
    stored = SlotMap.load(spark, path)
    load = [0] * n_shards
    for slot, k in enumerate(stored.shards):
        load[k % n_shards] += size[slot]
    if stored.n_shards != n_shards or max(load) > sum(load) / n_shards * (1 + slack):
        stored.rebalanced(size, n_shards, slack).save(spark, path)
    return SlotMap.load(spark, path)


def shard(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", n_slots: int = 4096, slot_map: SlotMap | None = None, map_path: str | None = None, slack: float = 0.001) -> DataFrame:
    """Each row's shard under the law ``bytes``: shards of nearly equal bytes.

    Ids are hashed into ``n_slots`` virtual slots; bytes are summed by slot; slots are
    dealt to shards by a map: a given one (its length is then the number of slots), or the
    one stored at ``map_path``, which is loaded, edited where shards have drifted apart by more than
    ``slack``, and stored as its next version, or else one built here.
    Returns ``id_col``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (the row's place in its shard, gapless from 0), ``grown_shard``
    (null under this law) and ``vslot``.

    A row's place is that of its virtual slot in the shard, from sums by slot, plus its
    rank in the slot, so no task orders more than one slot. Null texts count as empty;
    rows with null ids are dealt by their texts' checksums. Repeated rows each get a
    place. Other columns are left out. An empty table gives no rows.
    """
    n_slots = len(slot_map.shards) if slot_map else n_slots
    slotted = with_slots(df, id_col, text_col, n_slots)
    size, rows = slot_sizes(slotted, n_slots)
    if slot_map is None:
        slot_map = current_map(df.sparkSession, map_path, size, n_shards, slack) if map_path else balanced_map(size, n_shards)
    first, filled = [0] * n_slots, [0] * slot_map.n_shards
    for s, k in enumerate(slot_map.shards):
        first[s], filled[k] = filled[k], filled[k] + rows[s]
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size")) - 1
    return slotted.withColumn("rank", rank).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        _numbers(slot_map.shards)[F.col("vslot")].cast("int").alias("shard"),
        (_numbers(first)[F.col("vslot")] + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
