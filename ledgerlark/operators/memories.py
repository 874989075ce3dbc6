"""Consolidation of memories: an ordered greedy cover by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.vectors import norm
from ledgerlark.session import cut, in_order, with_package


def _packed(df: DataFrame, vector: str) -> DataFrame:
    """``vector`` (an array of doubles) as the bytes of its numbers; null numbers become NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            v = batch.column(at)
            numbers = np.asarray(v.flatten().to_numpy(zero_copy_only=False), float)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends * 8), pa.py_buffer(numbers)])
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if f.name == vector else f.dataType.simpleString()}" for f in df.schema))


def _unit(vectors) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _first_alike(rows: np.ndarray, kept: np.ndarray, threshold: float, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first kept vector that is alike, or -1, and the similarity; no more than ``size`` squared similarities are held at once."""
    first, sim = np.full(len(rows), -1), np.full(len(rows), np.nan)
    for lo in range(0, len(kept), size):
        open_rows = np.flatnonzero(first < 0)
        for at in (open_rows[i : i + size] for i in range(0, len(open_rows), size)):
            s = rows[at] @ kept[lo : lo + size].T
            alike = s >= threshold
            k, some = alike.argmax(1), alike.any(1)
            first[at[some]], sim[at[some]] = lo + k[some], s[some, k[some]]
    return first, sim


def greedy_cover(vectors: np.ndarray, threshold: float, size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """In the order given, each row joins the first kept row that is alike, or is kept: its position, and the similarity (1 for itself)."""
    of, sim, kept = np.full(len(vectors), -1), np.ones(len(vectors)), np.zeros(0, int)
    for lo in range(0, len(vectors), size):
        x = vectors[lo : lo + size]
        first, s = _first_alike(x, vectors[kept], threshold)
        joins = first >= 0
        of[lo : lo + size][joins], sim[lo : lo + size][joins] = kept[first[joins]], s[joins]
        rest = np.flatnonzero(~joins)
        among = x[rest] @ x[rest].T
        for i, r in enumerate(rest):
            if of[lo + r] < 0:
                of[lo + r] = lo + r
                later = rest[i + 1 :]
                near = (among[i, i + 1 :] >= threshold) & (of[lo + later] < 0)
                of[lo + later[near]], sim[lo + later[near]] = lo + r, among[i, i + 1 :][near]
        kept = np.concatenate([kept, lo + rest[of[lo + rest] == lo + rest]])
    return of, sim


def covers(df: DataFrame, user: str = "user_id", id_col: str = "id", vector: str = "embedding", importance: str = "importance_score", threshold: float = 0.85, block: int = 16384) -> DataFrame:
    """For each row with a vector: ``user``, ``id_col``, ``kept_id``, ``similarity``, ``place`` (rising in the user's order).

    A user's rows are taken by falling importance, ties by id. Each joins the first kept row whose cosine is at least ``threshold``, else it
    is kept itself; only kept rows gather others, so this is not a matter of connected components.

    Rows of a user with the same vector share the fate of the first of them: what that joins is the first alike for all, and if it is kept, they join it. So only first ones are
    compared. They are sorted throughout and dealt into blocks of at most ``block`` (a power of two). A round takes each user's next block: it is
    covered greedily by itself, and what it keeps is held against the user's later blocks, each in a task of its own; rows that join leave. So a user
    with a block or less needs one round, and a user with any number of rows never meets in one task. The similarities that are computed grow with kept rows times rows of a user.
    Zero vectors are like nothing. Vectors of a user have one length. Null users are one user.
    """
    with_package(df.sparkSession)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(user).alias("u"), F.col(id_col).alias("id"), F.col(importance).alias("w"), F.col(vector).cast("array<double>").alias("v"))
    n = norm(F.col("v"))
    rows = _packed(rows.withColumn("like", (n > 0) & (n < float("inf"))), "v").withColumn("h", F.when(F.col("like"), F.sha2("v", 256))).drop("like")
    rows = in_order(cut(rows), "u", F.desc_nulls_last("w"), "id").drop("w").withColumnRenamed("seq", "place")  # a sort reads its rows twice
    rows = rows.withColumn("h", F.coalesce("h", F.col("place").cast("string")))  # a vector that is like nothing stands alone
    same = cut(rows.groupBy("u", "h").agg(F.min("place").alias("first")))
    firsts = rows.join(same.select(F.col("first").alias("place")), "place")
    firsts = in_order(firsts, "place").withColumn("block", F.shiftright("seq", block.bit_length() - 1))
    blocks = firsts.select("u", "block").distinct().withColumn("round", F.dense_rank().over(Window.partitionBy("u").orderBy("block")))
    open_rows = firsts.drop("seq").join(blocks.withColumnRenamed("u", "u2"), ["block"]).where(F.col("u").eqNullSafe(F.col("u2"))).drop("u2")
    rounds = blocks.agg(F.max("round")).first()[0] or 0
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    found_kind = f"u {kind['u']}, id {kind['id']}, place long, kept_id {kind['id']}, similarity double"

    def cover(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place").reset_index(drop=True)
        of, sim = greedy_cover(_unit(f["v"]), threshold)
        out = f.assign(kept_id=f["id"].to_numpy()[of], similarity=sim, v=[v if o == i else None for i, (v, o) in enumerate(zip(f["v"], of))])
        return out[["u", "id", "place", "kept_id", "similarity", "v"]]

    def join(rest: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if len(rest) and len(kept):
            kept = kept.sort_values("place")
            first, sim = _first_alike(_unit(rest["v"]), _unit(kept["v"]), threshold)
            joins = first >= 0
            rest = rest.assign(kept_id=pd.Series(kept["id"].to_numpy()[first], index=rest.index).where(joins), similarity=sim, joins=joins)
        else:
            rest = rest.assign(kept_id=None, similarity=np.nan, joins=False)
        return rest[["u", "id", "place", "block", "round", "v", "kept_id", "similarity", "joins"]]

    found = []
    for k in range(1, rounds + 1):
        head = open_rows.where(F.col("round") == k).groupBy("u").applyInPandas(cover, f"{found_kind}, v binary")
        if k == rounds:
            found.append(head.drop("v"))
            break
        head = cut(head)
        found.append(head.drop("v"))
        rest = open_rows.where(F.col("round") > k)
        to = rest.select("u", "block").distinct()
        kept = head.where("v is not null").join(to.withColumnRenamed("u", "u2"), F.col("u").eqNullSafe(F.col("u2"))).select("u", "block", "id", "place", "v").toDF("u", "block", "id", "place", "v")
        met = cut(rest.groupBy("u", "block").cogroup(kept.groupBy("u", "block")).applyInPandas(join, f"u {kind['u']}, id {kind['id']}, place long, block long, round int, v binary, kept_id {kind['id']}, similarity double, joins boolean"))
        found.append(met.where("joins").select("u", "id", "place", "kept_id", "similarity"))
        open_rows = met.where("not joins").select("u", "id", "place", "block", "round", "v")
    out = rows.sparkSession.createDataFrame([], found_kind) if not found else found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    out = cut(out.select("place", "kept_id", "similarity"))
    of = same.toDF("u2", "h2", "first")
    fate = rows.select("u", "id", "place", "h").join(of, (F.col("h") == F.col("h2")) & F.col("u").eqNullSafe(F.col("u2")))
    fate = fate.select("u", "id", F.col("place").alias("own"), F.col("first").alias("place")).join(out, "place")
    return fate.select(F.col("u").alias(user), F.col("id").alias(id_col), "kept_id", "similarity", F.col("own").alias("place"))


def consolidated(df: DataFrame, cover: DataFrame, user: str = "user_id", id_col: str = "id", tags: str = "tags", metadata: str = "metadata", count: str = "access_count") -> DataFrame:
    """The rows that stay, by ``cover`` (see :func:`covers`), with what they gather.

    ``count`` grows by the counts of all that join. Tags and metadata are a row's own with those of the last row that joins it (its keys win), as each
    merge writes them anew over the row as it was read. Rows without a vector are not in ``cover`` and stay as they are.
    """
    joined = df.join(cover.where(F.col(id_col) != F.col("kept_id")).select(id_col, "kept_id", "place"), id_col)
    last = lambda c: F.max_by(c, "place")
    gains = joined.groupBy(F.col("kept_id").alias(id_col)).agg(F.sum(count).alias("_n"), last(F.coalesce(tags, F.array())).alias("_tags"), last(metadata).alias("_meta"), F.count("*").cast("int").alias("removed"))
    gone = joined.select(id_col)
    x = df.join(gone, id_col, "left_anti").join(gains, id_col, "left")
    more = F.coalesce(F.col("_meta"), F.expr(f"map_filter({metadata}, (k, v) -> false)"))
    own = F.expr(f"map_filter({metadata}, (k, v) -> not coalesce(map_contains_key(_meta, k), false))")
    return x.select(
        user, id_col, *(c for c in df.columns if c not in {user, id_col, tags, metadata, count}),
        F.array_sort(F.array_union(F.coalesce(tags, F.array()), F.coalesce("_tags", F.array()))).alias(tags),
        F.map_concat(own, more).alias(metadata), (F.col(count) + F.coalesce("_n", F.lit(0))).alias(count), F.coalesce("removed", F.lit(0)).alias("removed"),
    )
