"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, prepare, text_or_empty, utf8_parts


def _gear() -> np.ndarray:
    """A number for each byte value, from a fixed multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(13)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_TABLE = _gear()
_WINDOW = 32
#: Bytes that are hashed, and rows' bytes that are taken from an Arrow batch, at a time.
_BLOCK = 1 << 20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def _places(data: np.ndarray, bits: int, block: int) -> np.ndarray:
    """Where a rolling hash of the last 32 bytes has ``bits`` leading zeros; ``block`` bytes at a time, each with the window before it."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), block):
        start = max(0, at - _WINDOW + 1)
        h = _TABLE[data[start : at + block]]
        step = 1
        while step < _WINDOW:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h, step = more, step * 2
        found.append(np.flatnonzero((h[at - start :] >> np.uint32(32 - bits)) == 0) + at + 1)
    return np.concatenate(found)


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int = 11, least: int = 256, most: int = 16384, block: int = _BLOCK) -> list[list[int]]:
    """Ends of the chunks of each row. A chunk ends where a rolling hash of the last 32 bytes has ``bits`` leading zeros.

    A row's cuts depend on its own bytes only: the first ``least`` bytes of a chunk are never cut.
    """
    places = _places(data, bits, block)
    first = np.searchsorted(places, offsets)
    out = []
    for i in range(len(offsets) - 1):
        start, end, ends = int(offsets[i]), int(offsets[i + 1]), []
        for p in [*places[first[i] : first[i + 1]].tolist(), end]:
            while p - start > most:
                start += most
                ends.append(start)
            if (p - start >= least or p == end) and p > start:
                ends.append(p)
                start = p
        out.append(ends)
    return out


def _chunked(batch: pa.RecordBatch, column: int):
    """For each row: its normalised bytes and its chunks. Rows are taken about ``_BLOCK`` bytes at a time, so that a batch's hashes never lie side by side."""
    whole, bounds = utf8_parts(batch.column(column))
    row = 0
    while row < len(batch):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _BLOCK, "right")) - 1)
        data, offsets = lower_ascii(whole[bounds[row] : bounds[to]]), bounds[row : to + 1] - bounds[row]
        raw = data.tobytes()
        for i, ends in enumerate(chunk_ends(data, offsets)):
            start = int(offsets[i])
            yield raw[start : int(offsets[i + 1])], [raw[a:b] for a, b in zip([start, *ends], ends)]
        row = to


def recipes(df: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """``id``, ``recipe`` (the chunks' digests in order, joined) and ``text_sha256`` of each row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, shas = [], []
            for text, chunks in _chunked(batch, 1):
                lists.append(b"".join(hashlib.sha256(c).digest()[:digest_bytes] for c in chunks))
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary()), pa.array(shas, pa.string())], ["id", "recipe", "text_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(build, f"id {kind}, recipe binary, text_sha256 string")


def clashes(df: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """Digests that stand for chunks of different bytes. Each distinct chunk is moved once for each task that meets it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = {c for _, chunks in _chunked(batch, 0) for c in chunks}
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(c).digest()[:digest_bytes] for c in met], pa.binary()), pa.array(list(met), pa.binary())], ["digest", "chunk"])

    chunks = df.select(text_or_empty(text_col).alias("text")).mapInArrow(build, "digest binary, chunk binary")
    return chunks.groupBy("digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a != b").select("digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """Groups of rows whose texts are equal but for the case of A-Z; the row with the largest id stays.

    Texts are cut into content-defined chunks. A chunk's identifier is a digest that
    has been verified: all chunks are compared by their bytes under each digest, and if
    two differ, the digest is made longer and the work repeated. Documents are then
    compared by their ordered identifier lists alone, so long documents move once, as
    distinct chunks, however many copies there are.

    Returns for each row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Null texts count as empty, and all empty texts form one group. A null id is never
    kept beside others; a group of null ids only has keep_id null and is kept. Rows
    that repeat an id are one document listed twice and share its verdict. Other
    columns are left out. An empty table gives no rows.
    """
    prepare(df.sparkSession)
    while not clashes(df, text_col, digest_bytes).isEmpty():
        if digest_bytes >= 32:
            raise ValueError("different chunks share a SHA-256 digest")
        digest_bytes *= 2
    lists = cut(recipes(df, id_col, text_col, digest_bytes))
    # written out, so that both sides of the join are plain exchanges and Spark can split a large group's rows
    groups = cut(lists.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    return lists.join(groups, "recipe").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
