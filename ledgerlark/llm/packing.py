"""Packing documents into sequences along a Hilbert curve of their hashed vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, prepare, text_or_empty
from .bpe import encoder

#: Hashed vector: this many buckets, projected to so many dimensions of so many bits.
BUCKETS, DIMS, BITS = 1024, 3, 20


def projection(seed: int = 5) -> np.ndarray:
    """A seeded Gaussian projection of hashed vectors."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Counts of hashed token ids, damped by a square root, of length 1; zero for no ids."""
    at = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    v = np.sqrt(np.bincount(at.astype(np.int64), minlength=BUCKETS))
    n = np.linalg.norm(v)
    return v / n if n else v


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits, one row a point.

    The coordinates are turned into the curve's transposed form from the highest bit
    down (reflect or swap axes by each bit), Gray-decoded, and their bits interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[-1] & (1 << b), t ^ ((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """Hilbert keys of unit vectors. A projection of the mean direction is as good as fixed, so the spread about it is stretched over the grid."""
    p = vectors @ proj
    scaled = 1 / (1 + np.exp(-np.clip(1.7 * p, -30, 30)))
    return hilbert_key(np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _encoded(df: DataFrame, tokenizer: str, id_col: str, text_col: str, room: int, end_id: int) -> DataFrame:
    """For each row: number of ids, curve key, checksums of its whole sequences, and the ids of its tail."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, proj = encoder(tokenizer), projection()
        for batch in batches:
            n, vectors, sums, tails = [], [], [], []
            for text in batch.column(1):
                ids = enc.ids(text.as_py())
                vectors.append(hashed_vector(ids))
                ids = np.append(ids, enc.dtype.type(end_id))
                whole = len(ids) // room * room
                n.append(len(ids))
                wide = ids[:whole].astype("<u4").tobytes()
                sums.append([zlib.crc32(wide[i : i + 4 * room]) for i in range(0, len(wide), 4 * room)])
                tails.append(ids[whole:].tobytes())
            keys = curve_keys(np.array(vectors), proj) if vectors else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["id", "n", "key", "sums", "tail"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(encode, f"id {kind}, n long, key long, sums array<long>, tail binary")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of at most ``room`` tokens; documents near each other on the curve share sequences.

    A document's ids (without special tokens) and ``end_id`` are cut into whole
    sequences and a tail. Its hashed token vector, projected to a few dimensions, has a
    place on a Hilbert curve; documents are range-sorted by that place, and the tails are
    laid end to end along it, cut where a sequence is full. Only the last sequence of each
    range is partly empty. The encoded rows are written once to the checkpoint folder, so
    that neither finding the ranges nor a lost executor encodes a text again. Rows of one
    key are split over ranges by id, so a large group of copies is no hot spot.

    Returns ``id_col``, ``start``, ``length``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers), ``doc_tokens``, ``sequence_id``, ``offset``. Null and empty
    texts are documents of the end id alone. Null ids and repeated rows are packed like
    any others. Other columns are left out. An empty table gives no rows.
    """
    prepare(df.sparkSession)
    rows = cut(_encoded(df, tokenizer, id_col, text_col, room, end_id))
    along = rows.repartitionByRange(F.col("key"), F.col("id"), F.col("n")).sortWithinPartitions("key", "id", "n")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        width = encoder(tokenizer).dtype.itemsize
        dtype, current, used, fresh = encoder(tokenizer).dtype, base, 0, base + 1
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]

            def put(*piece):
                for c, v in zip(out, piece):
                    c.append(v)

            for i, n, sums, tail in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "sums", "tail"))):
                for k, crc in enumerate(sums):
                    put(i, k * room, room, crc, n, fresh, 0)
                    fresh += 1
                start, at, left = len(sums) * room, 0, len(tail) // width
                while left:
                    take = min(left, room - used)
                    wide = np.frombuffer(tail, dtype, take, at * width).astype("<u4").tobytes()
                    put(i, start + at, take, zlib.crc32(wide), n, current, used)
                    at, left, used = at + take, left - take, used + take
                    if used == room:
                        current, used, fresh = fresh, 0, fresh + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([], pa.int64())) if not out[0] else pa.array(out[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    out = along.mapInArrow(fill, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
