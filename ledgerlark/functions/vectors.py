"""Vector functions over arrays, inside the JVM but for vectors of hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import with_package


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has length zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))) / n).otherwise(0.0)


def normalised(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def fitted(v: Column, dims: int) -> Column:
    """Cut or filled with zeros to ``dims`` numbers."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dims)), 1, dims)


def relevance(distance: Column) -> Column:
    """1 - d up to a distance of 1, then 1 / (1 + d)."""
    return F.when(distance <= 1, F.greatest(F.lit(0.0), 1 - distance)).otherwise(1 / (1 + distance))


def hashed_words(df: DataFrame, id_col: str, words: Column, dims: int = 256, vector: str = "embedding") -> DataFrame:
    """``id_col`` and a vector of ``dims`` numbers for each row: each distinct word adds 1 or -1 in the dimension that its hash names. Rows without words have null; ids are unique."""
    with_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                h = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(len(n)), n) * dims + h % dims
                x = np.bincount(place, np.where(h >> 40 & 1, -1.0, 1.0), len(n) * dims)
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x), mask=pa.array(n == 0))], ["id", "v"])

    hashes = F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))
    return df.select(id_col, hashes).mapInArrow(run, f"id {kind}, v array<double>").toDF(id_col, vector)
