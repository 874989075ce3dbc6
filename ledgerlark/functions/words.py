"""Words of many texts at once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import with_package

_IN_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))


def _edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts and ends of the words in turn; no word reaches over an offset."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    out = np.empty(2 * int(first.sum()), np.int64)
    out[::2], out[1::2] = np.flatnonzero(first), np.flatnonzero(last) + 1
    return out


def word_spans(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows of ``batch``, about ``size`` bytes of their lower-case texts at a time, with their words (runs of ASCII letters, digits and _): a binary array of words
    (at even places) and what is between them, and the number of words of each row."""
    texts = batch.column(column).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        data, offsets = raw[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        at = _edges(data, offsets)
        spans = pa.Array.from_buffers(pa.large_binary(), max(len(at) - 1, 0), [None, pa.py_buffer(at if len(at) else np.zeros(1, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        yield batch.slice(row, to - row), spans, np.diff(np.searchsorted(at[::2], offsets))
        row = to


def distinct_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``w``: the distinct words of each row's text, in lower case; a null text has none."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, spans, n in word_spans(batch, 1):
                coded = spans.dictionary_encode()
                size = max(len(coded.dictionary), 1)
                keys = np.unique(np.repeat(np.arange(len(part)), n) * size + coded.indices.to_numpy()[::2])
                bounds = pa.array(np.searchsorted(keys, np.arange(len(part) + 1) * size), pa.int32())
                found = pc.take(coded.dictionary, pa.array(keys % size)).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds, found)], ["id", "w"])

    with_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    x = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    return x.mapInArrow(words, f"id {kind}, w array<string>").withColumnRenamed("id", id_col)
