"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, text_or_empty
from .bpe import encoder


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has over ``limit`` tokens.

    ``tokenizer`` is the path of a tokenizers file that every executor can read.
    Arrow batches are bounded by bytes rather than rows; long texts are cut at safe
    boundaries only, so counts are those of the whole text. No special tokens are
    added; special strings inside a text count as the library's default has it.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids are kept. Repeated rows
    give repeated results. Other columns are left out. Empty tables give no rows.
    """
    prepare(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).cast(pa.int64())
            n = pa.array([len(enc.ids(t.as_py())) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
