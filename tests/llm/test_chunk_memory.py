"""Chunks of a batch are found block by block: the same chunks, in little memory beside the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerlark.llm import exact_dedup as X


def _texts(n, size, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(map(chr, rng.integers(32, 127, int(k)))) for k in rng.integers(0, size, n)]


def test_blocks_do_not_move_a_cut():
    data = np.frombuffer("".join(_texts(40, 9000)).encode(), np.uint8)
    offsets = np.array([0, 0, 700, 90_000, len(data), len(data)])
    one = X.chunk_ends(data, offsets, block=1 << 30)
    assert sum(map(len, one)) > 20
    for block in (32, 999, 65_536):
        assert X.chunk_ends(data, offsets, block=block) == one


def test_a_batch_takes_a_few_blocks_of_memory():
    texts = ["", *(t * 12 for t in _texts(300, 9000)), "", _texts(1, 5000)[0] * 900, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    size = batch.nbytes
    assert size > 14 << 20
    tracemalloc.start()
    rows = 0
    for text, chunks in X._chunked(batch, 0):
        assert b"".join(chunks) == text == texts[rows].lower().encode()
        rows += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and most < 3 * size
