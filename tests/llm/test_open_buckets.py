"""Open buckets are compared in full, in blocks, whatever their size."""

import numpy as np
import pandas as pd

from ledgerlark.llm import minhash


def _roots(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_blocks_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(3)
    w = rng.uniform(1, 1.5, 1 << minhash.BUCKET_BITS)
    base = [rng.integers(0, 2**64, 40, dtype=np.uint64) for _ in range(12)]
    texts = [np.concatenate([base[i % 12][: rng.integers(30, 41)], rng.integers(0, 2**64, rng.integers(0, 6), dtype=np.uint64)]) for i in range(90)]
    sets = [minhash.elements(np.concatenate([t, t[:3]])) for t in texts]
    part = [i // 2 * 2 if i % 5 == 0 else i for i in range(90)]
    buckets = [(b, int(i), part[i]) for b in range(5) for i in rng.choice(90, [2, 7, 30, 60, 1][b], replace=False)]
    frame = spark.createDataFrame(buckets, "bucket long, key long, component long")
    held = spark.createDataFrame(pd.DataFrame({"key": range(90), "elements": [s.tobytes() for s in sets]}))
    shared = spark.sparkContext.broadcast(w)
    true = [(i, j) for b, i, _ in buckets for c, j, _ in buckets if b == c and i < j and minhash.weighted_jaccard(sets[i], sets[j], w) >= 0.8]
    joined = list(enumerate(part))
    assert _roots(90, joined + true) != _roots(90, joined)
    for block in (4, 512):
        got = [tuple(r) for r in minhash.linked_buckets(frame, held, shared, 0.8, block).collect()]
        assert {tuple(sorted(p)) for p in got} <= set(true)
        assert _roots(90, joined + got) == _roots(90, joined + true)


def test_similarities_of_a_block():
    rng = np.random.default_rng(5)
    w = rng.uniform(1, 1.5, 1 << minhash.BUCKET_BITS)
    pool = rng.integers(0, 2**64, 30, dtype=np.uint64)
    sets = [minhash.elements(rng.choice(pool, rng.integers(1, 60))) for _ in range(20)]
    index = minhash.SetIndex(sets, w)
    for s in sets:
        np.testing.assert_allclose(index.similarities(s), [minhash.weighted_jaccard(s, t, w) for t in sets])
