"""Counts of repeated shingles: similarities have no cap, and texts of one repeated word link by their true counts."""

import collections
import random

import numpy as np
import pytest

from ledgerlark.llm import minhash, shingles

FLAT = np.ones(1 << minhash.BUCKET_BITS, np.float32)


def packed(text):
    import pyarrow as pa

    (words,) = shingles.word_hashes(pa.array([text]))
    return minhash.elements(shingles.shingle_hashes(words))


@pytest.mark.parametrize("a, b", [(20_000, 200_000), (20_000, 26_000), (8_000, 10_400), (5, 6), (1, 1)])
def test_similarity_of_one_repeated_word(a, b):
    x, y = packed("buy " * (a + 4)), packed("buy " * (b + 4))
    assert minhash.weighted_jaccard(x, y, FLAT) == pytest.approx(a / b) == minhash.weighted_jaccard(y, x, FLAT)
    assert len(y) <= 4


def test_similarity_equals_exact_counts():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("a b c") for _ in range(rnd.randint(5, 400))) + " w" * rnd.randint(0, 60) for _ in range(30)]

    def bag(t):
        w = t.split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    for s in texts:
        for t in texts:
            a, b = bag(s), bag(t)
            assert minhash.weighted_jaccard(packed(s), packed(t), FLAT) == pytest.approx((a & b).total() / (a | b).total())


def test_links_by_true_counts(spark):
    """Twelve pairs under 0.8 and four over it, each of a word of its own."""
    rows, want = [], {}
    for k, (a, b) in enumerate([(20_000, 26_000), (20_000, 30_000)] * 6 + [(20_000, 22_000)] * 4):
        word = f"w{k:02d} "
        rows += [(2 * k, word * a), (2 * k + 1, word * b)]
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k if a / b >= 0.8 else 2 * k + 1
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want
