"""Repeated passages against a count of every string."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import repeats as R
from ledgerlark.llm.queries import op12_repeats

D = "/root/testdata/sf0.001"


def brute(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        yield len(t), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(t, np.uint8)[~gone])


def found(df, length):
    return [(r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in sorted(R.repeats(df, length=length).collect(), key=lambda r: r.doc_id)]


def pieces_of_passages(rnd):
    def word():
        return "".join(rnd.choice("abcdéf") for _ in range(rnd.randint(1, 6)))

    base = [" ".join(word() for _ in range(400)) for _ in range(4)]
    out = []
    for _ in range(100):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            b = rnd.choice(base)
            i = rnd.randint(0, len(b) - 1)
            text += b[i : i + rnd.randint(50, 700)] + " ".join(word() for _ in range(rnd.randint(0, 30)))
        out.append(text)
    return out + ["a" * 1500, "ab" * 900, "xyz" * 300 + "a" * 700, "", None, out[5], out[5], out[7] + "!", "one two three " * 200, "a" * 63, "a" * 64]


@pytest.mark.parametrize("length", [400, 64])
def test_passages_equal_brute_force(spark, length):
    texts = pieces_of_passages(random.Random(length))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("key", F.lit("clash")).withColumn("at", F.lit(1))
    want = list(brute([(t or "").encode() for t in texts], length))
    assert found(df, length) == want and sum(len(w[1]) for w in want) > 50


def test_documents_equal_brute_force(spark):
    docs = pd.read_parquet(f"{D}/documents.parquet").sort_values("doc_id")
    want = list(brute([(t or "").encode() for t in docs.text], 400))
    got = op12_repeats(spark, D).toPandas().sort_values("doc_id")
    assert got.n_removed.tolist() == [sum(b - a for a, b in w[1]) for w in want] and got.n_spans.tolist() == [len(w[1]) for w in want]
    import hashlib

    assert got.kept_sha256.tolist() == [hashlib.sha256(w[2]).hexdigest() for w in want]


def test_long_texts_in_parts(spark, monkeypatch):
    # parts of a long text overlap: strings across their ends are found too; the small chunk holds on the workers through the closure of a local master
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    data = np.frombuffer((text + text[1000:3000]).encode(), np.uint8)
    whole = R.anchors(data, np.array([0, len(data)]), 400, 128)
    monkeypatch.setattr(R, "_CHUNK", 1024)
    parts = R.anchors(data, np.array([0, len(data)]), 400, 128)
    starts = [sorted({int(p) - o for p, lo, hi in zip(*R._unpacked(x[2])) for o in range(lo, hi + 1)}) for x in (whole, parts)]
    assert starts[0] == starts[1] == list(range(len(data) - 399))
    assert {(int(n), int(a) >> 24) for n, a in zip(whole[1], whole[2])} <= {(int(n), int(a) >> 24) for n, a in zip(parts[1], parts[2])}


def test_edges(spark):
    rows = [(None, "x" * 500), (1, None), (1, ""), (2, "short"), (3, "x" * 399)]
    got = {(r.doc_id, r.n_bytes, len(r.spans), len(r.kept)) for r in R.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 500, 1, 0), (1, 0, 0, 0), (2, 5, 0, 5), (3, 399, 0, 399)}
    assert R.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        R.repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=63)


def test_names_are_of_bytes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 400).astype(np.uint8)
    a, b = R.Names(np.concatenate([x, x[::-1]])), R.Names(np.concatenate([x[::-1], x, x]))
    i = np.arange(0, 300)
    for lane in (0, 1):
        assert (a.of(i, i + 60, lane) == b.of(i + 400, i + 460, lane)).all() and (b.of(i + 800, i + 860, lane) == b.of(i + 400, i + 460, lane)).all()
        assert len(np.unique(a.of(i, i + 60, lane))) == 300
