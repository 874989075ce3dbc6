"""Runs of words against a loop over every lag and word."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.llm import periodic
from ledgerlark.llm.queries import op13_periodic_runs

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def loop(w, min_exp=4, min_length=6):
    n, runs = len(w), {}
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(min_length, min_exp * q):
                runs.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in runs.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_documents_equal_the_loop(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, D).collect()}
    docs = pd.read_parquet(f"{D}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    some = 0
    for i, text in zip(docs.doc_id, docs.text):
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            w = w[:a] + [w[a + (j - a) % (1 + (n - a) // (3 + g % 8))] for j in range(a, n)]
        runs = loop(w)
        some += bool(runs)
        b = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert got[i] == (len(runs), *b, 1000 * b[1] // b[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept(w, runs))))
    assert len(got) == len(docs) and some > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6), st.integers(2, 5), st.integers(2, 8))
def test_runs_equal_the_loop(parts, min_exp, min_length):
    w = np.array([x for word, k in parts for x in word * k], np.int32)
    other = np.zeros(17, np.int32)
    got = periodic.runs_of([other, w, w[: len(w) // 2]], min_exp, min_length)
    for x, r in zip((other, w, w[: len(w) // 2]), got):
        assert periodic._ordered(r) == loop(x.tolist(), min_exp, min_length)
    # ranges of lags together give the same
    union = {}
    for k in range(3):
        for key, q in periodic.runs_of([w], min_exp, min_length, [(k, 3)])[0].items():
            union[key] = min(q, union.get(key, q))
    assert periodic._ordered(union) == loop(w.tolist(), min_exp, min_length)


def test_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(4000)) + " x" * 50
    rows = [(1, None), (2, ""), (None, "a b " * 5), (None, "a b " * 5), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (6, long), (7, "ü ü ü ü " * 4), (8, "y " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "row", "k", "runs", "start"):
        df = df.withColumn(c, F.lit("clash"))
    got = periodic.periodic_runs(df, split_bytes=1 << 12).collect()
    by = {(r.doc_id, r.n_words): [tuple(x) for x in r.runs] for r in got}
    assert len(got) == len(rows)
    assert by == {
        (1, 0): [], (2, 0): [], (None, 10): [(0, 10, 2)], (3, 0): [], (4, 5): [], (5, 6): [(0, 6, 1)],
        (6, 4050): [(0, 4000, 700), (4000, 50, 1)], (7, 8): [(0, 8, 1)], (8, 30_000): [(0, 30_000, 1)],
    }
    assert {bytes(r.collapsed) for r in got if r.doc_id in (None, 5, 8)} == {b"a b", b"a", b"y"}
    whole = periodic.periodic_runs(df, split_bytes=1 << 30).collect()
    assert sorted(map(str, whole)) == sorted(map(str, got))
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_words_of_long_texts_in_pieces(monkeypatch):
    raw = ("ab  c\td\x0be f " * 300).encode()
    want = raw.split()
    monkeypatch.setattr(periodic, "_PIECE", 64)
    known = {}
    ids = periodic.word_ids(raw, known)
    names = {v: k for k, v in known.items()}
    assert [names[i] for i in ids.tolist()] == want == [w.encode() for w in WORD.findall(raw.decode())]
