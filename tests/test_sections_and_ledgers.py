"""Chunkers against loops on whole texts; stores that are run again, and after a run that broke off."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import sections as C
from ledgerlark.functions import text as T
from ledgerlark.plans import knowledge
from ledgerlark.sources import ledger

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{D}/documents.parquet")


def loop_of_vectors(s, embed, most, back, threshold):
    out, start = [], 0
    for i in range(back, len(s)):
        a, b = (np.array(embed(x), np.float32) for x in (s[i - back], s[i]))
        n = np.linalg.norm(a) * np.linalg.norm(b)
        cosine = float(a @ b / n) if n else 0.0
        if (cosine < threshold or len(" ".join(s[start : i + 1])) >= most) and i > start:
            out.append(" ".join(s[start:i]))
            start = i
    return out + ([" ".join(s[start:])] if s else [])


def test_vector_chunks_equal_the_loop(docs):
    for t in docs.text.dropna().iloc[:60]:
        s = T.sentences(t)[:200]
        for embed, threshold, most, back in ((C.word_vector, 0.5, 2048, 3), (C.word_vector, 0.3, 200, 1), (lambda x: C.seeded_vector(x, 8), 0.0, 500, 2)):
            assert C.vector_chunks(s, embed, most, back, threshold) == loop_of_vectors(s, embed, most, back, threshold)
    assert C.vector_chunks([], C.word_vector) == [] and C.vector_chunks(["a", "b"], C.word_vector) == ["a b"]
    assert C.vector_chunks(["", "", "", "", ""], C.word_vector) == ["  ", "", ""]


def test_seeded_vectors():
    v = C.seeded_vector("text", 4)
    assert v == C.seeded_vector("text", 4) != C.seeded_vector("Text", 4) and all(-1 <= x <= 1 for x in v)
    assert v == C.seeded_vector("text", 9)[:4]


def test_reports():
    text = "Before it all.\n\n## Risk Factors\nFirst body.\n\nStill.\n2. outlook for years\nbody two\n### Net Loss\n\n# No heading\nx" + " word" * 900
    got = C.report_sections(text)
    assert [h for h, _ in got] == ["", "## Risk Factors", "2. outlook", "### Net Loss"]
    squeeze = lambda x: re.sub(r"\s+", "", x)
    assert squeeze("".join(h + b for h, b in got)) == squeeze(text)
    chunks = C.report_chunks(text, 300, 0)
    assert chunks[0] == "## Risk Factors\nFirst body.\n\nStill." and chunks[1] == "2. outlook\nfor years\nbody two" and chunks[2].startswith("### Net Loss\n# No heading")
    assert all(len(c) <= 300 + len("### Net Loss\n") for c in chunks) and squeeze("".join(C.report_chunks(text, 300, 0, lead=True))) == squeeze(text)
    assert C.report_chunks("plain", 300) == ["plain"] and C.report_chunks("# Revenue\n") == []


def test_headlines(docs):
    assert C.headline_chunks("\n Title \n\na\n\nb\n") == ["[Headline: Title]\n\na\n\nb"] and C.headline_chunks("only") == ["only"] and C.headline_chunks("") == [""]
    for t in docs.text.dropna().iloc[:40]:
        news = "The headline\n" + re.sub(r"(?<=\.) ", "\n\n", t)
        chunks = C.headline_chunks(news, 400, 0)
        head = "[Headline: The headline]\n\n"
        assert all(c.startswith(head) and len(c) <= 400 + len(head) for c in chunks)
        body = "".join(c[len(head) :] for c in chunks)
        assert re.sub(r"\W+", "", body) == re.sub(r"\W+", "", news[len("The headline\n") :])


def test_packed_sections(spark, docs):
    def loop(text, size):
        chunks, held = [], ""
        for s in filter(None, (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x) for x in re.split(r"\n{2,}", text))):
            if held and len(held) + len(s) + 2 > size:
                chunks.append(held)
                held = s
            else:
                held = f"{held}\n\n{s}" if held else s
        return chunks + [held] * bool(held)

    texts = [re.sub(r"(?<=\.) ", "\n\n", t) for t in docs.text.dropna()] + ["", None, "\n\n \n\n", "a" * 500 + "\n\nb", "\n\na\n\n\n\nb\n\n"]
    rows = [(f"u{i}" if i % 5 else None, "t", t) for i, t in enumerate(texts)]
    got = {}
    for r in C.packed_sections(spark.createDataFrame(rows, "u string, t string, c string"), "u", "t", "c", 300).orderBy("chunk").collect():
        assert r.doc_id == hashlib.sha256(f"{r.source}:t:{r.chunk}".encode()).hexdigest()[:24]
        got.setdefault((r.source, r.chunk), []).append(r.content)
    want = {}
    for u, _, t in rows:
        for k, c in enumerate(loop(t or "", 300)):
            want.setdefault((u or "", k), []).append(c)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(c) <= 300 or "\n\n" not in c for v in got.values() for c in v)


def test_ingest_again_and_after_a_break(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = [(1, "same text", "s"), (2, "same text", "s"), (3, "same text", "other"), (4, " \n", "s"), (5, None, "s"), (6, "one two", None)]
    docs = spark.createDataFrame(rows, "id int, content string, source string")
    chunks = F.split("content", " ")
    assert ledger.ingest(spark, path, "a", docs.where("id < 4"), chunks)
    assert not ledger.ingest(spark, path, "a", docs, chunks)
    # a run that breaks off between documents and chunks leaves nothing that counts
    with monkeypatch.context() as m:
        m.setattr(ledger, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.ingest(spark, path, "b", docs, chunks)
    assert ledger.table(spark, path, "documents").count() == 2 and ledger.batches(spark, path) == ["a"]
    assert ledger.ingest(spark, path, "b", docs, chunks)
    assert ledger.ingest(spark, path, "c", docs, chunks)
    assert sorted((r.id, r.batch) for r in ledger.table(spark, path, "documents").collect()) == [(1, "a"), (3, "a"), (6, "b")]
    assert sorted((r.chunk, r.content, r.batch) for r in ledger.table(spark, path, "chunks").collect()) == [(0, "one", "b"), (0, "same", "a"), (0, "same", "a"), (1, "text", "a"), (1, "text", "a"), (1, "two", "b")]


def test_vectors_are_made_once(spark, tmp_path):
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")

    def embed(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t))] for t in texts]

    day = lambda n: F.lit(f"2024-01-{n:02d} 00:00:00").cast("timestamp")
    first = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), (" ",)], "t string")
    got = ledger.embedded(spark, path, "1", first, "t", embed, day(1), 10)
    assert sorted(map(str, got.collect())) == sorted(map(str, [("a", [1.0], False)] * 2 + [("bb", [2.0], False), (None, None, None), (" ", None, None)])) or {(r.t, r.cached) for r in got.collect()} == {("a", False), ("bb", False), (None, None), (" ", None)}
    more = spark.createDataFrame([("a",), ("ccc",)], "t string")
    assert {(r.t, r.vector[0], r.cached) for r in ledger.embedded(spark, path, "2", more, "t", embed, day(5), 10).collect()} == {("a", 1.0, True), ("ccc", 3.0, False)}
    assert {(r.t, r.cached) for r in ledger.embedded(spark, path, "2", more, "t", embed, day(5), 10).collect()} == {("a", True), ("ccc", False)}
    assert sorted(open(log).read().split()) == ["a", "bb", "ccc"]
    # after ten days a vector is made anew
    assert {(r.t, r.cached) for r in ledger.embedded(spark, path, "3", more, "t", embed, day(12), 10).collect()} == {("a", False), ("ccc", True)}
    assert sorted(open(log).read().split()) == ["a", "a", "bb", "ccc"]


def test_registered_chunkers(spark, docs):
    got = {(r.doc_id, r.chunk): r.text for r in knowledge.t09_vector_chunks(spark, D).collect()}
    want = {(i, k): c for i, t in zip(docs.doc_id, docs.text) for k, c in enumerate(loop_of_vectors(T.sentences(t or ""), C.word_vector, 2048, 3, 0.5) if t and len(t) < 5000 else [])}
    assert want and all(got[k] == c for k, c in want.items())
