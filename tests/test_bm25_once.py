"""BM25 scores texts where they are read: no term and no score of a text is shuffled, and the rows are a loop's."""

import math
import re
from collections import Counter, defaultdict

import pytest

from ledgerlark.operators.retrieval import bm25

TEXTS = ["the Bank pays", "bank BANK_1 x", "", None, "İzmir bank pays pays the the", "the", "x" * 70_000 + " the bank", "zebra", "naïve-bank pays"] * 2
ASKED = [(1, "the bank the"), (2, "Pays x"), (3, "nothing here"), (4, None), (1, "zebra")]


def _brute(rows, k):
    texts = defaultdict(Counter)
    for i, t in rows:
        texts[i].update(w for w in re.split("[^a-z0-9_]+", (t or "").lower()) if w)
    texts = {i: c for i, c in texts.items() if c}
    df = Counter(w for c in texts.values() for w in c)
    mean = sum(c.total() for c in texts.values()) / len(texts)
    asked = defaultdict(set)
    for q, t in ASKED:
        asked[q] |= {w for w in re.split("[^a-z0-9_]+", (t or "").lower()) if w}
    out = set()
    for q, terms in asked.items():
        s = {}
        for i, c in texts.items():
            if i is not None and any(c[t] for t in terms):
                s[i] = round(sum(math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t in terms if c[t]), 6)
        out |= {(q, i, x) for i, x in sorted(s.items(), key=lambda e: (-e[1], e[0]))[:k]}
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_rows_are_those_of_a_loop(spark, repeated):
    rows = [(i % 7 if repeated else i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "bank"), (None, "the bank")] if repeated else []
    asked, df = spark.createDataFrame(ASKED, "q long, text string"), spark.createDataFrame(rows, "id int, text string").repartition(3)
    got = bm25(asked, df, "q", "id", "text", 3)
    assert got.schema["id"].dataType.simpleString() == "int"
    want = _brute(rows, 3)
    assert {(r.q, r.id) for r in got.collect()} == {(q, i) for q, i, _ in want}
    assert sorted(r.score for r in got.collect()) == pytest.approx(sorted(x for *_, x in want), abs=2e-6)


def test_terms_of_texts_are_not_shuffled(spark):
    asked, df = spark.createDataFrame(ASKED, "q long, text string"), spark.range(4000).selectExpr("id", "'the bank pays x' as text")
    plan = bm25(asked, df, "q", "id", "text", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
