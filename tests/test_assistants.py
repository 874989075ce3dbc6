"""Interactions, decomposed searches and contexts on small inputs: nulls, ties, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import interactions as I
from ledgerlark.operators import search as S

AGENTS = "id int, question string, agents array<struct<name:string,data:map<string,string>>>"


def test_interactions(spark):
    rows = [
        (1, None, None),
        (2, "What I LIKE", []),
        (3, "x", [None, ("Watchlist", None), ("my_STOCKS", {"overall_sentiment": "POSITIVE", "sentiment": "", "symbols": '["b", "a", "B"]', "ticker": "c", "value": "nan?", "price": "2"})]),
        (4, "default to cash", [("trade", {str(i): "" for i in range(6)}), ("RISK", {"positions": "[]", "holdings": '["h"]', "market_cap": "9"}), ("portfolio", {"holdings": "many", "tickers": "[broken"}), ("backtest", None), ("risk", None)]),
    ]
    a = F.col("agents")
    df = spark.createDataFrame(rows, AGENTS).select("id", I.event_kind(a).alias("k"), I.sentiment(a).alias("s"), I.importance(a).alias("w"), I.tickers(a).alias("t"), I.amounts(a).alias("m"), I.insights(F.col("question"), a).alias("i"))
    got = {r.id: r for r in df.collect()}
    assert [(r.k, r.s, r.w) for r in (got[i] for i in (1, 2, 3, 4))] == [("general_query", "neutral", 0.3), ("general_query", "neutral", 0.3), ("watchlist_update", "positive", 0.4), ("risk_assessment", "neutral", 1.0)]
    assert got[3].t == ["A", "B", "C"] and got[3].m == [2.0] and got[1].t == [] and got[1].m == [] and got[1].i == []
    assert [(i.kind, i.content) for i in got[2].i] == [("preference", "User preference: What I LIKE")]
    assert [(i.kind, i.content, i.tags) for i in got[4].i[1:]] == [("financial_fact", "unknown | Market cap: 9", ["fundamentals"]), ("portfolio_state", "Portfolio has 1 positions", ["portfolio", "holdings"])]
    assert df.limit(0).count() == 0


def test_decomposed_merges_as_a_loop_does(spark):
    docs = {1: "same start", 2: "  same start ", 3: "other", 4: None, 5: "more"}
    lists = {("q", 0): [(3, 0.9), (1, 0.5)], ("q", 1): [(2, 0.98), (5, 0.6), (3, 0.1)], ("plain", 0): [(1, 0.7), (2, 0.7)]}
    asked = spark.createDataFrame([("q", "Should I take the loan and pay less tax? Why?"), ("plain", "loan"), ("none", None)], "q string, text string")
    contents = spark.createDataFrame(list(docs.items()), "id int, content string")
    found = spark.createDataFrame([((q, at), i, s) for (q, at), x in lists.items() for i, s in x], "sub struct<q:string,at:int>, id int, score double")
    asked_for = []

    def search(subs):
        asked_for.extend((r["sub"].q, r["sub"].at, r.text) for r in subs.collect())
        return found

    got = {(r.q, r.id): (r.score, r.parts) for r in S.decomposed(asked, "q", "text", search, contents, "id", 10).collect()}
    assert sorted(asked_for) == [("plain", 0, "loan"), ("q", 0, "Should I take the loan"), ("q", 1, "pay less tax? Why?")]
    want = {}
    for (q, at), x in sorted(lists.items()):
        for i, s in sorted(x, key=lambda y: (-y[1], y[0])):
            start = (q, (docs[i] or "").strip()[:300])
            if start in want:
                want[start][1] = min(1.0, want[start][1] + 0.05)
                want[start][2].add(at)
            else:
                want[start] = [i, s, {at}]
    assert got == {(q, i): (pytest.approx(s), len(p)) for (q, _), (i, s, p) in want.items()}


def test_reranked(spark):
    lists = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.2), ("q", 3, 0.5), ("q", 4, 1.0), ("r", 1, 0.1)], "q string, id int, score double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id int, vector array<double>")
    asked = spark.createDataFrame([("q", [0.0, 3.0])], "q string, vector array<double>")
    contents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, " a ")], "id int, content string")
    got = [(r.q, r.id, r.score) for r in S.reranked(lists, vectors, asked, contents, "q", "id", 5, 0.15).orderBy("q", F.desc("score"), "id").collect()]
    assert got == [("q", 2, 0.68), ("q", 1, 0.4), ("q", 3, 0.2)]  # 4 begins as 1 does, r's row is under the least score
    assert S.reranked(lists.limit(0), vectors, asked, contents, "q", "id", 5, 0.15).count() == 0


def test_context(spark):
    rows = [("q", 1, 0.5, "k", "T", None, "x" * 2001), ("q", 2, 0.9, None, "", "s", None), ("q", 3, 0.1, "k", None, "", "z")]
    df = spark.createDataFrame(rows, "q string, id int, score double, kind string, title string, source string, content string")
    text = S.context(df, "q", "id", most=2).first().context
    assert text == "[Document 1] Type:  | Source: s | Relevance: 90.00%\n\n\n---\n\n[Document 2] Type: k | Title: T | Relevance: 50.00%\n" + "x" * 2000 + "\n... [truncated]"


def test_small_parts(spark):
    from ledgerlark.functions import text as T
    from ledgerlark.operators.indicators import ema_from_mean

    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5], " Agents: a Agent:"), (2, [], ""), (3, None, None)], "id int, v array<int>, t string")
    got = {r.id: (r.b, r.t) for r in df.select("id", T.batched(F.col("v"), 2).alias("b"), T.without_phrases(F.col("t"), T.ANSWER_HEADINGS).alias("t")).collect()}
    assert got == {1: ([[1, 2], [3, 4], [5]], "a"), 2: ([], ""), 3: (None, None)}
    series = {"a": [1.0, 2.0, 4.0, 8.0, 3.0], "b": [6.0]}

    def fold(p, n=3):
        e = sum(p[:n]) / n
        for x in p[n:]:
            e += (x - e) * 2 / (n + 1)
        return e

    rows = spark.createDataFrame([(k, i, x) for k, p in series.items() for i, x in enumerate(p)] + [("a", 9, None)], "symbol string, d int, close double")
    assert {r.symbol: r.ema for r in ema_from_mean(rows, 3).collect()} == {k: pytest.approx(fold(p)) for k, p in series.items()}
