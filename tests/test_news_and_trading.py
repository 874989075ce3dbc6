"""Hand-made cases of the news functions and the rebalancing operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import news as N
from ledgerlark.operators import indicators as I
from ledgerlark.operators import monitoring as M
from ledgerlark.operators import trading as T
from ledgerlark.streaming.rollup import latest_of_key


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_tickers_are_whole_words_of_any_case(spark):
    assert one(spark, "itc and Titan; titanic, TCS.", N.tickers) == ["ITC", "TCS", "TITAN"]
    assert one(spark, None, N.tickers) == []


def test_themes_count_phrases_once_and_keep_their_tickers(spark):
    rows = [("a", "RBI rate cut lifts ITC"), ("a", "rate cut again, TCS"), ("a", None), ("b", "nothing here")]
    got = {(r.g, r.trend): r for r in N.themes(spark.createDataFrame(rows, "g string, text string"), "g", "text").collect()}
    assert got["a", "interest_rate"].keyword_hits == 2 and got["a", "interest_rate"].intensity == "medium"
    assert got["a", "interest_rate"].tickers == ["ITC", "TCS"]
    assert got["a", "sector_it"].keyword_hits == 2  # "it" within a word counts, as does "tcs"
    assert N.themes(spark.createDataFrame([], "g string, text string"), "g", "text").count() == 0


def test_event_and_impact(spark):
    assert one(spark, "Quarterly results out, and a merger", N.event_kind) == "earnings_release"
    assert one(spark, None, N.event_kind) is None
    row = spark.range(1).select(*N.impact(F.lit(-0.5), F.lit("regulatory"), F.lit("high"))).first()
    assert (row.direction, row.price_change, row.volatility_rise, row.duration) == ("negative", -0.024, 0.38, "5-30 days")
    row = spark.range(1).select(*N.impact(F.lit(0.1), F.lit("unknown"), F.lit(None).cast("string"))).first()
    assert (row.direction, row.price_change, row.volatility_rise, row.duration) == ("neutral", 0.0, 0.2, "1-10 days")


def test_questions_are_taken_apart(spark):
    assert one(spark, "How does PPF work and what is NPS interest", N.parts) == ["How does PPF work", "what is NPS interest"]
    assert one(spark, "PPF vs NPS", N.parts) == ["What is PPF?", "What is NPS?", "How does PPF compare with NPS?"]
    assert one(spark, "gold, debt, gold", N.parts) == [f"What are the rules and benefits related to {t}?" for t in ("gold", "debt")] + ["gold, debt, gold"]
    assert one(spark, "Hello", N.parts) == ["Hello"]
    assert one(spark, "Compare tax and gst?", N.complexity) == 5


def test_compression_and_highlight(spark):
    long = "Nothing in this sentence is about what was asked of it, not at all."
    text = f"{long} {long} Short one. The yield of a bond is what this longer sentence talks about in full."
    assert one(spark, text, lambda c: N.compressed(c, ["bond"])) == f"{long} Short one. The yield of a bond is what this longer sentence talks about in full."
    assert one(spark, text, lambda c: N.compressed(c, [])) == text
    assert one(spark, text, lambda c: N.highlight(c, ["bond", "yield"])).startswith("The yield")
    assert one(spark, "x" * 300 + " bond", lambda c: N.highlight(c, ["bond"])) == "..." + ("x" * 300 + " bond")[251:] + "..."
    assert one(spark, "", lambda c: N.highlight(c, ["bond"])) == ""


@pytest.mark.parametrize("step", [1, 5, 22, None])
def test_rebalanced_values_against_a_loop(spark, step):
    g = np.random.default_rng(5)
    n, weights = 60, {"a": 1.0, "b": 2.0, "c": 1.0}
    px = {s: 100 * np.cumprod(1 + g.normal(0, 0.02, n + k)) for k, s in enumerate(weights)}
    rows = [(s, i, float(v)) for s in px for i, v in enumerate(px[s])]
    out = T.rebalanced_values(spark.createDataFrame(rows, "symbol string, d int, px double"), spark.createDataFrame(list(weights.items()), "symbol string, weight double"), 1000.0, {"f": step})
    got = [r.value for r in out.orderBy("i").collect()]
    units, want = {s: 1000 * w / 4 / px[s][0] for s, w in weights.items()}, [1000.0]
    for i in range(1, n):
        want.append(sum(u * px[s][i] for s, u in units.items()))
        if i % (step or n) == 0:
            units = {s: want[-1] * w / 4 / px[s][i] for s, w in weights.items()}
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_least_turnover_cuts_the_trade_that_crosses_the_budget(spark):
    report = spark.createDataFrame([("p", "a", 0.10, "BUY"), ("p", "b", -0.08, "SELL"), ("p", "c", 0.05, "BUY"), ("p", "d", 0.0, "HOLD"), ("p", "e", 0.01, "BUY")], "portfolio string, symbol string, drift double, action string")
    got = [(r.symbol, r.value, round(r.tax, 6)) for r in T.least_turnover(report, "portfolio", F.lit(100), 0.18).orderBy(F.desc("score")).collect()]
    assert got == [("a", 0.10, 0.0), ("c", 0.05, 0.0), ("e", 0.01, 0.0), ("b", 0.02, 0.004)]


def test_sale_taxes_and_empty_tables(spark):
    kinds = "user_id int, trade_value double, price double, avg_cost double, buy_date date"
    rows = [(1, 1e6, 10.0, 5.0, None), (1, 1e6, 10.0, 20.0, None), (2, 1e6, 0.0, 5.0, None)]
    got = {r.user_id: (r.short_tax, r.long_tax) for r in T.sale_taxes(spark.createDataFrame(rows, kinds), "user_id", "2020-01-01").collect()}
    assert got == {1: (100_000.0, 0.0), 2: (0.0, 0.0)}
    old = spark.createDataFrame([(1, 1e6, 10.0, 5.0)], "user_id int, trade_value double, price double, avg_cost double").withColumn("buy_date", F.lit("2001-01-01").cast("date"))
    assert T.sale_taxes(old, "user_id", "2020-01-01").first().long_tax == 375_000 * 0.125
    assert T.equal_targets(spark.createDataFrame([], "user_id int, symbol string, current_value double"), "user_id").count() == 0


def test_importance(spark):
    rows = [("a", 3.0), ("a", -3.0), ("b", 1.0), ("c", 0.0)]
    got = {r.f: r for r in T.importance(spark.createDataFrame(rows, "f string, x double"), "f", "x").collect()}
    assert [got[k]["rank"] for k in "abc"] == [1, 2, 3] and got["a"].mean == 0 and got["a"].share == 75.0 and got["b"].n_for_90 == 2


def test_aspects_and_confidence(spark):
    df = spark.createDataFrame([(1, "Profits rose. Nothing here! Risky debt, profit fell."), (2, None)], "id int, text string")
    got = {(r.id, r.aspect): (r.n_sentences, r.combined) for r in N.aspects(df, "id", "text").collect()}
    assert got == {(1, "profit"): (2, "Profits rose. Risky debt, profit fell."), (1, "risk"): (1, "Risky debt, profit fell."), (1, "debt"): (1, "Risky debt, profit fell.")}
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, "x" * 301 + " past performance", lambda c: N.confidence("market_analyst", c, yes, yes, yes)) == 1.0
    assert one(spark, "short", lambda c: N.confidence("risk_analyst", c, yes, no, no)) == 0.8


def test_macd_of_reseeded_windows_against_a_loop(spark):
    def ema(x, p):
        e = sum(x[:p]) / p
        for v in x[p:]:
            e = (v - e) * 2 / (p + 1) + e
        return e

    closes = list(100 + np.cumsum(np.random.default_rng(3).normal(0, 1, 80)))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(closes)] + [("b", i, float(v)) for i, v in enumerate(closes[:20])], "symbol string, d int, close double")
    got = {r.symbol: r for r in I.macd_reseeded(df).collect()}
    line = ema(closes, 12) - ema(closes, 26)
    windows = [closes[i - 25 : i + 1] for i in range(26, 80)]
    assert got["a"].macd_line == pytest.approx(line) and got["a"].signal_line == pytest.approx(ema([ema(w, 12) - ema(w, 26) for w in windows], 9))
    assert got["b"].macd_line == pytest.approx(ema(closes[:20], 12) - ema(closes[:20], 26)) and got["b"].histogram == 0


def test_retraining_decisions(spark):
    rows = [("a", "high", 0.2, "2024-01-01", 20_000), ("b", "low", 0.1, "2024-03-01", 10_000), ("c", None, None, None, None)]
    df = spark.createDataFrame(rows, "model string, drift_severity string, performance_drop double, day string, predictions long").withColumn("last_retrained", F.col("day").cast("date"))
    got = {r.model: (r.should_retrain, r.days_since, r.reason) for r in M.retraining_decisions(df, "2024-03-05").collect()}
    assert got["a"] == (True, 64, "drift severity: high; performance drop: 20.0%; days since retrain: 64 > 30; predictions since retrain: 20000 > 10000")
    assert got["b"] == (False, 4, "No triggers met") and got["c"] == (False, -1, "No triggers met")


def test_latest_of_key_over_several_batches(spark, tmp_path):
    kinds = "k int, at int, status string"
    for i, rows in enumerate([[(1, 1, "new"), (2, 5, "done")], [(1, 3, "done"), (2, 4, "late")], [(None, 1, "new")]]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.k, r.at, r.status, r.updates) for r in latest_of_key(stream, "k", ["at"], ["status"]).collect()}
    assert got == {(1, 3, "done", 2), (2, 5, "done", 2), (None, 1, "new", 1)}
