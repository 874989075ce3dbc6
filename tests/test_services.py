"""Session keys over micro-batches and restarts, feeds in files, fetches that fail, broken JSON, arms of tests."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import json as J
from ledgerlark.operators import experiments as E
from ledgerlark.sources import feeds, quotes
from ledgerlark.streaming.session_store import session_keys

OPS = "user_id long, seq long, ts timestamp, op string, k string, v string, ttl double"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def run(spark, tmp, batches):
    """Operations in files, one a micro-batch; the stream is stopped after each and started again from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        ops = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
        session_keys(ops, session_ttl=7200, delay="10 minutes").writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.user_id, r.ms // 60_000 % (24 * 60), r.op, r.k, r.v) for r in spark.read.parquet(f"{tmp}/out").collect())


def test_session_keys(spark, tmp_path):
    ops = [
        [(1, 1, at(0), "set", "a", "x", 1800.0), (1, 2, at(1), "set", "b", "y", None), (1, 3, at(2), "get", "a", None, None), (1, 4, at(2), "set", "user_id", "no", None), (1, 5, at(3), "get", "user_id", None, None), (2, 1, at(0), "set", "a", "z", 60.0)],
        [(1, 6, at(29), "get", "a", None, None), (1, 7, at(30), "get", "a", None, None), (1, 8, at(31), "get", "b", None, None)],
        [(1, 9, at(100), "set", "a", "w", 60.0), (1, 10, at(100), "delete", "b", None, None), (1, 11, at(100), "get", "b", None, None), (1, 12, at(100), "get", "a", None, None)],
        [(1, 13, at(105), "set", "c", "q", None), (1, 14, at(300), "get", "c", None, None), (1, 15, at(301), "set", "d", "1", None), (1, 16, at(302), "clear", None, None, None), (1, 17, at(302), "get", "d", None, None)],
    ]
    want = sorted([
        (1, 2, "get", "a", "x"), (1, 3, "get", "user_id", None), (1, 29, "get", "a", "x"), (1, 30, "get", "a", None), (1, 31, "get", "b", "y"),
        (1, 100, "get", "b", None), (1, 100, "get", "a", "w"), (1, 300, "get", "c", None), (1, 302, "get", "d", None),
        (2, 1, "expired", "a", "z"),  # user 1's first "a" is set anew before the watermark passes its time
    ], key=str)
    got = run(spark, str(tmp_path / "many"), ops)
    # the key set at minute 100 goes with its session, so its timer finds nothing, or the timer comes first
    assert sorted([r for r in got if r != (1, 101, "expired", "a", "w")], key=str) == want
    again = run(spark, str(tmp_path / "same"), ops)
    assert again == got


def test_feeds_in_files(spark, tmp_path):
    rss = """<?xml version="1.0"?><rss xmlns:content="c" xmlns:dc="d"><channel><title>Feed</title>
      <item><title> One &amp; two </title><link>https://x.example/1</link><pubDate>Mon</pubDate><description><![CDATA[<p>Brief</p>]]></description><content:encoded><![CDATA[<p>Full <b>text</b>&nbsp;here</p>]]></content:encoded></item>
      <item><title>No link</title></item><item><link>https://x.example/2</link></item><item><title>Old</title><link>https://x.example/3</link><dc:date>Tue</dc:date><description>&lt;i&gt;d&lt;/i&gt;</description></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">Entry</title><link href="https://y.example/1"/><updated>Wed</updated><content type="html">&lt;p&gt;c&lt;/p&gt;</content></entry></feed>"""
    for name, text in (("a.xml", rss), ("b.xml", atom), ("c.xml", rss[:300]), ("d.xml", "no xml at all"), ("e.xml", "<html><p>page</p></html>")):
        (tmp_path / name).write_text(text)
    good, bad = feeds.read_feeds(spark, str(tmp_path))
    assert sorted((r.title, r.url, r.published_at, r.content, r.n) for r in good.collect()) == [
        ("Entry", "https://y.example/1", "Wed", "c", 0), ("Old", "https://x.example/3", "Tue", "d", 3), ("One & two", "https://x.example/1", "Mon", "Full text here", 0),
    ]
    assert sorted((r.url[-5:], r.text) for r in bad.collect()) == [("c.xml", rss[:300]), ("d.xml", "no xml at all"), ("e.xml", "<html><p>page</p></html>")]
    many = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>https://www.livemint.com/{i}</link></item>" for i in range(70)) + "</channel></rss>"
    x, bad = feeds.parse_feeds(spark.createDataFrame([("https://www.livemint.com/rss", many), ("n", None)], "u string, x string"), "u", "x")
    assert sorted(r.n for r in x.collect()) == list(range(50)) and {r.source for r in x.collect()} == {"LiveMint"} and bad.count() == 1


def test_normalised_articles(spark):
    rows = [("T", "d", "body [+12 chars]", "u", "S", "2024"), ("", None, " ", "u", "S", "2024"), (None, "d", "[+3 chars]", None, None, None)]
    got = feeds.normalised_articles(spark.createDataFrame(rows, "title string, description string, content string, url string, source string, publishedAt string")).collect()
    assert sorted((r.title, r.content, r.source) for r in got) == [("", "", "unknown"), ("T", "body", "S")]


def test_fetches_fail_alone(spark, tmp_path):
    day = datetime.date
    rows = [("A", day(2024, 1, i), 1.0, 2.0, 0.5, float(i), 10.0) for i in range(1, 6)] + [("B", day(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)]
    path = str(tmp_path / "bars")
    spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double").write.partitionBy("symbol").parquet(path)
    (tmp_path / "bars" / "symbol=BAD").mkdir()
    (tmp_path / "bars" / "symbol=BAD" / "part.parquet").write_bytes(b"broken")
    got = quotes.fetch_bars(spark, path, ["A", "B", "BAD", "NONE"], "2024-01-02", "2024-01-05", wait=0).collect()
    assert sorted((r.symbol, r.d.day, r.close, r.tries) for r in got if r.error is None) == [("A", 2, 2.0, 1), ("A", 3, 3.0, 1), ("A", 4, 4.0, 1), ("B", 2, 1.0, 1)]
    assert {(r.symbol, r.tries, r.close) for r in got if r.error} == {("BAD", 3, None), ("NONE", 3, None)}
    assert quotes.fetch_bars(spark, path, ["A", "B"], wait=0).rdd.getNumPartitions() == 2


def test_a_second_try(tmp_path, monkeypatch):
    calls = []

    def flaky(path, symbol, start, end):
        import pyarrow as pa

        calls.append(symbol)
        if len(calls) < 3:
            raise OSError("busy")
        return pa.table({"d": [datetime.date(2024, 1, 1)], **{c: [1.0] for c in ("open", "high", "low", "close", "volume")}})

    waits = []
    monkeypatch.setattr(quotes, "fetch", flaky)
    monkeypatch.setattr(quotes.time, "sleep", waits.append)
    reader = quotes.Quotes({"path": "p", "symbols": "A", "wait": "1"}).reader(None)
    (batch,) = reader.read(reader.partitions()[0])
    assert batch.to_pylist()[0]["tries"] == 3 and batch.to_pylist()[0]["error"] is None and waits == [1, 2]


def test_json(spark):
    rows = [(1, '{"k": 1}'), (2, '{"k": "x"}'), (3, "{"), (4, None), (5, ""), (6, "[1]"), (7, '{"other": 2}')]
    got = {r.i: (r.value and r.value.k, r.bad) for r in J.parsed(spark.createDataFrame(rows, "i int, t string"), "t", "k long").collect()}
    assert got == {1: (1, False), 2: (None, True), 3: (None, True), 4: (None, False), 5: (None, True), 6: (None, True), 7: (None, False)}
    texts = ['a ```json\n{"x": {"y": 1}}\n``` {"z": 1}', '```\n{"b": 2}\n```', 'text {"c": 3} more {"d": 4}', "none {at} all", None, '```json\n[1]\n``` {"e": 5}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: json.loads(r.x) for r in df.select("i", J.json_in_text(F.col("t")).alias("x")).collect()}
    assert found == {0: {"x": {"y": 1}}, 1: {"b": 2}, 2: {"c": 3}, 3: {}, 4: {}, 5: {"e": 5}}
    kept = df.select(J.json_or(F.lit("{bad"), F.parse_json(F.lit('{"d": 1}'))).cast("string").alias("x")).first().x
    assert kept == '{"d":1}'


def test_arms(spark):
    users = spark.range(20_000).withColumnRenamed("id", "u")
    arms = lambda buckets: {r.u: r.arm for r in E.assigned(users, buckets, "t", "u").collect()}
    steps, state = [], E.new_test(spark)
    for shares in ({"A": 0.1}, {"B": 0.2}, {"A": 0.3}, {"B": 0.05}, {"A": 0.3, "C": 0.5}):
        state = E.reshared(state, shares)
        steps.append((shares, arms(state)))
    share = lambda x, a: sum(v == a for v in x.values()) / len(x)
    assert [round(share(steps[-1][1], a), 2) for a in ("A", "B", "C")] == [pytest.approx(s, abs=0.02) for s in (0.3, 0.05, 0.5)]
    for (_, a), (shares, b) in zip(steps, steps[1:]):
        moved = {(a[u], b[u]) for u in a if a[u] != b[u]}
        assert moved <= {("champion", x) for x in shares} | {(x, "champion") for x in shares} and len({m for m in moved}) <= len(shares)
    for bad in ({"A": 0.9}, {"champion": 0.1}, {"A": -0.1}):
        with pytest.raises(ValueError):
            E.reshared(state, bad)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tests = spark.createDataFrame([], "model string, champion string, challenger string, share double, started_at timestamp, ends_at timestamp, active boolean, ended_at timestamp, promoted boolean")
    tests = E.started(tests, "m", "1.0.0", "1.0.1", 0.1, 48, now)
    with pytest.raises(ValueError):
        E.started(tests, "m", "1.0.0", "1.0.2", 0.1, 48, now)
    assert E.champion_of(tests).first().champion == "1.0.0"
    tests = E.ended(tests, "m", True, now + F.expr("interval 1 day"))
    assert E.champion_of(tests).first().champion == "1.0.1" and not tests.first().active and tests.first().ends_at.day == 3
    tests = E.ended(E.started(tests, "m", "1.0.1", "1.0.2", 0.1, 1, now + F.expr("interval 2 day")), "m", False, now + F.expr("interval 3 day"))
    assert E.champion_of(tests).first().champion == "1.0.1"
