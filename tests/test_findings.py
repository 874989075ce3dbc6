"""Queries on small tables that once gave other rows than their SQL, or than the same query on other orders, batches or parts of the rows."""

import datetime

import duckdb
import pandas as pd

from ledgerlark import catalog
from ledgerlark.functions import text as T
from ledgerlark.operators.retrieval import fused
from ledgerlark.plans import fixtures as X


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(map(repr, (tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*names).collect()))) == want
    return want


def test_holdings_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    # summed as doubles in this order, the mean ends in 187 in place of 188
    at = datetime.datetime(2024, 1, 1)
    pd.DataFrame({"l_orderkey": range(4), "l_partkey": 1, "l_quantity": 16.0, "l_extendedprice": [86800.93, 56503.55, 28074.2, 17675.86]}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": range(4), "o_custkey": 9102, "o_orderdate": at}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"p_partkey": [1], "p_brand": ["Brand#20"], "p_retailprice": [998.1]}).to_parquet(tmp_path / "part.parquet")
    assert [tuple(r) for r in X.holdings(spark, str(tmp_path)).select("quantity", "avg_cost", "current_value").collect()] == [(64.0, 2953.977188, 63878.4)]


def test_articles_without_title_and_odd_addresses(spark, tmp_path):
    titles = ["A b", "ñ", "", "C", "D"]
    urls = ["http://a.example/1?x=1&y=2", "http://a.example/2", "http://a.example/3", "http://a.example/?q=<b>", 'http://a.example/?q="b"']
    pages = [(feed * 60 + i, u, f"<html><title>{t}</title></html>") for feed in (0, 3) for i, (t, u) in enumerate(zip(titles, urls))]  # a feed in RSS and one in Atom
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert len(same_as_sql(spark, tmp_path, "s07_feed_articles", "pages")) == 6


def test_chunks_go_out_in_small_batches(spark):
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(i))) for i in range(200)] + [(None, "a b"), (7, None)]
    got = T.chunked(spark.createDataFrame(texts, "i long, t string").coalesce(1), "i", "t", str.split, most=64)
    assert sorted(((r.i or -1), r.chunk, r.text) for r in got.collect()) == sorted((i or -1, k, c) for i, t in texts for k, c in enumerate((t or "").split()))


def test_losses_at_the_half_of_a_digit_are_those_of_the_sql(spark, tmp_path):
    # means with a 5 in the seventh digit, where the sum of doubles lies beside the exact one; no customer has a row, user 4 has no quantity, the lines of 5 are summed in this order
    lines = [
        (1898, 33.0, 85924.98, 942.8), (5434, 16.0, 96613.93, 998.0), (1579, 17.0, 103215.29, 914.6), (1898, 31.0, 20855.32, 980.4), (5434, 48.0, 46261.17, 927.7), (1579, 8.0, 75335.93, 941.8), (1579, 39.0, 92502.68, 927.2),
        (4, 0.0, 5.0, 900.0), (5, 16.0, 86800.93, 998.1), (5, 16.0, 56503.55, 998.1), (5, 16.0, 28074.2, 998.1), (5, 16.0, 17675.86, 998.1), (6, 1.0, None, 998.1), (7, 2.0, 5000.25, 998.1),
    ]
    user, quantity, price, retail = zip(*lines)
    n = range(len(lines))
    pd.DataFrame({"l_orderkey": n, "l_partkey": n, "l_quantity": quantity, "l_extendedprice": price}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": n, "o_custkey": user, "o_orderdate": datetime.datetime(1998, 1, 1)}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"p_partkey": n, "p_brand": "Brand#6", "p_retailprice": retail}).to_parquet(tmp_path / "part.parquet")
    assert len(same_as_sql(spark, tmp_path, "f34_loss_harvest", "lineitem", "orders", "part")) == 5


def test_hybrid_search_asks_every_item(spark):
    d = "/root/testdata/sf0.001"
    asked = {r.item_id for r in X.table(spark, d, "benchmark").collect()}
    assert len(asked) == 40 and {r.item_id for r in catalog.QUERIES["r4_hybrid_linear"](spark, d).collect()} == asked


def test_fused_scores_at_the_half_of_a_digit_are_those_of_the_sql(spark):
    scores = [27.614015, 28.338745, 19.757375, 27.870635, 26.889145]
    a, b = (spark.createDataFrame(rows, "q long, id long, score double") for rows in ([], [(1, i, s) for i, s in enumerate(scores)]))
    want = duckdb.execute("select list(round(0.7::double * 0 + 0.3::double * x, 6)) from unnest(?::double[]) t(x)", [scores]).fetchone()[0]
    assert sorted(r.score for r in fused(a, b, "q", "id", 0.7, 10).collect()) == sorted(want)
