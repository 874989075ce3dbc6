"""Broken limits of portfolios: against a loop, and read in one pass by tasks that are not merged."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlark.operators.planning import constraint_violations
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.planning import f35_constraint_violations

D = "/root/testdata/sf0.001"


def loop(rows):
    books = defaultdict(list)
    for key, symbol, sector, weight in rows:
        books[key].append((symbol, sector, weight))
    for key, book in books.items():
        total = sum(w or 0 for _, _, w in book)
        shares = sorted(((None if not total or w is None else round(w / total, 9), symbol, sector) for symbol, sector, w in book), key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
        known = [s for s in shares if s[0] is not None]
        yield from ((key, "stock", symbol, x) for x, symbol, _ in known if x > 0.10)
        if known and (top := sum(s[0] for s in shares[:10] if s[0] is not None)) > 0.55:
            yield key, "top ten", "all", top
        sectors = defaultdict(float)
        for x, _, sector in known:
            sectors[sector] += x
        yield from ((key, "sector", sector, x) for sector, x in sectors.items() if x > 0.25)
        if (many := sum(s[0] > 0.005 for s in known)) < 10:
            yield key, "holdings", "all", float(many)


def ordered(rows):
    return sorted(((k, rule, what, round(x, 8)) for k, rule, what, x in rows), key=repr)


def test_rows_equal_a_loop(spark):
    rnd = random.Random(19)
    rows = [(k, f"s{i:02d}", rnd.choice(["a", "b", "c", None]), rnd.choice([1.0, 2.0, 3.0, 40.0, 0.001])) for k in range(30) for i in range(rnd.choice([1, 3, 10, 11, 12, 40]))]
    rows += [(90, "x", "a", 0.0), (90, "y", "b", 0.0), (91, "x", "a", None), (91, "y", "a", 5.0), (None, "x", None, 1.0)]
    got = constraint_violations(spark.createDataFrame(rows, "k long, symbol string, sector string, weight double"), "k").collect()
    assert ordered(map(tuple, got)) == ordered(loop(rows)) and {r.rule for r in got} == {"stock", "top ten", "sector", "holdings"}
    assert constraint_violations(spark.createDataFrame([], "k long, symbol string, sector string, weight double"), "k").count() == 0


def test_lines_are_read_once(spark):
    plan = f35_constraint_violations(spark, D)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("l_orderkey") and plan.count("lineitem.parquet") == 1


def test_tasks_of_holdings_are_not_merged(spark):
    n = 8 * X.table(spark, D, "lineitem").rdd.getNumPartitions()
    assert X.holdings(spark, D).select(F.spark_partition_id().alias("p")).distinct().count() == n
