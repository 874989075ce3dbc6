"""Functions that SQL does not express, against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.functions.filters import build_filter
from ledgerlark.operators import models as M
from ledgerlark.sources import files


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"]), (3, None, None)], "n int, s string, tags array<string>")
    ids = lambda f, **k: [r.n for r in df.where(build_filter(f, df.schema, **k)).orderBy("n").collect()]
    assert ids({"tags": {"$in": ["y", "z"]}}) == [1, 2] and ids({"tags": {"$contains": "z"}}) == [2]
    assert ids({"$or": [{"n": 3}, {"s": {"$eq": "a"}}]}) == [1, 3] and ids({"n": {"$gte": 2}, "s": {"$ne": "a"}}) == [2]
    assert ids({}) == [1, 2, 3] and ids({"s": ["a", "b"], "n": {"$like": 1}}, strict=False) == [1, 2]
    with pytest.raises(ValueError):
        build_filter({"n": {"$like": 1}})


def test_chunkers():
    assert T.recursive_chunks("aa\n\nbb\n\ncc", 5, 0) == ["aa", "bb", "cc"]
    assert T.recursive_chunks("aa\n\nbb\n\ncc", 5, 3) == ["aa", "aa\nbb", "\nbb\ncc"]
    words = " ".join(f"w{i}" for i in range(500))
    parts = T.sized_chunks(words, 100, 20)
    assert all(len(p) <= 100 for p in parts) and set(" ".join(parts).split()) >= set(words.split()[:-1]) and parts[-1].endswith("w499")
    assert T.sized_chunks("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50] and T.sized_chunks("short", 100, 20) == ["short"]
    assert T.sentences("Dr. Smith came. He left! Why? e.g. this one.") == ["Dr. Smith came.", "He left!", "Why?", "e.g. this one."]
    assert T.merged_short(["a", "b", "cccc", "d"], 3) == ["a\nb", "cccc", "d"] and T.merged_short([], 3) == []
    assert T.similar_chunks(["the old mill", "the old mill wheel", "quite other words"]) == ["the old mill the old mill wheel", "quite other words"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "id int, c string, v string")
    assert files.read_version(spark, path) is None
    files.merge_into(spark, path, rows((1, "p", "a"), (2, "q", "b")), ["id"])
    files.merge_into(spark, path, rows((2, "q", None), (3, "r", "c")), ["id"], fill=["v"])
    got = lambda n=None: sorted((r.id, r.v) for r in files.read_version(spark, path, n).collect())
    assert got() == [(1, "a"), (2, "b"), (3, "c")] and got(1) == [(1, "a"), (2, "b")]
    files.insert_new(spark, path, rows((4, "p", "x"), (5, "s", "e"), (5, "s", "e")), "c")
    files.delete_from(spark, path, rows((1, "", "")), "id")
    assert got() == [(2, "b"), (3, "c"), (5, "e")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rules": [{"name": "x", "rate": 0.1}, {"name": "y", "rate": 0.2}], "dues": []}')
    got = files.read_sections(spark, str(tmp_path / "a.json"), {"rules": "name: string, rate: double", "dues": "day: string"})
    assert {(r.name, r.rate) for r in got["rules"].collect()} == {("x", 0.1), ("y", 0.2)} and got["dues"].count() == 0
    (tmp_path / "b.csv").write_text("name,rate\nx,0.5\ny,bad\n")
    assert [(r.name, r.rate) for r in files.read_csv_rows(spark, str(tmp_path / "b.csv"), "name string, rate double").collect()] == [("x", 0.5), ("y", None)]
    tried = []
    assert files.with_retry(lambda k: tried.append(k) or spark.range(k)).count() == 1 and tried == [0, 1]


@pytest.fixture
def cov():
    x = np.random.default_rng(1).standard_normal((400, 5)) @ np.diag([1, 2, 1.5, 0.7, 1]) + np.random.default_rng(2).standard_normal((400, 1))
    return np.cov(x.T)


def test_risk_parity_shares_risk_equally(cov):
    w = M.risk_parity(cov)
    parts = w * (cov @ w)
    assert abs(w.sum() - 1) < 1e-9 and np.allclose(parts, parts.mean(), rtol=1e-5)


def test_minimum_variance_meets_the_conditions_of_optimality(cov):
    w = M.minimum_variance(cov)
    g = 2 * cov @ w
    held = w > 1e-6
    assert abs(w.sum() - 1) < 1e-6 and np.ptp(g[held]) < 1e-3 * g.mean() and (g[~held] >= g[held].min() - 1e-6).all()
    best = min(r @ cov @ r for r in np.random.default_rng(3).dirichlet(np.ones(5), 20_000))
    assert w @ cov @ w <= best + 1e-9


def test_hierarchical_weights(cov):
    w = M.hierarchical_risk_parity(cov)
    assert abs(w.sum() - 1) < 1e-9 and (w > 0).all()
    two = M.hierarchical_risk_parity(np.diag([1.0, 4.0]))
    assert np.allclose(two, [0.8, 0.2])


def test_black_litterman(cov):
    mu = np.full(5, 0.05)
    same = M.black_litterman(mu, cov, {0: (0.05, 0.5)})
    moved = M.black_litterman(mu, cov, {0: (0.15, 1.0)})
    assert np.allclose(same, mu) and 0.05 < moved[0] < 0.15 and np.isclose(moved[0], 0.10)  # as sure as the prior: half way


def test_frontier_rises(cov):
    mu = np.array([0.05, 0.12, 0.08, 0.03, 0.06])
    points = M.frontier(mu, cov)
    assert all(b[0] >= a[0] - 1e-9 and b[1] >= a[1] - 1e-9 for a, b in zip(points, points[1:]))


def test_garch_likelihood_is_near_the_best():
    rng = np.random.default_rng(5)
    r, v = np.zeros(1500), 1e-4
    for i in range(len(r)):
        r[i] = np.sqrt(v) * rng.standard_normal()
        v = 4e-6 + 0.10 * r[i] ** 2 + 0.86 * v
    omega, a, b = M.fit_garch(r)

    def loss(w, a, b):
        x = r - r.mean()
        v = M.garch_filter(x, w, a, b)[:-1]
        return (np.log(v) + x * x / v).sum()

    target = r.var()
    fine = min(loss(target * (1 - p - q), p, q) for p in np.arange(0.02, 0.3, 0.02) for q in np.arange(0.5, 0.97, 0.02) if p + q < 0.999)
    assert loss(omega, a, b) <= fine + 1.0 and abs(a - 0.10) < 0.06 and abs(b - 0.86) < 0.12


def test_monte_carlo_is_the_same_on_any_partitioning(spark):
    m = spark.createDataFrame([("p", 0.0005, 0.01)], "portfolio string, mu double, sigma double")
    one = M.monte_carlo(m, paths=4000, days=50).first()
    two = M.monte_carlo(m.repartition(5), paths=4000, days=50).first()
    assert all(abs(x - y) < 1e-9 for x, y in zip(one[1:], two[1:]))
    end = (0.0005 - 0.01**2 / 2) * 50
    assert abs(one.p50 - (np.exp(end) - 1)) < 0.005 and abs(one.p05 - (np.exp(end - 1.645 * 0.01 * 50**0.5) - 1)) < 0.01 and one.shortfall < one.p05


def test_isolation_forest_finds_the_odd_row(spark):
    from ledgerlark.operators.anomaly import isolation_forest

    rows = [("a", f"2020-01-{i + 1:02d}", float(x)) for i, x in enumerate([*np.random.default_rng(0).normal(0, 1, 29), 25.0])]
    df = spark.createDataFrame(rows, "symbol string, d string, x double").withColumn("d", F.to_date("d"))
    got = isolation_forest(df, ["x"], trees=50).orderBy(F.desc("score")).first()
    assert str(got.d) == "2020-01-30" and got.anomaly
