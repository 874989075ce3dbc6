"""Moments, spectra, limits, volatility models and forests against dense computations."""

import numpy as np
import pandas as pd
import pytest

from ledgerlark.operators import anomaly as A
from ledgerlark.operators import models as M
from ledgerlark.operators import volatility as V


@pytest.fixture(scope="module")
def returns(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((300, 4)) * [0.01, 0.02, 0.015, 0.03] + g.standard_normal((300, 1)) * 0.01
    rows = [("P", f"S{j}", i, float(x[i, j])) for i in range(300) for j in range(4) if not (i % 50 == 7 and j == 2)]
    rows += [("P", "S1", 900, None), ("Q", "A", 1, 0.1), (None, "A", 1, 0.1), (None, "B", 1, 0.2), (None, "A", 2, 0.3), (None, "B", 2, 0.1)]
    whole = np.array([i for i in range(300) if i % 50 != 7])
    return spark.createDataFrame(rows, "portfolio string, symbol string, d int, ret double"), x[whole]


def test_moments_are_those_of_whole_days(returns):
    df, x = returns
    got = {r.portfolio: r for r in M.moments(df, parts=5).collect()}
    p = got["P"]
    assert p.n == len(x) and p.symbols == ["S0", "S1", "S2", "S3"]
    assert np.allclose(p["mean"], x.mean(0), atol=1e-15) and np.allclose(p.covariance, np.cov(x.T).ravel(), atol=1e-15)
    assert set(got) == {"P", "Q"}  # rows without a key are left out
    assert M.moments(df.limit(0)).count() == 0


def test_spectrum(returns):
    df, x = returns
    got = {r.portfolio: r for r in M.correlation_spectrum(df).collect()}
    assert list(got) == ["P"]  # Q has one symbol, the nameless two days
    c = np.corrcoef(x.T)
    e = np.linalg.eigvalsh(c)[::-1]
    r = got["P"]
    assert np.allclose(r.eigenvalues, e, atol=1e-12) and r.condition_number == pytest.approx(e[0] / e[-1]) and r.observations == len(x)
    pairs = {f"S{i}-S{j}": c[i, j] for i in range(4) for j in range(i + 1, 4)}
    assert r.highest_pair == max(pairs, key=pairs.get) and r.lowest == pytest.approx(min(pairs.values())) and r.mean_correlation == pytest.approx(np.mean(list(pairs.values())))


def test_limits_hold_and_no_other_weights_are_better(returns):
    _, x = returns
    mu, cov = x.mean(0) * 252, np.cov(x.T) * 252
    within = M.Limits(["a", "a", "b", None], {"a": 0.5, "b": 0.2}, 0.45)
    w = M.limited_weights(mu, cov, within)
    assert w.sum() == pytest.approx(1, abs=1e-9) and w.min() >= 0 and w.max() <= 0.45 + 1e-9 and w[:2].sum() <= 0.5 + 1e-9 and w[2] <= 0.2 + 1e-9
    g = np.random.default_rng(0)
    sharpe = M.limited_weights(mu, cov, within, 0.01)
    ratio = lambda v: (mu @ v - 0.01) / np.sqrt(v @ cov @ v)
    free = g.dirichlet(np.ones(4), 20_000)
    free = free[(free.max(1) <= 0.45) & (free[:, :2].sum(1) <= 0.5) & (free[:, 2] <= 0.2)]
    assert len(free) > 50
    assert w @ cov @ w <= min(v @ cov @ v for v in free) + 1e-9 and ratio(sharpe) >= max(map(ratio, free)) * (0.99 if ratio(sharpe) > 0 else 1.01)
    for v in g.standard_normal((20, 4)):
        near = within.nearest(v)
        assert ((near - v) ** 2).sum() <= ((free - v) ** 2).sum(1).min() + 1e-9
    assert not M.Limits(["a", "a"], {"a": 0.9}, 1.0).feasible()


def test_sector_limits_by_key(spark, returns):
    df, _ = returns
    sectors = spark.createDataFrame([("S0", "a"), ("S1", "a"), ("S2", "b")], "symbol string, sector string")
    got = M.sector_limited_weights(df, sectors, {"a": 0.3, "b": 0.5}, 0.5).toPandas()
    assert set(got["method"]) == {"min_volatility", "max_sharpe"} and set(got["symbol"]) == {"S0", "S1", "S2", "S3"}
    for _, f in got.groupby("method"):
        assert f["weight"].sum() == pytest.approx(1) and f[f["sector"] == "a"]["weight"].sum() <= 0.3 + 1e-6 and f[f["symbol"] == "S3"]["sector"].isna().all()
    assert M.sector_limited_weights(df, sectors, {"a": 0.1, "b": 0.1}, 0.5).count() == 0


def _simulated(model, n=4000, seed=5):
    g, v, out = np.random.default_rng(seed), 1e-4, []
    for _ in range(n):
        z = g.standard_normal()
        x = z * np.sqrt(v)
        out.append(x)
        v = np.exp(0.05 * np.log(1e-4) + 0.2 * (abs(z) - np.sqrt(2 / np.pi)) - 0.1 * z + 0.95 * np.log(v)) if model == "egarch" else 1e-4 * 0.05 + (0.03 + 0.12 * (x < 0)) * x * x + 0.86 * v
    return np.array(out)


def test_models_find_the_parameters_that_made_the_series():
    a, g, b = V.fit_volatility("gjr", _simulated("gjr"))[0]
    assert abs(a - 0.03) < 0.03 and abs(g - 0.12) < 0.06 and abs(b - 0.86) < 0.06
    a, g, b = V.fit_volatility("egarch", _simulated("egarch"))[0]
    assert abs(a - 0.2) < 0.08 and abs(g + 0.1) < 0.05 and abs(b - 0.95) < 0.04


def test_likelihood_is_that_of_a_loop():
    e = _simulated("gjr", 200)
    target, v, want = float(e.var()), float(e.var()), 0.0
    for x in e:
        want += np.log(v) + x * x / v
        v = target * (1 - 0.05 - 0.05 - 0.8) + (0.05 + 0.1 * (x < 0)) * x * x + 0.8 * v
    score, last = V.filtered("gjr", e, target, np.array([[0.05, 0.1, 0.8], [0.5, 0.1, 0.8]]))
    assert score[0] == pytest.approx(want) and last[0] == pytest.approx(v) and np.isinf(score[1])


def test_volatility_models_by_key(spark):
    rows = [(k, i, float(x)) for k, m in (("g", "gjr"), ("e", "egarch")) for i, x in enumerate(_simulated(m, 1500))] + [("few", 1, 0.1), ("flat", 1, None)] + [("flat", i, 0.0) for i in range(50)]
    got = V.volatility_models(spark.createDataFrame(rows, "portfolio string, d int, ret double")).toPandas()
    assert sorted(zip(got["portfolio"], got["model"])) == [(k, m) for k in ("e", "g") for m in ("egarch", "garch", "gjr")]
    assert got.groupby("portfolio")["best"].sum().tolist() == [1, 1] and (got[got["best"]].set_index("portfolio")["aic"] == got.groupby("portfolio")["aic"].min()).all()
    g = got[got["model"] == "gjr"].set_index("portfolio")["loglikelihood"] - got[got["model"] == "garch"].set_index("portfolio")["loglikelihood"]
    assert (g > -1e-6).all()  # the wider model is never less likely
    r = got.iloc[0]
    assert r["expected_shortfall"][0] < r["value_at_risk"][0] < 0 and len(r["volatilities"]) == 5 and r["value_at_risk"][1] < r["value_at_risk"][0]


def test_forest_scores_every_row_of_long_keys_alike(spark):
    g = np.random.default_rng(3)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(g.standard_normal((6000, 2)))] + [("a", 6000, 9.0, 9.0), ("a", 6001, None, float("nan")), ("b", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, d int, x double, y double")
    one = A.isolation_scores(df, ["x", "y"], trees=40, pool=1000, block=700).toPandas().sort_values(["symbol", "d"])
    two = A.isolation_scores(df.repartition(3), ["x", "y"], trees=40, pool=1000, block=100_000).toPandas().sort_values(["symbol", "d"])
    assert len(one) == len(rows) and np.allclose(one["score"], two["score"])  # neither blocks nor partitions matter
    a = one[one["symbol"] == "a"]
    assert a.loc[a["score"].idxmax(), "d"] == 6000
    flags = A.isolation_forest(df, ["x", "y"], share=0.05, trees=40).toPandas()
    assert flags[flags["symbol"] == "a"]["anomaly"].mean() == pytest.approx(0.05, abs=0.002)
    assert A.isolation_scores(df.limit(0), ["x", "y"]).count() == 0


def test_ensemble_is_any_of_three(spark):
    g = np.random.default_rng(6)
    x = np.concatenate([g.standard_normal(500), [8.0, np.nan]])
    pdf = pd.DataFrame({"symbol": "a", "d": range(len(x)), "x": x, "flat": 1.0})
    got = A.ensemble(spark.createDataFrame(pdf), ["x", "flat"], trees=30).toPandas().sort_values("d")
    v = np.nan_to_num(x)
    q1, q3 = np.percentile(v, [25, 75])
    assert (got["by_z"].to_numpy() == (abs(v - v.mean()) / v.std() > 3)).all() and (got["by_iqr"].to_numpy() == ((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1)))).all()
    assert (got["flagged"] == (got["anomaly"] | got["by_z"] | got["by_iqr"])).all()
    cut = A.threshold(A.isolation_scores(spark.createDataFrame(pdf), ["x"], trees=30), 0.02).first().threshold
    assert cut == pytest.approx(np.quantile(A.isolation_scores(spark.createDataFrame(pdf), ["x"], trees=30).toPandas()["score"], 0.98))
