"""Models fitted by group with numpy: volatility, simulation, portfolio weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.order import quantiles
from ledgerlark.session import cut, with_package


def garch_filter(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Conditional variances, the last one of the day after the data."""
    v = np.empty(len(r) + 1)
    v[0] = r.var()
    for i, x in enumerate(r):
        v[i + 1] = omega + alpha * x * x + beta * v[i]
    return v


def fit_garch(r: np.ndarray) -> tuple[float, float, float]:
    """Parameters of GARCH(1,1) by likelihood with the long-run variance held at the sample's: a grid of (alpha, beta), made finer twice."""
    r = r - r.mean()
    target = r.var()
    best, step, centre = None, 0.08, (0.1, 0.8)
    grid = [(a, b) for a in np.arange(0.02, 0.4, 0.06) for b in np.arange(0.3, 0.98, 0.08)]
    for _ in range(3):
        for a, b in grid:
            if a <= 0 or b < 0 or a + b >= 0.999:
                continue
            v = garch_filter(r, target * (1 - a - b), a, b)[:-1]
            score = float((np.log(v) + r * r / v).sum())
            if best is None or score < best[0]:
                best = score, a, b
        step /= 3
        centre = best[1:]
        grid = [(centre[0] + i * step, centre[1] + j * step) for i in range(-2, 3) for j in range(-2, 3)]
    _, a, b = best
    return target * (1 - a - b), a, b


def garch(df: DataFrame, steps: int = 5, least: int = 30, key: str = "portfolio") -> DataFrame:
    """Parameters and daily volatilities forecast ``steps`` days on; keys of fewer than ``least`` returns have no rows."""
    with_package(df.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r = f.sort_values("d")["ret"].dropna().to_numpy(float)
        if len(r) < least or r.std() == 0:
            return pd.DataFrame({key: [], "step": [], "omega": [], "alpha": [], "beta": [], "volatility": []})
        omega, a, b = fit_garch(r)
        v, out = garch_filter(r - r.mean(), omega, a, b)[-1], []
        for k in range(1, steps + 1):
            out.append((f[key].iloc[0], k, omega, a, b, float(np.sqrt(v))))
            v = omega + (a + b) * v
        return pd.DataFrame(out, columns=[key, "step", "omega", "alpha", "beta", "volatility"])

    return df.groupBy(key).applyInPandas(run, f"{key} string, step int, omega double, alpha double, beta double, volatility double")


def monte_carlo(stats: DataFrame, paths: int = 10_000, days: int = 252, seed: int = 42, key: str = "portfolio") -> DataFrame:
    """Quantiles of simulated growth, expected shortfall and chance of profit. Each path is a row, each day a normal draw.

    A draw is made from hashes of the seed, the key, the path and the day (Box-Muller), so it is the same on any cluster.
    """
    x = stats.crossJoin(stats.sparkSession.range(paths).withColumnRenamed("id", "path"))
    x = x.select(key, "mu", "sigma", "path", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed + k), key, "path", "day"), 11) + F.lit(0.5)) / float(1 << 53)
    x = x.withColumn("z", F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * F.pi() * uniform(1)))
    end = x.groupBy(key, "path").agg((F.exp(F.sum(F.ln(F.greatest(F.lit(1e-6), 1 + F.col("mu") + F.col("sigma") * F.col("z"))))) - 1).alias("r"))
    end = cut(end)  # the draws are used thrice
    q = quantiles(end, key, "r", [0.05, 0.5, 0.95]).join(end.groupBy(key).agg(F.avg((F.col("r") > 0).cast("double")).alias("p_profit")), key)
    tail = end.join(q, key).where(F.col("r") <= F.col("q")[0]).groupBy(key).agg(F.avg("r").alias("shortfall"))
    return q.join(tail, key).select(key, F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "p_profit", "shortfall")


def capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights between 0 and ``cap`` that add to 1."""
    lo, hi = v.min() - 1, v.max()
    for _ in range(60):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if np.clip(v - m, 0, cap).sum() > 1 else (lo, m)
    return np.clip(v - hi, 0, cap) / np.clip(v - hi, 0, cap).sum()


def minimum_variance(cov: np.ndarray, cap: float = 1.0, mu: np.ndarray | None = None, reward: float = 0.0) -> np.ndarray:
    """Least w'Cw - reward * mu'w over capped long-only weights, by projected gradient."""
    n = len(cov)
    w, step = np.full(n, 1 / n), 0.5 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)
    for _ in range(500):
        w = capped_simplex(w - step * (2 * cov @ w - (reward * mu if mu is not None else 0)), max(cap, 1 / n))
    return w


def maximum_sharpe(mu: np.ndarray, cov: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """The best ratio along the frontier of rewards."""
    best = None
    scale = np.trace(cov) / len(cov) / max(np.abs(mu).max(), 1e-12)
    for k in np.linspace(0, 20, 41):
        w = minimum_variance(cov, cap, mu, k * scale)
        s = mu @ w / np.sqrt(w @ cov @ w)
        if best is None or s > best[0]:
            best = s, w
    return best[1]


def risk_parity(cov: np.ndarray) -> np.ndarray:
    """Equal contributions to risk, by cyclic coordinate descent."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(200):
        for i in range(n):
            c = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-c + np.sqrt(c * c + 4 * cov[i, i] / n)) / (2 * cov[i, i])
    return w / w.sum()


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Assets ordered by single linkage of correlation distances, then halved, each half weighed by its inverse variance."""
    n, sd = len(cov), np.sqrt(np.diag(cov))
    far = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, None))
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        _, a, b = min((far[np.ix_(groups[a], groups[b])].min(), a, b) for a in range(len(groups)) for b in range(a))
        groups[b] += groups.pop(a)
    w = np.ones(n)

    def spread(part):
        v = 1 / np.diag(cov)[part]
        v /= v.sum()
        return v @ cov[np.ix_(part, part)] @ v

    parts = [groups[0]]
    while parts:
        p = parts.pop()
        if len(p) > 1:
            a, b = p[: len(p) // 2], p[len(p) // 2 :]
            share = 1 - spread(a) / (spread(a) + spread(b))
            w[a] *= share
            w[b] *= 1 - share
            parts += [a, b]
    return w


def black_litterman(mu: np.ndarray, cov: np.ndarray, views: dict[int, tuple[float, float]], tau: float = 0.05) -> np.ndarray:
    """Posterior means: ``mu`` moved toward absolute views (asset: (return, confidence)), each as sure as its confidence."""
    p = np.zeros((len(views), len(mu)))
    q = np.array([v for v, _ in views.values()])
    p[np.arange(len(views)), list(views)] = 1
    omega = np.diag([tau * cov[i, i] / max(c, 1e-9) for i, (_, c) in views.items()])
    prior = np.linalg.inv(tau * cov)
    return np.linalg.solve(prior + p.T @ np.linalg.inv(omega) @ p, prior @ mu + p.T @ np.linalg.inv(omega) @ q)


def moments(df: DataFrame, key: str = "portfolio", parts: int = 64) -> DataFrame:
    """``key``, ``symbols`` (sorted), ``n``, ``mean`` and ``covariance`` (row by row, divisor n - 1) of a key's daily returns, over the days on which all of its symbols have one.

    Days are dealt into ``parts`` a key; each part gives its sums and products, and only these meet: symbols squared of numbers a part, whatever the number of days. Rows without a key are left out.
    """
    with_package(df.sparkSession)
    x = df.select(F.col(key).alias("k"), "symbol", "d", F.col("ret").cast("double").alias("ret"))
    kind = x.schema["k"].dataType.simpleString()
    names = x.groupBy("k").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    known = x.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    days = known.groupBy("k", "d").agg(F.sort_array(F.collect_list(F.struct("symbol", "ret"))).alias("r"))
    whole = days.join(names, "k").where(F.size("r") == F.size("symbols")).select("k", F.pmod(F.xxhash64("d"), F.lit(parts)).alias("part"), F.col("r.ret").alias("r"))

    def add(f: pd.DataFrame) -> pd.DataFrame:
        r = np.stack(f["r"].to_numpy())
        return pd.DataFrame({"k": f["k"].iloc[:1], "n": [len(r)], "s": [r.sum(0)], "p": [(r.T @ r).ravel()]})

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        n, s = int(f["n"].sum()), f["s"].sum()
        p = f["p"].sum().reshape(len(s), len(s))
        cov = (p - np.outer(s, s) / n) / (n - 1) if n > 1 else np.full_like(p, np.nan)
        return pd.DataFrame({"k": f["k"].iloc[:1], "n": [n], "mean": [s / n], "covariance": [cov.ravel()]})

    sums = whole.groupBy("k", "part").applyInPandas(add, f"k {kind}, n long, s array<double>, p array<double>")
    found = sums.groupBy("k").applyInPandas(finish, f"k {kind}, n long, mean array<double>, covariance array<double>")
    return found.join(names, "k").select(F.col("k").alias(key), "symbols", "n", "mean", "covariance")


def by_group(df: DataFrame, solve, schema: str, key: str = "portfolio", least: int = 20) -> DataFrame:
    """``solve(symbols, annual means, annual covariance)`` for each key, over the days that all of its symbols have, at least ``least`` of them; it gives rows without the key.

    A key's :func:`moments` reach the solver, not its returns; keys of one symbol have no rows.
    """
    m = moments(df, key).where((F.col("n") >= least) & (F.size("symbols") >= 2))
    kind = m.schema[key].dataType.simpleString()

    def run(batches):
        for f in batches:
            rows = []
            for k, names, mean, cov in zip(f[key], f["symbols"], f["mean"], f["covariance"]):
                c = np.array(cov, float).reshape(len(names), len(names))
                rows += [(k, *r) for r in solve(list(names), np.array(mean, float) * 252, c * 252 + np.eye(len(names)) * 1e-10)]
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in schema.split(", "))])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work a key: not to be gathered into few tasks
    return m.repartition(tasks, key).mapInPandas(run, f"{key} {kind}, {schema}")


def optimal_weights(df: DataFrame, cap: float = 0.4, key: str = "portfolio") -> DataFrame:
    """Weights of a key's symbols by five methods, from the dates that all of them have."""

    def solve(names, mu, cov):
        made = {"equal": np.full(len(mu), 1 / len(mu)), "minimum_variance": minimum_variance(cov, cap), "maximum_sharpe": maximum_sharpe(mu, cov, cap), "risk_parity": risk_parity(cov), "hierarchical": hierarchical_risk_parity(cov)}
        return [(m, s, float(v)) for m, w in made.items() for s, v in zip(names, w)]

    return by_group(df, solve, "method string, symbol string, weight double", key)


class Limits:
    """Long-only weights that add to 1, each at most ``cap``, those of a sector together at most its limit."""

    def __init__(self, sectors: list[str | None], limits: dict[str, float], cap: float):
        names = sorted({s for s in sectors if s in limits})
        self.of = np.array([names.index(s) if s in limits else len(names) for s in sectors])
        self.most = np.array([*(limits[s] for s in names), np.inf])
        self.cap = cap

    def feasible(self) -> bool:
        return bool(np.minimum(np.bincount(self.of, minlength=len(self.most)) * self.cap, self.most).sum() >= 1 - 1e-12)

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """The nearest such weights to ``v``. At a common shift each sector holds the lesser of its limit and its clipped sum, so the shift is found
        first, by bisection on the total, and then a further shift in each sector that its limit binds."""

        def level(x: np.ndarray, total) -> float:
            lo, hi = x.min() - self.cap - 1, x.max()
            for _ in range(60):
                m = (lo + hi) / 2
                lo, hi = (m, hi) if total(np.clip(x - m, 0, self.cap)) else (lo, m)
            return (lo + hi) / 2

        held = lambda w: np.bincount(self.of, w, len(self.most))
        v = v - level(v, lambda w: np.minimum(held(w), self.most).sum() > 1)
        w = np.clip(v, 0, self.cap)
        for s in np.flatnonzero(held(w) > self.most):
            at = self.of == s
            w[at] = np.clip(v[at] - level(v[at], lambda x: x.sum() > self.most[s]), 0, self.cap)
        return w


def limited_weights(mu: np.ndarray, cov: np.ndarray, limits: Limits, risk_free: float | None = None, steps: int = 500) -> np.ndarray:
    """Least variance under ``limits``; with ``risk_free`` the greatest Sharpe ratio, from the best of a line of rewards, each by projected gradient."""
    slope = 0.5 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)

    def least(reward: float, w: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            w = limits.nearest(w - slope * (2 * cov @ w - reward * mu))
        return w

    w = least(0.0, limits.nearest(np.full(len(mu), 1 / len(mu))))
    if risk_free is None:
        return w
    scale, best = np.trace(cov) / len(cov) / max(np.abs(mu).max(), 1e-12), None
    for k in np.linspace(0, 20, 21):
        w = least(k * scale, w)
        ratio = (mu @ w - risk_free) / np.sqrt(w @ cov @ w)
        if best is None or ratio > best[0]:
            best = ratio, w
    return best[1]


def sector_limited_weights(df: DataFrame, sectors: DataFrame, limits: dict[str, float], cap: float = 0.4, risk_free: float = 0.07, key: str = "portfolio") -> DataFrame:
    """Weights of a key's symbols of least variance (``min_volatility``) and greatest Sharpe ratio (``max_sharpe``), within a cap for each symbol and a limit for each sector.

    ``sectors``: ``symbol``, ``sector``, one row a symbol, as many as are traded; they join the returns as ``sector:symbol`` names. Symbols without a sector have no limit but the cap.
    A key whose limits cannot hold the whole of 1 has no rows.
    """
    tagged = df.join(sectors.select("symbol", "sector"), "symbol", "left").withColumn("symbol", F.concat(F.coalesce("sector", F.lit("")), F.lit("\0"), F.col("symbol"))).drop("sector")

    def solve(names, mu, cov):
        within = Limits([n.split("\0")[0] for n in names], limits, cap)
        if not within.feasible():
            return []
        made = {"min_volatility": limited_weights(mu, cov, within), "max_sharpe": limited_weights(mu, cov, within, risk_free)}
        return [(m, n.split("\0")[1], n.split("\0")[0] or None, float(v)) for m, w in made.items() for n, v in zip(names, w)]

    return by_group(tagged, solve, "method string, symbol string, sector string, weight double", key)


def correlation_spectrum(df: DataFrame, key: str = "portfolio", least: int = 10, ill: float = 10.0) -> DataFrame:
    """Of each key's symbols, over the days that all have (at least ``least``): ``observations``, falling ``eigenvalues`` of their correlation matrix, ``condition_number`` (infinite if the last is not
    positive), ``ill_diversified`` (over ``ill``), the mean correlation of pairs, and the highest and lowest pair with theirs (ties: first by name). Symbols without variance leave their key without rows."""
    m = moments(df, key).where((F.col("n") >= least) & (F.size("symbols") >= 2))
    kind = m.schema[key].dataType.simpleString()
    schema = "observations long, eigenvalues array<double>, condition_number double, ill_diversified boolean, mean_correlation double, highest_pair string, highest double, lowest_pair string, lowest double"

    def run(batches):
        for f in batches:
            rows = []
            for k, names, n, cov in zip(f[key], f["symbols"], f["n"], f["covariance"]):
                c = np.array(cov, float).reshape(len(names), len(names))
                sd = np.sqrt(np.diag(c))
                if not (sd > 0).all():
                    continue
                c = c / np.outer(sd, sd)
                e = np.linalg.eigvalsh(c)[::-1]
                i, j = np.triu_indices(len(names), 1)
                r, cond = c[i, j], float(e[0] / e[-1]) if e[-1] > 0 else float("inf")
                hi, lo = int(np.argmax(r)), int(np.argmin(r))
                pair = lambda p: f"{names[i[p]]}-{names[j[p]]}"
                rows.append((k, int(n), e, cond, cond > ill, float(r.mean()), pair(hi), float(r[hi]), pair(lo), float(r[lo])))
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in schema.split(", "))])

    return m.mapInPandas(run, f"{key} {kind}, {schema}")


def frontier(mu: np.ndarray, cov: np.ndarray, points: int = 20, cap: float = 1.0) -> list[tuple[float, float]]:
    """(return, volatility) of portfolios of least variance for rewards that rise from none."""
    scale = np.trace(cov) / len(cov) / max(np.abs(mu).max(), 1e-12)
    made = [minimum_variance(cov, cap, mu, k * scale) for k in np.linspace(0, 20, points)]
    return [(float(w @ mu), float(np.sqrt(w @ cov @ w))) for w in made]


def weight_metrics(returns: DataFrame, weights: DataFrame, risk_free: float = 0.07) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown and Calmar of weights held daily, with their concentration."""
    from ledgerlark.operators.backtest import risk_bundle, weighted_returns

    r = risk_bundle(weighted_returns(returns, weights), risk_free)
    c = weights.groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.count_if(F.col("weight") > 0.001).alias("held"))
    return r.join(c, "portfolio")
