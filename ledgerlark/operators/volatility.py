"""Volatility models over long series: blocks with a halo, rolling refits, diagnostics of residuals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.models import fit_garch, garch_filter
from ledgerlark.operators.order import numbered
from ledgerlark.session import with_package


def haloed(df: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows (with ``idx``) dealt into blocks of ``size``: ``block``, each with the ``before`` rows ahead of it and the ``after`` rows behind it."""
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - after) / size)).cast("long")
    return df.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("idx") + before) / size).cast("long"))))


def fit_windows(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha, beta and log-likelihood of GARCH(1,1) for each row of ``r``, all filtered together: the search of :func:`fit_garch` in each."""
    r = r - r.mean(1, keepdims=True)
    target = r.var(1)
    grid = [(a, b) for a in np.arange(0.02, 0.4, 0.06) for b in np.arange(0.3, 0.98, 0.08)]
    a, b = (np.tile(x, (len(r), 1)) for x in np.array(grid).T)
    best = np.full(len(r), np.inf)
    centre = np.zeros((len(r), 2))
    step = 0.08
    for _ in range(3):
        ok = (a > 0) & (b >= 0) & (a + b < 0.999)
        omega, v, score = target[:, None] * (1 - a - b), np.repeat(target[:, None], a.shape[1], 1), np.zeros(a.shape)
        with np.errstate(all="ignore"):
            for t in range(r.shape[1]):
                x = (r[:, t] ** 2)[:, None]
                score += np.log(v) + x / v
                v = omega + a * x + b * v
        score = np.where(ok & np.isfinite(score), score, np.inf)
        k = score.argmin(1)
        rows = np.arange(len(r))
        better = score[rows, k] < best
        best = np.where(better, score[rows, k], best)
        centre[better] = np.stack([a[rows, k], b[rows, k]], 1)[better]
        step /= 3
        offsets = np.array([(i * step, j * step) for i in range(-2, 3) for j in range(-2, 3)])
        a, b = centre[:, :1] + offsets[:, 0], centre[:, 1:] + offsets[:, 1]
    n = r.shape[1]
    return target * (1 - centre.sum(1)), centre[:, 0], centre[:, 1], -0.5 * (best + n * math.log(2 * math.pi))


def rolling_garch(df: DataFrame, window: int = 252, step: int = 21, key: str = "symbol", order: str = "d", value: str = "ret", together: int = 24) -> DataFrame:
    """GARCH(1,1) refitted over each whole window of ``window`` rows, every ``step`` rows of a key.

    A row lies in ``window / step`` windows, but it is not copied so often: ``together`` neighbouring windows are a block of the
    series with a halo behind it, which copies half of the rows at the defaults, and each block is a task of its own however
    long the series. Null values are left out first; windows without variance are left out. Returns ``key``, ``window`` (from 0), ``window_end``, ``omega``, ``alpha``,
    ``beta``, ``loglikelihood``, ``aic``, ``bic`` (four parameters, with the mean).
    """
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("r")), "k", "o")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fit(names, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        r, first = f["r"].to_numpy(float), int(f["idx"].iloc[0])
        starts = np.array([s for s in range(first, first + together * step, step) if s + window <= first + len(r)], int)
        if len(starts):
            starts = starts[[r[s - first : s - first + window].std() > 0 for s in starts]]
        x = np.stack([r[s - first : s - first + window] for s in starts]) if len(starts) else np.zeros((0, window))
        omega, a, b, ll = fit_windows(x) if len(starts) else (np.zeros(0),) * 4
        ends = f["o"].to_numpy()[starts - first + window - 1] if len(starts) else []
        return pd.DataFrame({"k": f["k"].iloc[0], "window": starts // step, "window_end": ends, "omega": omega, "alpha": a, "beta": b, "loglikelihood": ll, "aic": 8 - 2 * ll, "bic": 4 * math.log(window) - 2 * ll})

    blocks = haloed(rows, together * step, after=window - step)
    out = blocks.groupBy("k", "block").applyInPandas(fit, f"k {kinds['k']}, window long, window_end {kinds['o']}, omega double, alpha double, beta double, loglikelihood double, aic double, bic double")
    return out.withColumnRenamed("k", key)


#: The mean of the absolute value of a standard normal number.
_MEAN_ABS = math.sqrt(2 / math.pi)
MODELS = ("garch", "gjr", "egarch")


def filtered(model: str, e: np.ndarray, target: float, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the negative log-likelihood (without its constant) of residuals ``e`` for each row (alpha, gamma, beta) of ``p``, infinite where a row is not stationary, and the variance after the last.

    The long-run variance is held at ``target``. ``garch``: v' = omega + alpha e^2 + beta v. ``gjr``: alpha grows by gamma after losses. ``egarch``: ln v' = omega + alpha (abs(z) - mean) + gamma z + beta ln v.
    """
    a, g, b = p.T
    with np.errstate(all="ignore"):
        if model == "egarch":
            ok, log = np.abs(b) < 0.999, np.full(len(p), math.log(target))
            score, omega = np.zeros(len(p)), (1 - b) * math.log(target)
            for x in e:
                z = x * np.exp(-0.5 * log)
                score += log + z * z
                log = omega + a * (np.abs(z) - _MEAN_ABS) + g * z + b * log
            v = np.exp(log)
        else:
            g = g if model == "gjr" else 0 * g
            ok = (a >= 0) & (a + g >= 0) & (b >= 0) & (a + g / 2 + b < 0.999)
            score, v, omega = np.zeros(len(p)), np.full(len(p), target), target * (1 - a - g / 2 - b)
            for x in e:
                score += np.log(v) + x * x / v
                v = omega + (a + g * (x < 0)) * (x * x) + b * v
    return np.where(ok & np.isfinite(score), score, np.inf), v


def fit_volatility(model: str, r: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, float, float]:
    """(alpha, gamma, beta), log-likelihood and next variance by the greatest likelihood over a grid, made finer ``rounds`` times around its best."""
    e, target = r - r.mean(), float(r.var())
    gammas = np.arange(-0.3, 0.31, 0.1) if model == "egarch" else np.arange(-0.1, 0.31, 0.1) if model == "gjr" else np.zeros(1)
    alphas = np.arange(0.0, 0.51, 0.06)
    p = np.array([(a, g, b) for a in alphas for g in gammas for b in np.arange(0.0, 0.99, 0.08)])
    step, best = np.array([0.06, 0.1 if len(gammas) > 1 else 0.0, 0.08]), None
    for _ in range(rounds + 1):
        score, v = filtered(model, e, target, p)
        k = int(score.argmin())
        if best is None or score[k] < best[1]:
            best = p[k], float(score[k]), float(v[k])
        step = step / 2.5
        at = [(i, j, k) for i in range(-2, 3) for j in (range(-2, 3) if step[1] else (0,)) for k in range(-2, 3)]
        p = best[0] + np.array(at) * step
    return best[0], -0.5 * (best[1] + len(r) * math.log(2 * math.pi)), best[2]


def volatility_models(df: DataFrame, models: Sequence[str] = MODELS, steps: int = 5, levels: Sequence[float] = (0.95, 0.99), key: str = "portfolio", order: str = "d", value: str = "ret", least: int = 30) -> DataFrame:
    """GARCH(1,1), GJR-GARCH(1,1,1) and EGARCH(1,1,1) of each key: parameters, log-likelihood, AIC and BIC, whether it is the ``best`` (least AIC) of its key, volatilities forecast ``steps`` rows on,
    and the next row's value at risk and expected shortfall at ``levels`` (signed: losses are negative), for normal shocks.

    Forecasts go back to the long-run variance (those of EGARCH in logarithms). A key's series is one task for each model, of days; longer ones by :func:`rolling_garch`. Nulls are left out; keys of fewer
    than ``least`` values or without variance have no rows.
    """
    with_package(df.sparkSession)
    x = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("r"), F.explode(F.array(*map(F.lit, models))).alias("model"))
    normal = NormalDist()
    names = ["k", "model", "n", "omega", "alpha", "gamma", "beta", "loglikelihood", "aic", "bic", "volatilities", "value_at_risk", "expected_shortfall"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r, model = f.sort_values("o", kind="stable")["r"].to_numpy(float), f["model"].iloc[0]
        if len(r) < least or r.std() == 0:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        (a, g, b), ll, v = fit_volatility(model, r)
        target = float(r.var())
        stay = b if model == "egarch" else a + b + (g / 2 if model == "gjr" else 0)
        omega = (1 - b) * math.log(target) if model == "egarch" else target * (1 - stay)
        ahead = [v]
        for _ in range(steps - 1):
            ahead.append(math.exp(omega + b * math.log(ahead[-1])) if model == "egarch" else omega + stay * ahead[-1])
        sd, mean, size = math.sqrt(v), float(r.mean()), 4 if model == "garch" else 5
        z = [normal.inv_cdf(1 - level) for level in levels]
        tails = [mean - sd * normal.pdf(q) / (1 - level) for q, level in zip(z, levels)]
        row = [f["k"].iloc[0], model, len(r), omega, a, g if model != "garch" else None, b, ll, 2 * size - 2 * ll, size * math.log(len(r)) - 2 * ll, [math.sqrt(y) for y in ahead], [mean + q * sd for q in z], tails]
        return pd.DataFrame([row], columns=names)

    kind = x.schema["k"].dataType.simpleString()
    numbers = "omega double, alpha double, gamma double, beta double, loglikelihood double, aic double, bic double, volatilities array<double>, value_at_risk array<double>, expected_shortfall array<double>"
    made = x.groupBy("k", "model").applyInPandas(run, f"k {kind}, model string, n long, {numbers}")
    best = F.row_number().over(Window.partitionBy("k").orderBy("aic", "model")) == 1  # as many rows a key as there are models
    return made.withColumn("best", best).withColumnRenamed("k", key)


def chi2_sf(x: float, k: int) -> float:
    """The chance that a chi-square of ``k`` degrees exceeds ``x``: the regularised upper incomplete gamma function of k/2 and x/2, by its series or its continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def standardised(df: DataFrame, key: str = "portfolio", order: str = "d", value: str = "ret", least: int = 30) -> DataFrame:
    """Residuals over their conditional deviations (``z``) by a GARCH(1,1) fitted to each key, one key a task: series of days."""
    with_package(df.sparkSession)
    x = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("r"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o")
        r = f["r"].to_numpy()
        if len(r) < least or r.std() == 0:
            return pd.DataFrame({"k": [], "o": [], "z": []})
        e = r - r.mean()
        return pd.DataFrame({"k": f["k"], "o": f["o"], "z": e / np.sqrt(garch_filter(e, *fit_garch(r))[:-1])})

    return x.groupBy("k").applyInPandas(run, f"k {kinds['k']}, o {kinds['o']}, z double").toDF(key, order, "z")


def diagnostics(df: DataFrame, key: str = "portfolio", order: str = "d", value: str = "z", lags: int = 20, arch_lags: int = 10, block: int = 4096) -> DataFrame:
    """Tests of standardised residuals by key: Ljung-Box of them and of their squares, the ARCH-LM test, and their moments.

    At most ``lags`` lags, and a fifth of the rows (``arch_lags`` likewise). Sums of lagged products are taken over blocks of the
    series, each with the rows ahead of it that its lags reach, and added by Spark: only sums meet, a few hundred a key. The LM test regresses squares on their
    lags 1 to m, m rows being lost at the start; its statistic is rows times R squared. A p-value is that of the chi-square distribution. Keys of fewer than five rows have nulls. Nulls are left out first.
    """
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("z")), "k", "o")
    by = rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("z").alias("m1"), F.avg(F.col("z") * F.col("z")).alias("m2"))
    kind = rows.schema["k"].dataType.simpleString()
    reach = max(lags, arch_lags)
    w = arch_lags + 2

    def sums(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        z, idx, n, b = f["z"].to_numpy(), f["idx"].to_numpy(), int(f["n"].iloc[0]), int(f["block"].iloc[0])
        own = int(np.searchsorted(idx, b * block))
        d, e = z - f["m1"].iloc[0], z * z - f["m2"].iloc[0]
        out = [np.array([(x[own:] ** 2).sum(), *(x[max(own, j) :] @ x[max(own, j) - j : len(x) - j] if len(x) > max(own, j) else 0.0 for j in range(1, lags + 1))]) for x in (d, e)]
        m = min(arch_lags, n // 5)
        at = np.arange(max(own, m - int(idx[0])), len(z))  # rows that have m rows ahead of them
        x = np.column_stack([np.ones(len(at)), *(e[at - j] for j in range(1, m + 1)), e[at]]) if m else np.zeros((0, 2))
        gram = np.zeros((w, w))
        gram[: x.shape[1], : x.shape[1]] = x.T @ x
        moments = [(d[own:] ** k).sum() for k in (3, 4)]
        values = np.concatenate([*out, gram.ravel(), moments])
        return pd.DataFrame({"k": f["k"].iloc[0], "i": np.arange(len(values)), "s": values})

    x = haloed(rows.join(by, "k"), block, before=reach).where(F.col("block") * block < F.col("n"))
    parts = x.groupBy("k", "block").applyInPandas(sums, f"k {kind}, i int, s double")
    added = parts.groupBy("k", "i").agg(F.sum("s").alias("s")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))

    def test(batches):
        for f in batches:
            out = []
            for k, n, m1, s in zip(f["k"], f["n"], f["m1"], f["s"]):
                v = np.array(s, float)
                m, a = min(lags, n // 5), min(arch_lags, n // 5)
                row = [k, n, m]
                for x in (v[: lags + 1], v[lags + 1 : 2 * lags + 2]):
                    stat = n * (n + 2) * sum((x[j] / x[0]) ** 2 / (n - j) for j in range(1, m + 1)) if m and x[0] > 0 else None
                    row += [stat, None if stat is None else chi2_sf(stat, m)]
                gram = v[2 * lags + 2 : 2 * lags + 2 + w * w].reshape(w, w)[: a + 2, : a + 2]
                lm = None
                if a and n > a:
                    xx, xy, yy, t = gram[: a + 1, : a + 1], gram[: a + 1, a + 1], gram[a + 1, a + 1], gram[0, 0]
                    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
                    sst = yy - gram[0, a + 1] ** 2 / t
                    lm = float(t * (1 - (yy - beta @ xy) / sst)) if sst > 0 else 0.0
                var = v[0]
                sd = math.sqrt(var / (n - 1)) if n > 1 else None
                skew = math.sqrt(n * (n - 1)) / (n - 2) * (v[-2] / n) / (var / n) ** 1.5 if n > 2 and var > 0 else None
                kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (v[-1] / n) / (var / n) ** 2 - 3 * (n - 1)) if n > 3 and var > 0 else None
                out.append([*row, a, lm, None if lm is None else chi2_sf(lm, a), m1, sd, skew, kurt])
            yield pd.DataFrame(out, columns=names)

    names = ["k", "n", "lags", "lb_stat", "lb_pvalue", "lb_sq_stat", "lb_sq_pvalue", "arch_lags", "lm_stat", "lm_pvalue", "mean", "std", "skewness", "kurtosis"]
    types = ", ".join(f"{c} {'long' if c in ('n', 'lags', 'arch_lags') else 'double'}" for c in names[1:])
    arrays = added.select("k", F.col("s.s").alias("s"))
    return by.join(arrays, "k").select("k", "n", "m1", "s").mapInPandas(test, f"k {kind}, {types}").withColumnRenamed("k", key)
