"""Back-test and risk metrics of return series. Several definitions coexist; each is a named variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.order import numbered, quantiles

#: One-sided normal quantiles of the usual levels, and densities there.
Z = {0.90: 1.2815515655446004, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}


def weighted_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """portfolio, d, ret: weights times returns over the symbols of the day, weights renormalised."""
    x = returns.join(weights, "symbol")
    return x.groupBy("portfolio", "d").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"))


def by_day(key: str = "portfolio") -> Window:
    return Window.partitionBy(key).orderBy("d")


def with_equity(df: DataFrame, key: str = "portfolio") -> DataFrame:
    """Equity by compounding, its running peak, and drawdown. Returns must be over -1."""
    so_far = by_day(key).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(so_far)))
    df = df.withColumn("peak", F.max("equity").over(so_far))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def moments(df: DataFrame, key: str = "portfolio") -> DataFrame:
    """Skewness and kurtosis: corrected for bias, and with sample deviations; excess over 3 for the first."""
    n, g1, g2 = F.count("ret"), F.skewness("ret"), F.kurtosis("ret")
    m, s = F.avg("ret"), F.stddev_samp("ret")
    x = df.groupBy(key).agg(n.alias("n"), g1.alias("g1"), g2.alias("g2"), m.alias("m"), s.alias("s"), F.var_pop("ret").alias("v"))
    k = F.col("n").cast("double")
    skew = F.col("g1") * F.sqrt(k * (k - 1)) / (k - 2)
    kurt = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.col("g2") + 6)
    ratio = F.sqrt(F.col("v")) / F.col("s")
    return x.select(key, "n", skew.alias("skew"), kurt.alias("kurtosis"), (F.col("g1") * ratio**3).alias("skew_sample"), ((F.col("g2") + 3) * ratio**4).alias("kurt_sample"), F.col("m").alias("mean"), F.col("s").alias("std"))


def value_at_risk(df: DataFrame, level: float, method: str = "index", key: str = "portfolio") -> DataFrame:
    """VaR and CVaR. ``index``: the return at place int((1 - level) n) from below, as a positive loss; ``signed``: the same, negative;
    ``quantile``: the interpolated quantile, and the mean of what is at or below it; ``normal``: from mean and deviation;
    ``cornish_fisher``: with skewness and kurtosis."""
    a = round(1 - level, 10)
    if method in ("index", "signed"):
        x = numbered(df.select(key, "d", "ret"), key, "ret", "d")
        x = x.where(F.col("idx") <= F.floor(F.col("rows") * a)).groupBy(key).agg(F.max("ret").alias("var"), F.avg("ret").alias("cvar"))
        sign = -1 if method == "index" else 1
        return x.select(key, (sign * F.col("var")).alias("var"), (sign * F.col("cvar")).alias("cvar"))
    if method == "quantile":
        q = quantiles(df, key, "ret", [a]).select(key, F.col("q")[0].alias("var"))
        return df.join(q, key).groupBy(key).agg(F.first("var").alias("var"), F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"))
    z = -Z[level]
    m = moments(df, key)
    if method == "normal":
        from math import exp, pi, sqrt

        density = exp(-z * z / 2) / sqrt(2 * pi)
        return m.select(key, (F.col("mean") + z * F.col("std")).alias("var"), (F.col("mean") - F.col("std") * density / a).alias("cvar"))
    s, k = F.col("skew"), F.col("kurtosis")
    q = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    return m.select(key, (F.col("mean") + q * F.col("std")).alias("var"))


def risk_bundle(df: DataFrame, risk_free: float = 0.07, arithmetic: bool = True, key: str = "portfolio") -> DataFrame:
    """Annual return (arithmetic or compounded), volatility, Sharpe, Sortino (below zero), Calmar, drawdown, level."""
    dd = with_equity(df, key).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", "d").alias("current_drawdown"))
    annual = F.avg("ret") * 252 if arithmetic else F.exp(F.sum(F.ln(1 + F.col("ret"))) * 252 / F.count("*")) - 1
    x = df.groupBy(key).agg(
        F.count("*").alias("days"), annual.alias("annual_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"),
        (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(F.lit(252.0))).alias("downside"),
    ).join(dd, key)
    excess = F.col("annual_return") - risk_free
    level = F.when(F.col("volatility") > 0.30, "very_high").when(F.col("volatility") > 0.20, "high").when(F.col("volatility") > 0.12, "medium").otherwise("low")
    return x.select(
        key, "days", "annual_return", "volatility", (excess / F.nullif("volatility", F.lit(0.0))).alias("sharpe"), (excess / F.nullif("downside", F.lit(0.0))).alias("sortino"),
        (F.col("annual_return") / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).alias("calmar"), "max_drawdown", "current_drawdown", level.alias("risk_level"),
    )


def win_stats(df: DataFrame, key: str = "portfolio") -> DataFrame:
    """Win rate, mean win and loss, their ratio (infinite without losses), best and worst day."""
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    x = df.groupBy(key).agg(F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), win.alias("avg_win"), loss.alias("avg_loss"), F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"))
    return x.withColumn("profit_loss_ratio", F.when(F.col("avg_loss").isNull(), F.lit(float("inf"))).otherwise(F.col("avg_win") / F.abs("avg_loss")))


def compounded(df: DataFrame, unit: str, key: str = "portfolio") -> DataFrame:
    """Return of each month (``MM``) or year (``YY``)."""
    return df.groupBy(key, F.trunc("d", unit).alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def against_benchmark(df: DataFrame, benchmark: DataFrame, risk_free: float = 0.0, key: str = "portfolio", least: int = 20) -> DataFrame:
    """Beta, correlation, alpha, tracking error and information ratio on common days, at least ``least`` of them."""
    x = df.join(benchmark.select("d", F.col("ret").alias("b")), "d").groupBy(key)
    root = F.sqrt(F.lit(252.0))
    x = x.agg(F.count("*").alias("days"), (F.covar_samp("ret", "b") / F.var_samp("b")).alias("beta"), F.corr("ret", "b").alias("corr"), (F.avg("ret") * 252).alias("r"), (F.avg("b") * 252).alias("rb"), (F.stddev_samp(F.col("ret") - F.col("b")) * root).alias("te"))
    x = x.where(F.col("days") >= least)
    return x.select(key, "days", "beta", "corr", (F.col("r") - risk_free - F.col("beta") * (F.col("rb") - risk_free)).alias("alpha"), F.col("te").alias("tracking_error"), ((F.col("r") - F.col("rb")) / F.nullif("te", F.lit(0.0))).alias("information_ratio"))


def rolling_metrics(df: DataFrame, n: int = 252, key: str = "portfolio") -> DataFrame:
    """Sharpe (no risk-free rate), volatility and annual return over the last ``n`` days; full windows only."""
    w = by_day(key).rowsBetween(-(n - 1), 0)
    df = df.withColumn("k", F.count("ret").over(w)).withColumn("m", F.avg("ret").over(w) * 252).withColumn("s", F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0))).where(F.col("k") == n)
    return df.select(key, "d", (F.col("m") / F.nullif("s", F.lit(0.0))).alias("sharpe"), F.col("s").alias("volatility"), F.col("m").alias("annual_return"))


def stepped_windows(df: DataFrame, n: int = 252, step: int = 21, key: str = "portfolio") -> DataFrame:
    """Return, volatility and days of each window of ``n`` days that starts at a multiple of ``step``. A row goes only to its own windows."""
    w = Window.partitionBy(key)
    x = df.withColumn("i", F.row_number().over(w.orderBy("d")) - 1).withColumn("total", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (n - 1)) / step)).cast("int")
    last = F.floor(F.least(F.col("i"), F.col("total") - n) / step).cast("int")
    x = x.withColumn("window", F.when(first <= last, F.sequence(first, last))).withColumn("window", F.explode("window"))
    return x.groupBy(key, "window").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("days"), (F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"))


def correlation_pairs(returns: DataFrame, least: int = 30) -> DataFrame:
    """Correlation of each pair of symbols on common days. Rows meet by day, so a day gives the pairs of its symbols."""
    a = returns.select("d", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    b = returns.select("d", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "d").where("a < b").groupBy("a", "b").agg(F.count("*").alias("days"), F.corr("x", "y").alias("corr")).where(F.col("days") >= least)


def rolling_correlations(returns: DataFrame, n: int = 60, z: float = 2.0) -> DataFrame:
    """Days on which a pair's rolling correlation is over ``z`` deviations from its own mean.

    Sums run along each pair's days and a window's sums are the difference of two of them, so a row costs the same
    whatever ``n``. Pairs grow with the square of the symbols; each pair is a group of its own.
    """
    a = returns.select("d", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    b = returns.select("d", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    w = Window.partitionBy("a", "b").orderBy("d")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"sx": F.col("x"), "sy": F.col("y"), "sxy": F.col("x") * F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y")}
    j = a.join(b, "d").where("a < b").select("a", "b", "d", F.row_number().over(w).alias("k"), *(F.sum(c).over(so_far).alias(s) for s, c in sums.items()))
    j = j.select("a", "b", "k", *((F.col(s) - F.coalesce(F.lag(s, n).over(w), F.lit(0.0))).alias(s) for s in sums)).where(F.col("k") >= n)
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / n
    c = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.nullif(F.sqrt(spread("sx", "sxx") * spread("sy", "syy")), F.lit(0.0))
    every = Window.partitionBy("a", "b")
    x = j.withColumn("c", F.round(c, 9)).withColumn("z", (F.col("c") - F.avg("c").over(every)) / F.nullif(F.stddev_pop("c").over(every), F.lit(0.0)))
    return x.where(F.abs("z") > z).groupBy("a", "b").agg(F.count("*").alias("odd_days"), F.max(F.abs("z")).alias("max_z"))


def stress(holdings: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Loss of each portfolio under each scenario: the sector's shock where it is named, else the market's, by weight.
    ``scenarios``: scenario, market_shock, sector, sector_shock (a few rows, sector null for the market's row)."""
    market = scenarios.where("sector is null").select("scenario", "market_shock")
    own = scenarios.where("sector is not null").select("scenario", "sector", "sector_shock")
    x = holdings.crossJoin(F.broadcast(market)).join(F.broadcast(own), ["scenario", "sector"], "left")
    x = x.withColumn("impact", F.col("weight") * F.coalesce("sector_shock", "market_shock"))
    return x.groupBy("portfolio", "scenario").agg(F.sum("impact").alias("loss_pct"), F.min_by("symbol", F.struct("impact", "symbol")).alias("worst_holding"))


def stress_level(loss: Column) -> Column:
    """Label of a signed loss in per cent."""
    return F.when(loss < -30, "critical").when(loss < -20, "very_high").when(loss < -10, "high").when(loss < -5, "medium").otherwise("low")


def backtest_metrics(df: DataFrame, risk_free: float = 0.07, value: float = 1_000_000.0, key: str = "portfolio") -> DataFrame:
    """The 21 figures of a back-test: compounded return, Sharpe, Sortino below the daily rate, drawdown, VaR, days, moments, final value.

    One shuffle by key: equity runs by day and losses are ranked in the same partitions, then all is one aggregate.
    """
    daily, root = (1 + risk_free) ** (1 / 252) - 1, F.sqrt(F.lit(252.0))
    ret, every = F.col("ret"), Window.partitionBy(key)
    df = with_equity(df, key).withColumn("_rn", F.row_number().over(every.orderBy("ret", "d"))).withColumn("_n", F.count("*").over(every))
    n, rank = F.count("ret").cast("double"), F.col("_rn")
    tails = []
    for level in (0.95, 0.99):
        place = F.floor(F.col("_n") * round(1 - level, 10)) + 1
        tails += [F.max(F.when(rank <= place, ret)).alias(f"var_{level * 100:.0f}"), F.avg(F.when(rank <= place, ret)).alias(f"cvar_{level * 100:.0f}")]
    g = df.groupBy(key).agg(
        (F.exp(F.sum(F.ln(1 + ret)) * 252 / F.count("*")) - 1).alias("annualised_return"), (F.stddev_samp("ret") * root).alias("annualised_volatility"), (F.stddev_samp(F.when(ret < daily, ret - daily)) * root).alias("down"),
        F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"), F.avg((ret > 0).cast("double")).alias("win_rate"), F.avg(F.when(ret > 0, ret)).alias("avg_win"), F.avg(F.when(ret < 0, ret)).alias("avg_loss"),
        (F.exp(F.sum(F.ln(1 + ret))) * value).alias("final_value"), (F.exp(F.sum(F.ln(1 + ret)) - F.ln(1 + F.min_by("ret", "d"))) - 1).alias("total_return"),
        F.min("drawdown").alias("max_drawdown"), (F.skewness("ret") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("ret") + 6)).alias("excess_kurtosis"), *tails,
    )
    excess = F.col("annualised_return") - risk_free
    g = g.withColumn("sharpe_ratio", excess / F.nullif("annualised_volatility", F.lit(0.0))).withColumn("sortino_ratio", excess / F.nullif("down", F.lit(0.0))).withColumn("calmar_ratio", F.col("annualised_return") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))
    return g.withColumn("profit_loss_ratio", F.coalesce(F.col("avg_win") / F.abs("avg_loss"), F.lit(float("inf")))).withColumn("risk_free_rate", F.lit(risk_free)).drop("down")
