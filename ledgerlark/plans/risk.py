"""Queries: returns, back-tests, risk, stress, anomalies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators import anomaly as N
from ledgerlark.operators import backtest as T
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query

P = X.PORTFOLIO_RETURNS
_EQ = f"""with {P}, e as (select portfolio, d, ret, exp(sum(ln(1 + ret)) over (partition by portfolio order by d rows unbounded preceding)) as eq from pret),
 q as (select *, eq / max(eq) over (partition by portfolio order by d rows unbounded preceding) - 1 as dd from e)"""


def r(df, *keep, n=6, **digits):
    """Round all columns but ``keep``."""
    return df.select(*keep, *(F.round(c, digits.get(c, n)).alias(c) for c in df.columns if c not in keep))


@query(_EQ + " select portfolio, d, round(eq, 6) as equity from q")
def w24_equity_curve(spark, d):
    return T.with_equity(X.portfolio_returns(spark, d)).select("portfolio", "d", F.round("equity", 6).alias("equity"))


@query(_EQ + " select portfolio, round(min(dd), 6) as max_drawdown, round(arg_max(dd, d), 6) as current_drawdown from q group by 1")
def w25_drawdown(spark, d):
    return T.with_equity(X.portfolio_returns(spark, d)).groupBy("portfolio").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"), F.round(F.max_by("drawdown", "d"), 6).alias("current_drawdown"))


@query(f"""with {P}, w as (select portfolio, d, count(*) over x as k, avg(ret) over x * 252 as m, stddev_samp(ret) over x * sqrt(252) as s from pret
 window x as (partition by portfolio order by d rows between 251 preceding and current row))
select portfolio, d, round(m / nullif(s, 0), 5) as sharpe, round(s, 6) as volatility, round(m + 1e-10, 6) as annual_return from w where k = 252""")
def w26_rolling_sharpe(spark, d):
    x = T.rolling_metrics(X.portfolio_returns(spark, d))
    return r(x.withColumn("annual_return", F.col("annual_return") + 1e-10), "portfolio", "d", sharpe=5)  # sums of 9 digits can lie on a rounding edge


@query(f"""with {P}, i as (select *, row_number() over (partition by portfolio order by d) - 1 as i, count(*) over (partition by portfolio) as n from pret),
 w as (select i.*, k as w from i, range(0, 1000) t(k) where k * 21 <= i and i < k * 21 + 252 and k * 21 + 252 <= n)
select portfolio, w as "window", min(d) as start, max(d) as "end", count(*) as days, round(exp(sum(ln(1 + ret))) - 1, 6) as total_return, round(stddev_samp(ret) * sqrt(252), 6) as volatility from w group by 1, 2""")
def w27_stepped_windows(spark, d):
    return r(T.stepped_windows(X.portfolio_returns(spark, d)).withColumn("window", F.col("window").cast("bigint")), "portfolio", "window", "start", "end", "days")


_PAIRS = f"with {X.RETURNS}, j as (select a.symbol as a, b.symbol as b, a.d, a.ret as x, b.ret as y from returns a join returns b on a.d = b.d and a.symbol < b.symbol)"


@query(_PAIRS + """, w as (select a, b, d, count(*) over x as k, round(corr(x, y) over x, 9) as c from j window x as (partition by a, b order by d rows between 59 preceding and current row)),
 z as (select a, b, (c - avg(c) over (partition by a, b)) / nullif(stddev_pop(c) over (partition by a, b), 0) as z from w where k = 60)
select a, b, count(*) as odd_days, round(max(abs(z)), 4) as max_z from z where abs(z) > 2 group by 1, 2""")
def w28_rolling_correlations(spark, d):
    return T.rolling_correlations(X.returns(spark, d)).select("a", "b", "odd_days", F.round("max_z", 4).alias("max_z"))


@query(_PAIRS + " select a, b, count(*) as days, round(corr(x, y), 6) as corr from j group by 1, 2 having count(*) >= 30")
def f15_correlation_pairs(spark, d):
    return T.correlation_pairs(X.returns(spark, d)).select("a", "b", "days", F.round("corr", 6).alias("corr"))


_ALL_PAIRS = f"with {X.RETURNS}, j as (select a.symbol as a, b.symbol as b, a.d, a.ret as x, b.ret as y from returns a join returns b on a.d = b.d and a.symbol < b.symbol)"


@query(_ALL_PAIRS + """, w as (select a, b, d, count(*) over x as k, round(corr(x, y) over x, 9) as c from j window x as (partition by a, b order by d rows between 59 preceding and current row)),
 z as (select a, b, (c - avg(c) over (partition by a, b)) / nullif(stddev_pop(c) over (partition by a, b), 0) as z from w where k = 60)
select a, b, count(*) as odd_days, round(max(abs(z)), 4) as max_z from z where abs(z) > 2 group by 1, 2""")
def w28_rolling_correlations_all(spark, d):
    """The same as ``w28_rolling_correlations``, under its older name."""
    return T.rolling_correlations(X.returns(spark, d)).select("a", "b", "odd_days", F.round("max_z", 4).alias("max_z"))


@query(_ALL_PAIRS + " select a, b, count(*) as days, round(corr(x, y), 6) as corr from j group by 1, 2 having count(*) >= 30")
def f15_correlation_pairs_all(spark, d):
    """The same as ``f15_correlation_pairs``, under its older name."""
    return T.correlation_pairs(X.returns(spark, d)).select("a", "b", "days", F.round("corr", 6).alias("corr"))


for _unit, _name in (("MM", "month"), ("YY", "year")):

    @query(f"with {P} select portfolio, cast(date_trunc('{_name}', d) as date) as period, round(product(1 + ret) - 1, 6) as ret from pret group by 1, 2", f"a06_compounded_{_name}")
    def _compounded(spark, d, unit=_unit):
        return r(T.compounded(X.portfolio_returns(spark, d), unit), "portfolio", "period")


@query(f"""with {P}, b as (select d, avg(ret) as b from returns group by 1), b2 as (select d, round(b, 9) as b from b),
 x as (select portfolio, count(*) as days, covar_samp(ret, b) / var_samp(b) as beta, corr(ret, b) as corr, avg(ret) * 252 as r, avg(b) * 252 as rb, stddev_samp(ret - b) * sqrt(252) as te from pret join b2 using (d) group by 1)
select portfolio, days, round(beta, 6) as beta, round(corr, 6) as corr, round(r - beta * rb, 6) as alpha, round(te, 6) as tracking_error, round((r - rb) / nullif(te, 0), 5) as information_ratio from x where days >= 20""")
def a08_against_benchmark(spark, d):
    b = X.returns(spark, d).groupBy("d").agg(F.round(F.avg("ret"), 9).alias("ret"))
    return r(T.against_benchmark(X.portfolio_returns(spark, d), b), "portfolio", "days", information_ratio=5)


@query(f"""with {P} select portfolio, round(avg((ret > 0)::int), 6) as win_rate, round(avg(ret) filter (ret > 0), 6) as avg_win, round(avg(ret) filter (ret < 0), 6) as avg_loss, max(ret) as best_day, min(ret) as worst_day,
 round(avg(ret) filter (ret > 0) / abs(avg(ret) filter (ret < 0)), 6) as profit_loss_ratio from pret group by 1""")
def a09_win_stats(spark, d):
    return r(T.win_stats(X.portfolio_returns(spark, d)), "portfolio", "best_day", "worst_day")


@query(f"""with {P}, m as (select portfolio, skewness(ret) as sk, kurtosis(ret) as ku, kurtosis_pop(ret) as kp, count(*)::double as n, var_pop(ret) as v, stddev_samp(ret) as s from pret group by 1)
select portfolio, round(sk, 6) as skew, round(ku, 6) as kurtosis, round(sk * (n - 2) / sqrt(n * (n - 1)) * (sqrt(v) / s) ** 3, 6) as skew_sample, round((kp + 3) * (sqrt(v) / s) ** 4, 6) as kurt_sample from m""")
def a10_moments(spark, d):
    return r(T.moments(X.portfolio_returns(spark, d)).select("portfolio", "skew", "kurtosis", "skew_sample", "kurt_sample"), "portfolio")


for _m, _s in (("index", -1), ("signed", 1)):

    @query(f"""with {P}, k as (select *, row_number() over (partition by portfolio order by ret, d) as rn, count(*) over (partition by portfolio) as n from pret)
select portfolio, round({_s} * max(ret), 6) as var, round({_s} * avg(ret), 6) as cvar from k where rn <= floor(n * 0.05) + 1 group by 1""", f"f0{1 if _m == 'index' else 2}_var_{_m}")
    def _var(spark, d, m=_m):
        return r(T.value_at_risk(X.portfolio_returns(spark, d), 0.95, m), "portfolio")


@query(f"""with {P}, q as (select portfolio, quantile_cont(ret, 0.05) as var from pret group by 1)
select portfolio, round(var, 6) as var, round(avg(ret) filter (ret <= var), 6) as cvar from pret join q using (portfolio) group by portfolio, var""")
def f03_var_quantile(spark, d):
    return r(T.value_at_risk(X.portfolio_returns(spark, d), 0.95, "quantile"), "portfolio")


@query(f"""with {P}, m as (select portfolio, avg(ret) as m, stddev_samp(ret) as s from pret group by 1)
select portfolio, round(m - {T.Z[0.99]} * s, 6) as var, round(m - s * exp(-{T.Z[0.99]} * {T.Z[0.99]} / 2) / sqrt(2 * pi()) / 0.01, 6) as cvar from m""")
def f04_var_normal(spark, d):
    return r(T.value_at_risk(X.portfolio_returns(spark, d), 0.99, "normal"), "portfolio")


@query(f"""with {P}, m as (select portfolio, avg(ret) as m, stddev_samp(ret) as sd, skewness(ret) as s, kurtosis(ret) as k, -{T.Z[0.95]} as z from pret group by 1)
select portfolio, round(m + (z + (z * z - 1) * s / 6 + (z ** 3 - 3 * z) * k / 24 - (2 * z ** 3 - 5 * z) * s * s / 36) * sd, 6) as var from m""")
def f05_var_cornish_fisher(spark, d):
    return r(T.value_at_risk(X.portfolio_returns(spark, d), 0.95, "cornish_fisher"), "portfolio")


for _arith, _rf, _name in ((True, 0.07, "f08_risk_bundle"), (False, 0.045, "f09_risk_bundle_compounded")):
    _annual = "avg(ret) * 252" if _arith else "exp(sum(ln(1 + ret)) * 252 / count(*)) - 1"

    @query(_EQ + f""", g as (select portfolio, count(*) as days, {_annual} as ar, stddev_samp(ret) * sqrt(252) as vol, stddev_samp(ret) filter (ret < 0) * sqrt(252) as down, min(dd) as mdd, arg_max(dd, d) as cdd from q group by 1)
select portfolio, days, round(ar, 6) as annual_return, round(vol, 6) as volatility, round((ar - {_rf}) / nullif(vol, 0), 5) as sharpe, round((ar - {_rf}) / nullif(down, 0), 5) as sortino, round(ar / nullif(abs(mdd), 0), 5) as calmar,
 round(mdd, 6) as max_drawdown, round(cdd, 6) as current_drawdown, case when vol > 0.30 then 'very_high' when vol > 0.20 then 'high' when vol > 0.12 then 'medium' else 'low' end as risk_level from g""", _name)
    def _bundle(spark, d, arith=_arith, rf=_rf):
        x = T.risk_bundle(X.portfolio_returns(spark, d), rf, arith)
        level = x.select("portfolio", "risk_level")
        return r(x.drop("risk_level"), "portfolio", "days", sharpe=5, sortino=5, calmar=5).join(level, "portfolio")


@query(f"""with {P}, m as (select portfolio, count(*)::double as n, skewness(ret) as s, kurtosis(ret) as k, avg(ret) * 252 as ar, stddev_samp(ret) * sqrt(252) as vol from pret group by 1),
 j as (select *, n / 6 * ((s * (n - 2) / sqrt(n * (n - 1))) ** 2 + k ** 2 / 4) as jb from m)
select portfolio, round(ar / vol, 5) as sharpe, round(jb, 3) as jarque_bera, round(exp(-jb / 2), 6) as p_value from j""")
def f10_jarque_bera(spark, d):
    m = T.moments(X.portfolio_returns(spark, d))
    n = F.col("n").cast("double")
    jb = n / 6 * (F.pow(F.col("skew") * (n - 2) / F.sqrt(n * (n - 1)), 2) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return m.select("portfolio", F.round(F.col("mean") * 252 / (F.col("std") * F.sqrt(F.lit(252.0))), 5).alias("sharpe"), F.round(jb, 3).alias("jarque_bera"), F.round(F.exp(-jb / 2), 6).alias("p_value"))


@query(f"""with {X.WEIGHTS}, {X.SECTORS} select portfolio, round(sum(weight * weight), 6) as hhi, round(1 / sum(weight * weight), 4) as effective_n, max(weight) as max_weight, min(weight) filter (weight > 0) as min_weight, count(*) as symbols from weights group by 1""")
def a04_concentration(spark, d):
    w = F.col("weight")
    return X.weights(spark, d).groupBy("portfolio").agg(F.round(F.sum(w * w), 6).alias("hhi"), F.round(1 / F.sum(w * w), 4).alias("effective_n"), F.max(w).alias("max_weight"), F.min(F.when(w > 0, w)).alias("min_weight"), F.count("*").alias("symbols"))


@query(f"""with {X.RETURNS}, {X.WEIGHTS}, {X.SECTORS}, m as (select symbol, avg(ret) * 252 as ar from returns group by 1)
select portfolio, sector, round(sum(weight), 6) as weight, round(sum(weight * ar) / sum(weight), 6) as ret, round(sum(weight * ar), 6) as contribution from weights join sectors using (symbol) join m using (symbol) group by 1, 2""")
def a05_sector_attribution(spark, d):
    m = X.returns(spark, d).groupBy("symbol").agg((F.avg("ret") * 252).alias("ar"))
    x = X.weights(spark, d).join(X.sectors(spark, d), "symbol").join(m, "symbol").groupBy("portfolio", "sector")
    c = F.sum(F.col("weight") * F.col("ar"))
    return x.agg(F.round(F.sum("weight"), 6).alias("weight"), F.round(c / F.sum("weight"), 6).alias("ret"), F.round(c, 6).alias("contribution"))


@query(_EQ + """, g as (select portfolio, avg(ret) / stddev_samp(ret) * sqrt(252) as sharpe, min(dd) as max_drawdown, stddev_samp(ret) as vol from q group by 1),
 u as (select portfolio, 'sharpe' as metric, sharpe as v, -sharpe as o from g union all select portfolio, 'max_drawdown', max_drawdown, -max_drawdown from g union all select portfolio, 'volatility', vol, vol from g)
select portfolio, metric, rank() over (partition by metric order by o) as rank from u""")
def o06_strategy_ranking(spark, d):
    """Higher is better for the Sharpe ratio and for (negative) drawdown, lower for volatility."""
    x = T.with_equity(X.portfolio_returns(spark, d)).groupBy("portfolio").agg((F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), (-F.stddev_samp("ret")).alias("volatility"))
    u = x.unpivot("portfolio", ["sharpe", "max_drawdown", "volatility"], "metric", "v")
    return u.select("portfolio", "metric", F.rank().over(Window.partitionBy("metric").orderBy(F.desc("v"))).cast("bigint").alias("rank"))


@query(_EQ + """, g as (select portfolio, avg(ret) * 252 as annual_return, stddev_samp(ret) * sqrt(252) as volatility, stddev_samp(ret) filter (ret < 0) * sqrt(252) as down, min(dd) as max_drawdown from q group by 1),
 m as (select *, annual_return / nullif(volatility, 0) as sharpe, annual_return / nullif(down, 0) as sortino, annual_return / nullif(abs(max_drawdown), 0) as calmar from g),
 u as (select portfolio, unnest(['sharpe', 'annual_return', 'volatility', 'max_drawdown', 'sortino', 'calmar']) as metric, unnest([sharpe, annual_return, -volatility, max_drawdown, sortino, calmar]) as v from m)
select portfolio, metric, rank() over (partition by metric order by v desc nulls last) as rank from u""")
def o06_strategy_ranking_all(spark, d):
    """All six metrics, without a risk-free rate; lower is better for volatility only, as drawdowns are negative. What has no value comes last."""
    x = T.risk_bundle(X.portfolio_returns(spark, d), 0.0).withColumn("volatility", -F.col("volatility"))
    u = x.unpivot("portfolio", ["sharpe", "annual_return", "volatility", "max_drawdown", "sortino", "calmar"], "metric", "v")
    return u.select("portfolio", "metric", F.rank().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("v"))).cast("bigint").alias("rank"))


# Market shocks in per cent of seven scenarios; sector shocks of two of them, under the test tables' own sector names.
SCENARIOS = [
    ("2008 Global Financial Crisis", -35.0, None, None), ("2020 COVID Crash", -38.0, None, None), ("RBI Rate Hike (+200bps)", -10.0, None, None), ("Rupee Depreciation (-10%)", -5.0, None, None),
    ("Sector-specific IT Crash (-25%)", -8.0, None, None), ("FII Panic Selling", -15.0, None, None), ("Moderate Correction (-10%)", -10.0, None, None),
    ("2008 Global Financial Crisis", -35.0, "ECONOMY", -55.0), ("2008 Global Financial Crisis", -35.0, "PROMO", -45.0), ("FII Panic Selling", -15.0, "STANDARD", 5.0),
]
_SC = "sc(scenario, market_shock, sector, sector_shock) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double" for v in row) + ")" for row in SCENARIOS) + ")"


@query(f"""with {X.WEIGHTS}, {X.SECTORS}, {_SC}, m as (select * from sc where sector is null), o as (select * from sc where sector is not null),
 x as (select portfolio, symbol, m.scenario, weight * coalesce(o.sector_shock, m.market_shock) as impact from weights join sectors using (symbol) cross join m left join o on o.scenario = m.scenario and o.sector = sectors.sector)
select portfolio, scenario, round(sum(impact), 6) as loss_pct, arg_min(symbol, (impact, symbol)) as worst_holding,
 case when round(sum(impact), 6) < -30 then 'critical' when round(sum(impact), 6) < -20 then 'very_high' when round(sum(impact), 6) < -10 then 'high' when round(sum(impact), 6) < -5 then 'medium' else 'low' end as level from x group by 1, 2""")
def f17_stress_by_sector(spark, d):
    s = spark.createDataFrame(SCENARIOS, "scenario string, market_shock double, sector string, sector_shock double")
    x = T.stress(X.weights(spark, d).join(X.sectors(spark, d), "symbol"), s)
    x = x.withColumn("loss_pct", F.round("loss_pct", 6))
    return x.select("portfolio", "scenario", "loss_pct", "worst_holding", T.stress_level(F.col("loss_pct")).alias("level"))


@query(f"""with {P}, b as (select d, round(avg(ret), 9) as b from returns group by 1), be as (select symbol, covar_samp(ret, b) / var_samp(b) as beta from returns join b using (d) group by 1), {_SC},
 x as (select portfolio, scenario, sum(weight * beta * market_shock) as loss from weights join be using (symbol) cross join sc where sector is null group by 1, 2)
select portfolio, arg_min(scenario, (loss, scenario)) as worst, round(min(loss), 5) as loss_pct, count(*) as scenarios from x group by 1""")
def f16_stress_by_beta(spark, d):
    ret = X.returns(spark, d)
    b = ret.groupBy("d").agg(F.round(F.avg("ret"), 9).alias("b"))
    beta = ret.join(b, "d").groupBy("symbol").agg((F.covar_samp("ret", "b") / F.var_samp("b")).alias("beta"))
    s = spark.createDataFrame([x[:2] for x in SCENARIOS if x[2] is None], "scenario string, shock double")
    x = X.weights(spark, d).join(beta, "symbol").crossJoin(F.broadcast(s)).groupBy("portfolio", "scenario").agg(F.sum(F.col("weight") * F.col("beta") * F.col("shock")).alias("loss"))
    return x.groupBy("portfolio").agg(F.min_by("scenario", F.struct("loss", "scenario")).alias("worst"), F.round(F.min("loss"), 5).alias("loss_pct"), F.count("*").alias("scenarios"))


@query(f"""with {X.BARS}, rr as (select symbol, d, round("close" / lag("close") over (partition by symbol order by d) - 1, 9) as ret from bars),
 z as (select symbol, d, ret, (ret - avg(ret) over w) / nullif(stddev_pop(ret) over w, 0) as z from rr where ret is not null window w as (partition by symbol))
select symbol, d, round(z, 4) as z from z where abs(z) > 3""")
def f18_anomaly_z(spark, d):
    """Days on which a segment's return is over three deviations from its mean."""
    w = Window.partitionBy("symbol").orderBy("d")
    x = X.bars(spark, d).select("symbol", "d", F.round(F.col("close") / F.lag("close").over(w) - 1, 9).alias("ret")).where("ret is not null")
    return N.z_outliers(x, "ret").select("symbol", "d", F.round("z", 4).alias("z"))


@query("""with q as (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events group by 1)
select event_type, event_id, value from events join q using (event_type) where value < a - 0.5 * (b - a) or value > b + 0.5 * (b - a)""")
def f19_anomaly_iqr(spark, d):
    return N.iqr_outliers(X.table(spark, d, "events"), "event_type", "value", 0.5).select("event_type", "event_id", "value")


@query()
def f20_isolation_forest(spark, d):
    """Isolation-forest scores of a symbol's price features, the top share flagged. Rows only: trees are seeded draws."""
    from ledgerlark.operators.indicators import price_features

    return N.isolation_forest(price_features(X.bars(spark, d)), ["ret_1", "ret_5", "vol_5", "range_z", "gap"])


def _bar_features(spark, d):
    return X.bars(spark, d).select("symbol", "d", "open", "high", "low", "close", "volume")


_BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
_Z_FLAG = " or ".join(f"""coalesce(abs(({c} - avg({c}) over w) / nullif(stddev_pop({c}) over w, 0)) > 3, false)""" for c in ("x.open", "x.high", "x.low", 'x."close"', "x.volume"))
_IQR_FLAG = " or ".join(f"{c} < quantile_cont({c}, 0.25) over w - 1.5 * (quantile_cont({c}, 0.75) over w - quantile_cont({c}, 0.25) over w) or {c} > quantile_cont({c}, 0.75) over w + 1.5 * (quantile_cont({c}, 0.75) over w - quantile_cont({c}, 0.25) over w)" for c in ("x.open", "x.high", "x.low", 'x."close"', "x.volume"))


@query(f"with {X.BARS} select symbol, d, {_Z_FLAG} as by_z, {_IQR_FLAG} as by_iqr from bars x window w as (partition by symbol)")
def f20_statistical_flags(spark, d):
    """The members of the ensemble that are not forests: days of a segment on which any column of its bar is far from its mean, or beyond its quartiles."""
    return N.statistical_flags(_bar_features(spark, d), _BAR_COLUMNS)


@query()
def f20_bar_ensemble(spark, d):
    """Forest, z-scores and quartile fences over the columns of segments' bars."""
    return N.ensemble(_bar_features(spark, d), _BAR_COLUMNS)


@query()
def f20_price_ensemble(spark, d):
    """The same over price features."""
    from ledgerlark.operators.indicators import price_features

    x = price_features(X.bars(spark, d))
    return N.ensemble(x, [c for c in x.columns if c not in ("symbol", "d")])


@query()
def f20_volume_ensemble(spark, d):
    """The same over volume features."""
    from ledgerlark.operators.indicators import volume_features

    x = volume_features(X.bars(spark, d))
    return N.ensemble(x, [c for c in x.columns if c not in ("symbol", "d")])


@query()
def f20_calibrated(spark, d):
    """The threshold that lets through 2 % of a segment's bars, from their own scores."""
    return N.threshold(N.isolation_scores(_bar_features(spark, d), _BAR_COLUMNS), 0.02)


@query(f"""with {X.RETURNS}, g as (select *, substring(symbol, 1, 7) as portfolio from returns), c as (select portfolio, count(distinct symbol) as m from g group by 1),
 days as (select portfolio, d from g group by 1, 2 having count(*) = (select m from c where c.portfolio = g.portfolio)), x as (select * from g semi join days using (portfolio, d))
select a.portfolio, a.symbol as a, b.symbol as b, count(*) as n, round(covar_samp(a.ret, b.ret) * 1e6, 5) + 0 as covariance_e6 from x a join x b on a.portfolio = b.portfolio and a.d = b.d and a.symbol <= b.symbol group by 1, 2, 3 having count(*) >= 2""")
def f15_covariances(spark, d):
    """The matrices that weights and the spectrum are made from: covariances over the days that all symbols of a group have."""
    from ledgerlark.operators.models import moments

    size = F.size("symbols")
    x = moments(_grouped(spark, d)).where("n >= 2").select("portfolio", "symbols", "n", size.alias("m"), F.posexplode("covariance").alias("p", "c"))
    i, j = F.floor(F.col("p") / F.col("m")).cast("int"), F.col("p") % F.col("m")
    return x.where(i <= j).select("portfolio", F.col("symbols")[i].alias("a"), F.col("symbols")[j].alias("b"), "n", (F.round(F.col("c") * 1e6, 5) + 0.0).alias("covariance_e6"))


@query()
def f15_spectrum(spark, d):
    """Eigenvalues and condition number of each group's correlation matrix."""
    from ledgerlark.operators.models import correlation_spectrum

    return correlation_spectrum(_grouped(spark, d))


@query()
def f21_sector_limits(spark, d):
    """Least variance and greatest Sharpe ratio of each group of brands, no symbol over 0.4 and no sector over 0.6."""
    from ledgerlark.operators.models import sector_limited_weights

    sectors = X.sectors(spark, d)
    names = [r.p_type for r in X.table(spark, d, "part").select("p_type").distinct().collect()]  # a handful of kinds of part
    return sector_limited_weights(_grouped(spark, d), sectors, dict.fromkeys(names, 0.6))


@query()
def f06_garch(spark, d):
    """GARCH(1,1) a portfolio by likelihood, with a 5-day forecast."""
    from ledgerlark.operators.models import garch

    return garch(X.portfolio_returns(spark, d))


@query()
def f14_monte_carlo(spark, d):
    """Seeded simulation of a year by portfolio from its own mean and deviation."""
    from ledgerlark.operators.models import monte_carlo

    m = X.portfolio_returns(spark, d).groupBy("portfolio").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sigma"))
    return monte_carlo(m)


@query()
def f21_optimal_weights(spark, d):
    """Minimum-variance, maximum-Sharpe, risk-parity and hierarchical weights of each group of brands."""
    from ledgerlark.operators.models import optimal_weights

    groups = X.returns(spark, d).withColumn("d", F.trunc("d", "MM")).groupBy("symbol", "d").agg(F.avg("ret").alias("ret")).withColumn("portfolio", F.substring("symbol", 1, 7))
    return optimal_weights(groups)


def _grouped(spark, d):
    """Daily returns of each group of brands."""
    return X.returns(spark, d).withColumn("portfolio", F.substring("symbol", 1, 7))


for _name, _method in (("f23_risk_parity", "risk_parity"), ("f25_hierarchical_parity", "hierarchical"), ("f26_equal_weight", "equal"), ("f21_daily_optimal_weights", None)):

    @query(name=_name)
    def _weights(spark, d, method=_method):
        from ledgerlark.operators.models import optimal_weights

        x = optimal_weights(_grouped(spark, d))
        return x if method is None else x.where(F.col("method") == method).select("portfolio", "symbol", "weight")


@query()
def f22_frontier(spark, d):
    from ledgerlark.operators.models import by_group, frontier

    return by_group(_grouped(spark, d), lambda names, mu, cov: [(k, *p) for k, p in enumerate(frontier(mu, cov))], "point int, ret double, volatility double")


@query()
def f24_black_litterman(spark, d):
    """One view a group: its first symbol returns 10 % a year, with confidence 0.5."""
    from ledgerlark.operators.models import black_litterman, by_group

    return by_group(_grouped(spark, d), lambda names, mu, cov: list(zip(names, map(float, mu), map(float, black_litterman(mu, cov, {0: (0.10, 0.5)})))), "symbol string, prior double, posterior double")


@query(_EQ + f""", g as (select portfolio, avg(ret) * 252 as ar, stddev_samp(ret) * sqrt(252) as vol, stddev_samp(ret) filter (ret < 0) * sqrt(252) as down, min(dd) as mdd from q group by 1), c as (select portfolio, sum(weight * weight) as hhi, count(*) filter (weight > 0.001) as held from weights group by 1)
select portfolio, round(ar, 6) as annual_return, round(vol, 6) as volatility, round((ar - 0.07) / vol, 5) as sharpe, round((ar - 0.07) / down, 5) as sortino, round(ar / abs(mdd), 5) as calmar, round(mdd, 6) as max_drawdown, round(hhi, 6) as hhi, held from g join c using (portfolio)""")
def f27_weight_metrics(spark, d):
    from ledgerlark.operators.models import weight_metrics

    x = weight_metrics(X.returns(spark, d), X.weights(spark, d))
    return r(x.select("portfolio", "annual_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "hhi", "held"), "portfolio", "held", sharpe=5, sortino=5, calmar=5)
