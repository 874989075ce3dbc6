"""Queries: rolling refits of volatility models and tests of residuals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators import volatility as O
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query


def _bar_returns(spark, d):
    """symbol, d, ret: daily returns of the market segments' closes."""
    w = Window.partitionBy("symbol").orderBy("d")
    return X.bars(spark, d).select("symbol", "d", F.round(F.col("close") / F.lag("close").over(w) - 1, 9).alias("ret")).where("ret is not null")


@query()
def w29_rolling_garch(spark, d):
    """GARCH(1,1) refitted every 21 days over the last 252, for each portfolio."""
    return O.rolling_garch(X.portfolio_returns(spark, d), key="portfolio")


@query()
def f06_volatility_models(spark, d):
    """GARCH, GJR-GARCH and EGARCH of each segment's returns, the best by AIC, forecasts and conditional value at risk."""
    return O.volatility_models(_bar_returns(spark, d), key="symbol")


@query()
def f07_garch_diagnostics(spark, d):
    """Tests of each portfolio's returns, standardised by its fitted GARCH(1,1)."""
    return O.diagnostics(O.standardised(X.portfolio_returns(spark, d)))


def _ljung_box(x: str) -> str:
    return f"""{x}c as (select a.symbol, j, sum(({x} - m) * (l - m)) as c from (select symbol, {x}, i, avg({x}) over (partition by symbol) as m from z) a
 join (select symbol, {x} as l, i + j as i, j from z, range(1, 21) t(j)) b using (symbol, i) group by 1, 2),
 {x}s as (select symbol, n * (n + 2) * sum((c / v) * (c / v) / (n - j)) as s from {x}c join (select symbol, count(*) as n, var_pop({x}) * count(*) as v from z group by 1) using (symbol) group by symbol, n)"""


@query(f"""with {X.BARS}, r as (select symbol, d, round("close" / lag("close") over (partition by symbol order by d) - 1, 9) as ret from bars),
 z as (select symbol, z, z * z as q, row_number() over (partition by symbol order by d) as i from (select symbol, d, (ret - avg(ret) over w) / stddev_samp(ret) over w as z from r where ret is not null window w as (partition by symbol))),
 {_ljung_box("z")}, {_ljung_box("q")},
 p as (select symbol, zs.s as a, qs.s as b from zs join qs using (symbol))
select symbol, round(a, 5) as lb_stat, round(exp(-a / 2) * list_sum(list_transform(range(0, 10), lambda j: (a / 2) ** j / factorial(cast(j as integer)))), 8) as lb_pvalue,
 round(b, 5) as lb_sq_stat, round(exp(-b / 2) * list_sum(list_transform(range(0, 10), lambda j: (b / 2) ** j / factorial(cast(j as integer)))), 8) as lb_sq_pvalue,
 (select round(skewness(z), 6) from z where z.symbol = p.symbol) as skewness, (select round(kurtosis(z), 6) from z where z.symbol = p.symbol) as kurtosis from p""")
def f07_residual_tests(spark, d):
    """The same tests of segments' returns over their plain deviation: Ljung-Box at 20 lags, of squares too, and the moments."""
    w = Window.partitionBy("symbol")
    z = _bar_returns(spark, d).select("symbol", "d", ((F.col("ret") - F.avg("ret").over(w)) / F.stddev_samp("ret").over(w)).alias("z"))
    x = O.diagnostics(z, key="symbol")
    places = {"lb_stat": 5, "lb_pvalue": 8, "lb_sq_stat": 5, "lb_sq_pvalue": 8, "skewness": 6, "kurtosis": 6}
    return x.select("symbol", *(F.round(c, n).alias(c) for c, n in places.items()))
