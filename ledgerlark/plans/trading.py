"""Queries: rebalancing and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import planning as P
from ledgerlark.operators import trading as T
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.planning import _DRIFT, drift_input
from ledgerlark.plans.registry import query
from ledgerlark.plans.risk import r

AS_OF = "1998-06-01"


@query(f"""with {_DRIFT}, sc as (select *, abs(drift) as size, case when drift > 0 then 'BUY' else 'SELL' end as side, round(abs(drift) / (case when action = 'SELL' then 0.125::double else 0 end + 0.01::double), 9) as score from dr where action <> 'HOLD'),
 u as (select *, round(0.02::double - round(coalesce(sum(size) over (partition by portfolio order by score desc, side desc, symbol desc rows between unbounded preceding and 1 preceding), 0), 9), 9) as "left" from sc)
select portfolio, symbol, side, round(score, 6) as score, round(least(size, "left"), 6) as value, round(case when side = 'SELL' then least(size, "left") * 0.125::double else 0 end, 6) as tax from u where "left" > 0""")
def f30_least_turnover(spark, d):
    """A turnover of 2 %, so that the limit cuts; holdings of 400 days."""
    x = T.least_turnover(P.drift_report(drift_input(spark, d), "portfolio", 0.005), "portfolio", F.lit(400), 0.02)
    return r(x.select("portfolio", "symbol", "side", "score", "value", "tax"), "portfolio", "symbol", "side")


_EQUAL = f"""{X.HOLDINGS}, q as (select *, sum(current_value) over (partition by user_id) as total, 1.0::double / count(*) over (partition by user_id) as tw from holdings), cw as (select *, case when total > 0 then current_value / total else 0 end as cw from q),
 et as (select *, round(abs(cw - tw), 9) as drift, case when (tw - cw) * total > 0 then 'buy' else 'sell' end as action, round(abs((tw - cw) * total) + 1e-6, 2) as trade_value from cw where round(abs(cw - tw), 9) > 0.05::double)"""


def _equal(spark, d):
    return T.equal_targets(X.holdings(spark, d), "user_id")


@query(f"with {_EQUAL} select user_id, symbol, action, round(cw + 1e-9, 4) as current_weight, round(tw + 1e-9, 4) as target_weight, round(drift * 100 + 1e-8, 2) as drift_pct, trade_value from et")
def f33_equal_rebalance(spark, d):
    shown = {"current_weight": (F.col("current_weight") + 1e-9, 4), "target_weight": (F.col("target_weight") + 1e-9, 4), "drift_pct": (F.col("drift") * 100 + 1e-8, 2)}
    return _equal(spark, d).select("user_id", "symbol", "action", *(F.round(c, n).alias(k) for k, (c, n) in shown.items()), "trade_value")


@query(f"with {_EQUAL} select user_id, count(*) as trades, round(sum(trade_value) * 0.001::double + 1e-7, 2) as total_cost, round(sum(trade_value) * 0.00025::double + 1e-7, 2) as estimated_tax from et group by 1")
def f33_rebalance_costs(spark, d):
    """Fees of 0.1 % of the traded value, and a quarter of them as tax."""
    v = F.sum("trade_value")
    return _equal(spark, d).groupBy("user_id").agg(F.count("*").alias("trades"), F.round(v * 0.001 + 1e-7, 2).alias("total_cost"), F.round(v * 0.00025 + 1e-7, 2).alias("estimated_tax"))


@query(f"""with {_EQUAL}, s as (select user_id, date_diff('day', buy_date, date '{AS_OF}') < 365 as short, greatest((current_value / quantity - avg_cost) * trade_value / (current_value / quantity), 0) as gain from et where action = 'sell'),
 t as (select user_id, sum(case when short then gain * 0.2::double else 0 end) as a, sum(case when short then 0 else greatest(gain - 125000, 0) * 0.125::double end) as b from s group by 1)
select user_id, round(a, 4) as short_tax, round(b, 4) as long_tax, round(a + b, 4) as tax from t""")
def f37_sale_taxes(spark, d):
    sales = _equal(spark, d).where("action = 'sell'").withColumn("price", F.col("current_value") / F.col("quantity"))
    return r(T.sale_taxes(sales, "user_id", AS_OF), "user_id", n=4)


@query("with " + X.BARS + """, n as (select c_mktsegment as symbol, count(*) as weight from customer group by 1), p as (select symbol, row_number() over (partition by symbol order by d) - 1 as i, "close" as px from bars), nw as (select symbol, weight::double / sum(weight) over () as w from n), z as (select min(last) as last from (select symbol, max(i) as last from p group by 1)),
 f(freq, s) as (values ('daily', 1), ('weekly', 5), ('monthly', 22), ('quarterly', 66), ('never', null)), y as (select p.symbol, i, px, nw.w, freq, coalesce(s, last + 1) as step, greatest(i - 1, 0) // coalesce(s, last + 1) * coalesce(s, last + 1) as base from p join nw using (symbol), z, f where i <= last),
 g as (select y.freq, y.step, y.i, sum(y.w * y.px / b.px) as g, sum(y.w * y.px / o.px) as hold from y join p b on b.symbol = y.symbol and b.i = y.base join p o on o.symbol = y.symbol and o.i = 0 group by 1, 2, 3),
 v as (select freq, step, i, 1e6 * g * coalesce(exp(sum(case when i % step = 0 then ln(g) else 0 end) over (partition by freq order by i rows between unbounded preceding and 1 preceding)), 1) as value, 1e6 * hold as held from g),
 m as (select *, value / lag(value) over w - 1 as ret, value / max(value) over w - 1 as dd from v window w as (partition by freq order by i)),
 a as (select freq, arg_max(value, i) as final, arg_max(held, i) as held, count(*) as days, max(step) as step, stddev_samp(ret) * sqrt(252) as vol, avg(ret) * 252 as annual, min(dd) as dd from m group by 1)
select freq, round(final, 2) as final_value, round((final / 1e6 - 1) * 100, 2) as total_return_pct, round((pow(final / 1e6, 252 / days) - 1) * 100, 2) as cagr_pct, round(annual * 100, 2) as annualized_return_pct, round(vol * 100, 2) as annualized_volatility_pct, round(dd * 100, 2) as max_drawdown_pct,
 round((held / 1e6 - 1) * 100, 2) as buy_and_hold_return_pct, round((final - held) / 1e6 * 100, 2) as alpha_vs_buy_hold_pct, round(case when vol > 0 then (annual - 0.07) / vol else 0 end, 4) as sharpe_ratio, days as trading_days, (days // step)::bigint as num_rebalancings from a""")
def w36_periodic_rebalance(spark, d):
    """Closes of the market segments, weighted by their customers."""
    w = X.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("symbol")).agg(F.count("*").alias("weight"))
    return T.rebalancing_summary(T.rebalanced_values(X.bars(spark, d).select("symbol", "d", F.col("close").alias("px")), w))


@query(f"""with {X.RETURNS}, g as (select symbol, round(avg(abs(ret)), 9) as mean_abs, avg(ret) as mean, stddev_pop(ret) as std, max(ret) as "max", min(ret) as "min" from returns group by 1),
 k as (select *, row_number() over (order by mean_abs desc, symbol) as rank, sum(mean_abs) over (order by mean_abs desc, symbol) as so_far, sum(mean_abs) over () as total from g)
select symbol, round(mean_abs, 6) as mean_abs, round(mean, 6) as mean, round(std, 6) as std, round("max", 6) as "max", round("min", 6) as "min", rank::int as rank, round(total, 6) as total, round(mean_abs / total * 100, 6) as share, count(*) filter (so_far < 0.9::double * total) over () + 1 as n_for_90 from k""")
def a22_importance(spark, d):
    return r(T.importance(X.returns(spark, d), "symbol", "ret"), "symbol", "rank", "n_for_90")
