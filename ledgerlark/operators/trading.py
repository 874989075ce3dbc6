"""Rebalancing to equal targets, least turnover, taxes of sales, periodic rebalancing, importance of features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rates on short and long holdings, the gain free of the latter, days that part them.
SHORT, LONG, FREE_GAIN, LONG_DAYS = 0.20, 0.125, 125_000.0, 365
#: Trading days between rebalancings; ``never`` is one segment.
INTERVALS = {"daily": 1, "weekly": 5, "monthly": 22, "quarterly": 66, "never": None}


def least_turnover(report: DataFrame, key: str, days: Column, budget: float) -> DataFrame:
    """Trades of a drift report by benefit per cost until the turnover is used up; the trade that crosses it is cut, and none follow.

    ``report`` holds ``symbol``, ``drift`` and ``action``. Cost is 1 % and, for sales, the tax rate of the days held. Ties go by side and symbol, last first.
    """
    rate = F.when(days <= LONG_DAYS, SHORT).otherwise(LONG)
    side = F.when(F.col("drift") > 0, "BUY").otherwise("SELL")
    x = report.where("action != 'HOLD'").withColumn("size", F.abs("drift")).withColumn("side", side)
    x = x.withColumn("score", F.round(F.col("size") / (F.when(F.col("action") == "SELL", rate).otherwise(0.0) + 0.01), 9))
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("side"), F.desc("symbol")).rowsBetween(Window.unboundedPreceding, -1)
    used = F.round(F.coalesce(F.sum("size").over(w), F.lit(0.0)), 9)
    x = x.withColumn("left", F.round(budget - used, 9)).where("left > 0")
    x = x.withColumn("value", F.least("size", "left"))
    return x.withColumn("tax", F.when(F.col("side") == "SELL", F.col("value") * rate).otherwise(0.0))


def equal_targets(holdings: DataFrame, key: str, threshold: float = 0.05) -> DataFrame:
    """Each holding of a portfolio against an equal share: weights, drift and the trade's value, for drifts over ``threshold``.

    ``holdings``: ``key``, ``symbol``, ``current_value``; a null value is none. A portfolio without value has weights of 0 and trades of 0.
    """
    w = Window.partitionBy(key)
    v = F.coalesce("current_value", F.lit(0.0))
    x = holdings.withColumn("total", F.sum(v).over(w)).withColumn("target_weight", 1.0 / F.count("*").over(w))
    x = x.withColumn("current_weight", F.when(F.col("total") > 0, v / F.col("total")).otherwise(0.0))
    x = x.withColumn("drift", F.round(F.abs(F.col("current_weight") - F.col("target_weight")), 9)).where(F.col("drift") > threshold)
    change = (F.col("target_weight") - F.col("current_weight")) * F.col("total")
    return x.withColumn("action", F.when(change > 0, "buy").otherwise("sell")).withColumn("trade_value", F.round(F.abs(change) + 1e-6, 2))


def sale_taxes(sales: DataFrame, key: str, as_of: str) -> DataFrame:
    """Tax of each portfolio's sales that gain, at the short rate under 365 days, else at the long rate on the gain over the free one.

    ``sales``: ``key``, ``trade_value``, ``price``, ``avg_cost``, ``buy_date``; without a date a holding is new, without a price there is nothing to sell.
    """
    gain = F.when(F.col("price") > 0, (F.col("price") - F.col("avg_cost")) * F.col("trade_value") / F.col("price")).otherwise(0.0)
    days = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.col("buy_date")), F.lit(0))
    x = sales.select(key, F.greatest(gain, F.lit(0.0)).alias("gain"), (days < LONG_DAYS).alias("short"))
    short = F.sum(F.when(F.col("short"), F.col("gain") * SHORT).otherwise(0.0))
    long = F.sum(F.when(~F.col("short"), F.greatest(F.col("gain") - FREE_GAIN, F.lit(0.0)) * LONG).otherwise(0.0))
    return x.groupBy(key).agg(short.alias("short_tax"), long.alias("long_tax"), (short + long).alias("tax"))


def rebalanced_values(prices: DataFrame, weights: DataFrame, initial: float = 1e6, intervals: Mapping[str, int | None] = INTERVALS) -> DataFrame:
    """``freq``, ``step``, ``i``, ``value`` and ``held`` (without rebalancing) of a portfolio that is set back to its weights every so many days.

    ``prices``: ``symbol``, ``d``, ``px``; the n-th prices of all symbols make day n, as many days as the shortest series has.
    ``weights``: ``symbol``, ``weight``, normalised here. Units change only at a segment's end, so a day's value is the weighted growth since
    its segment began times the growth of all segments before: a join and a running product, and no loop over days.
    """
    days = Window.partitionBy("symbol").orderBy("d")
    p = prices.select("symbol", (F.row_number().over(days) - 1).cast("bigint").alias("i"), "px", F.first("px").over(days).alias("px_first"))
    p = p.join(weights.select("symbol", (F.col("weight") / F.sum("weight").over(Window.partitionBy())).alias("w")), "symbol")  # a row a symbol
    shortest = p.groupBy("symbol").agg(F.max("i").alias("last")).agg(F.min("last").alias("last"))  # one row
    p = p.crossJoin(F.broadcast(shortest)).where(F.col("i") <= F.col("last"))
    steps = F.array(*(F.struct(F.lit(k).alias("freq"), (F.lit(v).cast("bigint") if v else F.col("last") + 1).alias("step")) for k, v in intervals.items()))
    p = p.select("*", F.inline(steps))
    p = p.withColumn("base", F.floor(F.greatest(F.col("i") - 1, F.lit(0)) / F.col("step")).cast("bigint") * F.col("step"))
    bases = p.where(F.col("i") % F.col("step") == 0).select("symbol", "freq", F.col("i").alias("base"), F.col("px").alias("px_base"))
    x = p.join(bases, ["symbol", "freq", "base"])
    x = x.groupBy("freq", "step", "i").agg(F.sum(F.col("w") * F.col("px") / F.col("px_base")).alias("g"), F.sum(F.col("w") * F.col("px") / F.col("px_first")).alias("hold"))
    before = Window.partitionBy("freq").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.product(F.when(F.col("i") % F.col("step") == 0, F.col("g")).otherwise(1.0)).over(before), F.lit(1.0))
    return x.select("freq", "step", "i", (initial * F.col("g") * carried).alias("value"), (initial * F.col("hold")).alias("held"))


def rebalancing_summary(values: DataFrame, risk_free: float = 0.07) -> DataFrame:
    """Final value, returns, volatility, Sharpe ratio, drawdown of each frequency, and how far it beats holding."""
    w = Window.partitionBy("freq").orderBy("i")
    x = values.withColumn("ret", F.col("value") / F.lag("value").over(w) - 1).withColumn("dd", F.col("value") / F.max("value").over(w) - 1)
    at = lambda c, f: f(F.struct("i", c))[c]
    g = x.groupBy("freq").agg(
        at("value", F.max).alias("final"), at("value", F.min).alias("initial"), at("held", F.max).alias("held"), F.count("*").alias("days"), F.max("step").alias("step"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), (F.avg("ret") * 252).alias("annual"), F.min("dd").alias("drawdown"),
    )
    total, hold = F.col("final") / F.col("initial") - 1, F.col("held") / F.col("initial") - 1
    percent = {
        "total_return_pct": total, "cagr_pct": F.pow(1 + total, 252 / F.col("days")) - 1, "annualized_return_pct": F.col("annual"), "annualized_volatility_pct": F.col("volatility"),
        "max_drawdown_pct": F.col("drawdown"), "buy_and_hold_return_pct": hold, "alpha_vs_buy_hold_pct": total - hold,
    }
    sharpe = F.when(F.col("volatility") > 0, (F.col("annual") - risk_free) / F.col("volatility")).otherwise(0.0)
    return g.select("freq", F.round("final", 2).alias("final_value"), *(F.round(c * 100, 2).alias(n) for n, c in percent.items()), F.round(sharpe, 4).alias("sharpe_ratio"), F.col("days").alias("trading_days"), F.floor(F.col("days") / F.col("step")).alias("num_rebalancings"))


def importance(attributions: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean size, mean, deviation, extremes, rank and share of each feature's attributions, and how many features make 90 % of the whole.

    Ties go by name. The ranking is one window over a row a feature.
    """
    x = attributions.groupBy(feature).agg(F.round(F.avg(F.abs(value)), 9).alias("mean_abs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min"))
    w, every = Window.orderBy(F.desc("mean_abs"), feature), Window.partitionBy()
    x = x.withColumn("rank", F.row_number().over(w)).withColumn("so_far", F.sum("mean_abs").over(w)).withColumn("total", F.sum("mean_abs").over(every))
    x = x.withColumn("share", F.when(F.col("total") > 0, F.col("mean_abs") / F.col("total") * 100).otherwise(0.0))
    return x.withColumn("n_for_90", F.count_if(F.col("so_far") < 0.9 * F.col("total")).over(every) + 1).drop("so_far")
