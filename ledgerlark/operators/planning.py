"""Taxes, budgets, goals, cover and rebalancing as column arithmetic; each takes and returns columns or a frame, without a shuffle unless it says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Widths and rates of the tax bands, the last open; lower bounds as the second schedule names them.
BANDS_NEW = [(400_000, 0.0), (80_000, 0.05), (80_000, 0.10), (80_000, 0.15), (80_000, 0.20), (80_000, 0.25), (None, 0.30)]
BANDS_OLD = [(250_000, 0.0), (250_000, 0.05), (500_000, 0.10), (1_000_000, 0.20), (None, 0.30)]
SLABS_NEW = [(300_001, 0.0), (400_000, 0.05), (300_000, 0.10), (200_000, 0.15), (300_000, 0.20), (None, 0.30)]
SLAB_STARTS = [(1_500_001, 0.30), (1_200_001, 0.20), (1_000_001, 0.15), (700_001, 0.10), (300_001, 0.05), (0, 0.0)]
SURCHARGES = [(50_000_000, 0.37), (20_000_000, 0.25), (10_000_000, 0.15), (5_000_000, 0.10)]
ADVANCE_TAX = [("Jun 15", 0.15), ("Sep 15", 0.45), ("Dec 15", 0.75), ("Mar 15", 1.00)]
TERM_PREMIUMS = {25: 8000, 30: 10000, 35: 13000, 40: 18000, 45: 25000, 50: 35000}
EXEMPT_GAIN, LONG_RATE, SHORT_RATE, CESS = 125_000.0, 0.125, 0.20, 0.04


def banded(x: Column, bands: Sequence[tuple[int | None, float]]) -> Column:
    """Sum over the bands of what of ``x`` lies in each, times its rate."""
    total, low = F.lit(0.0), 0.0
    for width, rate in bands:
        inside = (x if width is None else F.least(x, F.lit(low + width))) - low
        total, low = total + F.greatest(F.lit(0.0), inside) * rate, low + (width or 0)
    return total


def stepped(x: Column, steps: Sequence[tuple[float, float]], strict: bool = False) -> Column:
    """The value of the first step, from the top, that ``x`` has reached (or is over); 0 below all."""
    out = F.when(F.lit(False), 0.0)
    for bound, value in steps:
        out = out.when(x > bound if strict else x >= bound, value)
    return out.otherwise(0.0)


def regime_taxes(df: DataFrame, income: str, deductions: Column) -> DataFrame:
    """Tax under the old and the new regime: bands, rebate, 4 % cess, surcharge by income; and the cheaper one."""
    x = F.col(income)
    surcharge = F.when(x > 10_000_000, 1.15).when(x > 5_000_000, 1.10).otherwise(1.0)

    def tax(taxable: Column, bands, limit: float, rebate: float) -> Column:
        base = banded(taxable, bands)
        base = F.when(taxable <= limit, F.greatest(base - rebate, F.lit(0.0))).otherwise(base)
        return F.round(base * 1.04 * surcharge + 1e-6, 2)  # half a cent goes up, whatever the last binary digit

    out = df.withColumn("taxable_old", F.greatest(x - 50_000 - deductions, F.lit(0.0))).withColumn("taxable_new", F.greatest(x - 75_000, F.lit(0.0)))
    out = out.withColumn("tax_old", tax(F.col("taxable_old"), BANDS_OLD, 500_000, 12_500)).withColumn("tax_new", tax(F.col("taxable_new"), BANDS_NEW, 1_200_000, 60_000))
    out = out.withColumn("regime", F.when(F.col("tax_new") <= F.col("tax_old"), "new").otherwise("old"))
    return out.withColumn("saving", F.round(F.abs(F.col("tax_old") - F.col("tax_new")), 2))


def income_tax(x: Column) -> Column:
    """Tax by the slabs of the new regime, none up to 700,000."""
    return F.when(x <= 700_000, 0.0).otherwise(banded(F.greatest(x, F.lit(0.0)), SLABS_NEW))


def marginal_rate(x: Column) -> Column:
    return F.when(x <= 700_000, 0.0).otherwise(stepped(x, SLAB_STARTS))


def surcharge_rate(x: Column) -> Column:
    return stepped(x, SURCHARGES, strict=True)


def advance_tax(df: DataFrame, tax: Column, *keep: str) -> DataFrame:
    """One row for each date: the share due by then, the amount, and the instalment over the date before."""
    dates = F.array(*(F.struct(F.lit(d).alias("due_date"), F.lit(p).alias("share"), F.lit(p - q).alias("step")) for (d, p), q in zip(ADVANCE_TAX, [0.0, *(p for _, p in ADVANCE_TAX)])))
    x = df.select(*keep, tax.alias("tax"), F.explode(dates).alias("at"))
    return x.select(*keep, "at.due_date", (F.col("tax") * F.col("at.share")).alias("cumulative"), (F.col("tax") * F.col("at.step")).alias("instalment"))


def capital_gains(lots: DataFrame, key: str, income: str, order: str) -> DataFrame:
    """Each sold lot's gain, kind, rate and tax. ``lots``: gain, days held, asset (equity or debt).

    Equity is long-term after 365 days, other assets after 1095. Short-term gains on other assets are taxed at the marginal rate
    of the income and the short-term gains before them, in ``order``.
    """
    long = F.when(F.col("asset") == "equity", F.col("days") > 365).otherwise(F.col("days") > 1095)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = lots.withColumn("kind", F.when(long, "LTCG").otherwise("STCG"))
    x = x.withColumn("short_before", F.coalesce(F.sum(F.when(F.col("kind") == "STCG", F.col("gain")).otherwise(0.0)).over(before), F.lit(0.0)))
    equity, is_long, gain = F.col("asset") == "equity", F.col("kind") == "LTCG", F.col("gain")
    rate = F.when(is_long, LONG_RATE).when(equity, SHORT_RATE).otherwise(marginal_rate(F.round(F.col(income) + F.col("short_before"), 2)))
    taxed = F.when(is_long & equity, F.greatest(F.lit(0.0), gain - EXEMPT_GAIN)).when(equity, gain).otherwise(F.greatest(F.lit(0.0), gain))
    return x.withColumn("rate", rate).withColumn("tax", taxed * F.col("rate")).drop("short_before")


def gains_tax(lots: DataFrame, key: str, income: str) -> DataFrame:
    """A person's tax on gains: long-term over the exemption, short-term, surcharge and cess. One shuffle by ``key``."""
    x = lots.groupBy(key).agg(F.max(income).alias("income"), *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("gain"))), F.lit(0.0)).alias(n) for k, n in (("LTCG", "long_total"), ("STCG", "short_total"))))
    taxable = F.greatest(F.lit(0.0), F.col("long_total") - EXEMPT_GAIN)
    x = x.withColumn("long_tax", taxable * LONG_RATE).withColumn("short_tax", F.col("short_total") * SHORT_RATE)
    x = x.withColumn("surcharge", (F.col("long_tax") + F.col("short_tax")) * surcharge_rate(F.round(F.col("income") + F.greatest(F.lit(0.0), F.col("short_total")) + taxable, 2)))
    x = x.withColumn("cess", (F.col("long_tax") + F.col("short_tax") + F.col("surcharge")) * CESS)
    return x.withColumn("total_tax", F.col("long_tax") + F.col("short_tax") + F.col("surcharge") + F.col("cess"))


def goal(df: DataFrame, target: Column, savings: Column, monthly: Column, years: Column, percent: float, inflation: float = 6.0) -> DataFrame:
    """Future value of savings and of monthly payments against a target: corpus, gap, further payment needed, progress."""
    rate, n = percent / 1200, years * 12
    grown = F.pow(F.lit(1 + rate), n)
    annuity = (grown - 1) / rate if rate > 0 else n
    x = df.withColumn("target", target).withColumn("fv_savings", savings * grown).withColumn("fv_payments", monthly * annuity)
    x = x.withColumn("corpus", F.col("fv_savings") + F.col("fv_payments")).withColumn("gap", F.col("target") - F.col("corpus"))
    x = x.withColumn("needed", F.when(F.col("gap") > 0, F.col("gap") / annuity if rate > 0 else F.lit(0.0)).otherwise(0.0))
    x = x.withColumn("progress", F.least(F.col("corpus") / F.col("target") * 100, F.lit(100.0))).withColumn("on_track", F.col("gap") <= 0)
    x = x.withColumn("allocation", F.when(years > 7, "Aggressive").when(years > 3, "Moderate").otherwise("Conservative"))
    return x.withColumn("target_today", F.col("target") / F.pow(F.lit(1 + inflation / 100), years))


def cover(df: DataFrame, age: Column, income: Column, dependents: Column, life: Column, health: Column, tier: Column) -> DataFrame:
    """Life and health cover recommended, the gaps, and premiums estimated by age bracket."""
    premium = F.element_at(F.create_map(*(F.lit(v) for kv in TERM_PREMIUMS.items() for v in kv)), F.least(F.greatest(F.floor(age / 5) * 5, F.lit(25)), F.lit(50)).cast("int"))
    x = df.withColumn("life_cover", income * F.when(dependents > 0, 15).otherwise(10)).withColumn("life_gap", F.greatest(F.col("life_cover") - life, F.lit(0.0)))
    x = x.withColumn("health_cover", (dependents * 300_000 + 1_000_000) * F.when(tier == 1, 1.5).when(tier == 2, 1.2).otherwise(1.0))
    x = x.withColumn("health_gap", F.greatest(F.col("health_cover") - health, F.lit(0.0))).withColumn("term", F.greatest(60 - age, F.lit(10)))
    x = x.withColumn("life_premium", F.col("life_gap") / 10_000_000 * premium).withColumn("health_premium", F.col("health_gap") * 0.018)
    return x.withColumn("premium", F.col("life_premium") + F.col("health_premium")).withColumn("emergency_fund", income * 0.25)


def drift_report(weights: DataFrame, key: str, threshold: float = 0.05) -> DataFrame:
    """Current (normalised) against target weight of each symbol: drift, relative drift in per cent, action."""
    total = F.sum("current").over(Window.partitionBy(key))
    x = weights.withColumn("current", F.round(F.when(total > 0, F.col("current") / total).otherwise(0.0), 9))
    x = x.withColumn("drift", F.round(F.col("target") - F.col("current"), 9))
    x = x.withColumn("relative", F.when(F.col("target") > 0, (F.col("current") - F.col("target")) / F.col("target") * 100).otherwise(F.col("current") * 100))
    action = F.when(F.col("drift") > threshold * F.col("target"), F.when(F.col("drift") > 0, "BUY").otherwise("SELL"))
    return x.withColumn("action", action.when(F.col("drift") < -threshold * F.greatest("target", F.lit(0.01)), "SELL").otherwise("HOLD"))


def rebalance_trades(report: DataFrame, value: Column, price: str, days: str) -> DataFrame:
    """A trade for each symbol that does not hold: value, quantity, priority, tax of a sale, days until it is long-term."""
    x = report.where("action != 'HOLD'").withColumn("value", F.round(F.abs("drift") * value, 2)).withColumn("side", F.when(F.col("drift") > 0, "BUY").otherwise("SELL"))
    sale, held = F.col("side") == "SELL", F.coalesce(F.col(days), F.lit(0))
    left = F.greatest(F.lit(0), 365 - held)
    priority = F.when(sale & (held <= 365) & (left <= 30), "OPTIONAL").when(F.abs(F.round("relative", 2)) > 15, "REQUIRED").otherwise("RECOMMENDED")
    tax = F.when(~sale, 0.0).when(held <= 365, F.col("value") * SHORT_RATE).otherwise(F.greatest(F.lit(0.0), F.col("value") - EXEMPT_GAIN) * LONG_RATE)
    x = x.withColumn("quantity", F.when(F.col(price) > 0, F.col("value") / F.col(price)).otherwise(0.0)).withColumn("priority", priority).withColumn("tax", tax)
    return x.withColumn("days_to_long", F.when(sale, left).otherwise(-1))


def within_budget(trades: DataFrame, key: str, budget: Column, order: Sequence[Column]) -> DataFrame:
    """Trades in order until their values reach the budget; the one that crosses it is cut, and none follow. One window a portfolio."""
    w = Window.partitionBy(key).orderBy(*order)
    used = F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = trades.withColumn("used", used).withColumn("budget", budget).where(F.col("used") < F.col("budget"))
    x = x.withColumn("filled", F.least(F.col("value"), F.col("budget") - F.col("used"))).withColumn("part", F.col("filled") / F.col("value"))
    return x.withColumn("tax", F.col("tax") * F.col("part")).withColumn("quantity", F.col("quantity") * F.col("part"))


def constraint_violations(weights: DataFrame, key: str, stock: float = 0.10, ten: float = 0.55, sector: float = 0.25) -> DataFrame:
    """Rows (rule, what, share) for each broken limit: a stock, the ten largest, a sector, fewer than ten holdings over 0.5 %. One pass over the rows of a key."""
    whole, part = Window.partitionBy(key), Window.partitionBy(key, "sector")
    x = weights.withColumn("share", F.round(F.try_divide("weight", F.sum("weight").over(whole)), 9)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("share"), "symbol")))
    x = x.withColumns({"top": F.sum(F.when(F.col("place") <= 10, F.col("share"))).over(whole), "many": F.count_if(F.col("share") > 0.005).over(whole)})
    x = x.withColumns({"nth": F.row_number().over(part.orderBy("place")), "together": F.sum("share").over(part)})
    broken = lambda when, rule, what, share: F.when(when, F.struct(F.lit(rule).alias("rule"), what.alias("what"), share.alias("share")))
    first, every = F.col("place") == 1, F.lit("all")
    rows = F.array(
        broken(F.col("share") > stock, "stock", F.col("symbol"), F.col("share")),
        broken(first & (F.col("top") > ten), "top ten", every, F.col("top")),
        broken((F.col("nth") == 1) & (F.col("together") > sector), "sector", F.col("sector"), F.col("together")),
        broken(first & (F.col("many") < 10), "holdings", every, F.col("many").cast("double")),
    )
    return x.select(key, F.explode(F.array_compact(rows)).alias("x")).select(key, "x.*")
