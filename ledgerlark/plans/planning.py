"""Queries: taxes, planning, rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import planning as T
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query
from ledgerlark.plans.risk import r

AS_OF = "2002-01-01"


def people(spark, d):
    """user_id, income, age, dependents, tier, savings: customers as persons."""
    c = X.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("user_id"), F.round(F.greatest(F.lit(0.0), 600_000 + F.col("c_acctbal") * 700), 2).alias("income"), (18 + k % 50).cast("int").alias("age"), (k % 4).cast("int").alias("dependents"), (1 + k % 3).cast("int").alias("tier"), F.round(F.greatest(F.lit(0.0), F.col("c_acctbal")) * 100, 2).alias("savings"))


PEOPLE = """people as (select c_custkey as user_id, round(greatest(0, 600000 + c_acctbal * 700), 2) as income, (18 + c_custkey % 50)::int as age, (c_custkey % 4)::int as dependents,
 (1 + c_custkey % 3)::int as tier, round(greatest(0, c_acctbal) * 100, 2) as savings from customer)"""


def _banded(x, bands):
    out, low = [], 0.0
    for width, rate in bands:
        out.append(f"greatest(0, {x if width is None else f'least({x}, {low + width})'} - {low}) * {rate}")
        low += width or 0
    return "(" + " + ".join(out) + ")"


def _case(x, steps, op=">="):
    return "case " + " ".join(f"when {x} {op} {b} then {v}" for b, v in steps) + " else 0.0 end"


@query(f"""with {PEOPLE}, t as (select *, greatest(income - 50000 - least(savings, 150000) - 25000, 0) as o, greatest(income - 75000, 0) as n,
 case when income > 10000000 then 1.15 when income > 5000000 then 1.10 else 1.0 end as s from people),
 x as (select *, round((case when o <= 500000 then greatest({_banded('o', T.BANDS_OLD)} - 12500, 0) else {_banded('o', T.BANDS_OLD)} end) * 1.04::double * s + 1e-6, 2) as tax_old,
 round((case when n <= 1200000 then greatest({_banded('n', T.BANDS_NEW)} - 60000, 0) else {_banded('n', T.BANDS_NEW)} end) * 1.04::double * s + 1e-6, 2) as tax_new from t)
select user_id, round(o, 2) as taxable_old, round(n, 2) as taxable_new, tax_old, tax_new, case when tax_new <= tax_old then 'new' else 'old' end as regime, round(abs(tax_old - tax_new), 2) as saving from x""")
def f38_regime_taxes(spark, d):
    x = T.regime_taxes(people(spark, d), "income", F.least(F.col("savings"), F.lit(150_000.0)) + 25_000)
    return r(x.select("user_id", "taxable_old", "taxable_new", "tax_old", "tax_new", "regime", "saving"), "user_id", "regime", "tax_old", "tax_new", n=2)


@query(f"""with {PEOPLE} select user_id, round(case when income <= 700000 then 0 else {_banded('income', T.SLABS_NEW)} end, 6) as tax, case when income <= 700000 then 0.0 else {_case('income', T.SLAB_STARTS)} end::double as marginal, ({_case('income', T.SURCHARGES, '>')})::double as surcharge from people""")
def f39_slab_tax(spark, d):
    x = F.col("income")
    return people(spark, d).select("user_id", F.round(T.income_tax(x), 6).alias("tax"), T.marginal_rate(x).alias("marginal"), T.surcharge_rate(x).alias("surcharge"))


_ADVANCE = f"""with {PEOPLE}, t as (select user_id, case when income + 50000 <= 700000 then 0 else {_banded('(income + 50000)', T.SLABS_NEW)} end as tax from people),
 s(due_date, share) as (values {', '.join(f"('{k}', {v}::double)" for k, v in T.ADVANCE_TAX)})"""


@query(_ADVANCE + " select user_id, due_date, round(tax * share, 6) as cumulative from t, s")
def f40_advance_tax(spark, d):
    return T.advance_tax(people(spark, d), T.income_tax(F.col("income") + 50_000), "user_id").select("user_id", "due_date", F.round("cumulative", 6).alias("cumulative"))


@query(_ADVANCE + " select user_id, due_date, round(tax * share - coalesce(lag(tax * share) over (partition by user_id order by share), 0), 6) as instalment from t, s")
def w38_instalments(spark, d):
    return T.advance_tax(people(spark, d), T.income_tax(F.col("income") + 50_000), "user_id").select("user_id", "due_date", F.round("instalment", 6).alias("instalment"))


@query(f"""with {PEOPLE}, v as (select o_custkey as user_id, round(cast(o_totalprice as decimal(18, 2)) * 0.05::decimal(3, 2), 2) as amount from orders),
 t as (select user_id, sum(amount) as total, sum(case when amount > 5000 then amount * 0.10::decimal(3, 2) else 0 end) as tds from v group by 1),
 m as (select user_id, cast(total as decimal(18, 4)) as total, cast(tds as decimal(18, 4)) as tds, cast(case when income + total <= 700000 then 0.0 else {_case('(income + total)', T.SLAB_STARTS)} end as decimal(4, 2)) as rate from t join people using (user_id))
select user_id, cast(total * 100 as bigint) as total_cents, cast(tds * 1000 as bigint) as tds_mills, cast(total * rate * 10000 as bigint) as tax_e4, cast(greatest(0, total * rate - tds) * 10000 as bigint) as payable_e4 from m""")
def f41_dividend_tax(spark, d):
    """Money in decimals: five percent of an order is a dividend, to cents; all products of it are exact."""
    part = lambda x: F.lit(x).cast("decimal(3,2)")
    v = X.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.round(F.col("o_totalprice").cast("decimal(18,2)") * part("0.05"), 2).alias("amount"))
    t = v.groupBy("user_id").agg(F.sum("amount").alias("total"), F.sum(F.when(F.col("amount") > 5000, F.col("amount") * part("0.10")).otherwise(F.lit(0).cast("decimal(18,4)"))).alias("tds")).join(people(spark, d), "user_id")
    total, tds = F.col("total").cast("decimal(18,4)"), F.col("tds").cast("decimal(18,4)")
    tax = total * T.marginal_rate(F.col("income") + F.col("total").cast("double")).cast("decimal(4,2)")
    payable = F.greatest(F.lit(0).cast("decimal(18,4)"), tax - tds)
    return t.select("user_id", *((x * k).cast("bigint").alias(n) for x, k, n in ((total, 100, "total_cents"), (tds, 1000, "tds_mills"), (tax, 10_000, "tax_e4"), (payable, 10_000, "payable_e4"))))


_GOAL = """y as (select *, {years} as years, {target} as target, {monthly} as monthly from people {where}), g as (select *, pow(1 + {p} / 1200.0, 12 * years) as grown, (pow(1 + {p} / 1200.0, 12 * years) - 1) / ({p} / 1200.0) as annuity from y),
 f as (select *, savings * grown as fv_savings, monthly * annuity as fv_payments, target - savings * grown - monthly * annuity as gap from g)
select user_id, round(fv_savings, 0) as fv_savings, round(fv_payments, 0) as fv_payments, round(gap, 0) as gap, round(case when gap > 0 then gap / annuity else 0 end, 1) as needed, round(least((target - gap) / target * 100, 100), 1) as progress,
 gap <= 0 as on_track, case when years > 7 then 'Aggressive' when years > 3 then 'Moderate' else 'Conservative' end as allocation, round(target / pow(1.06, years), 0) as target_today from f"""
_GOAL_COLUMNS = ("user_id", "fv_savings", "fv_payments", "gap", "needed", "progress", "on_track", "allocation", "target_today")


@query(f"with {PEOPLE}, " + _GOAL.format(years="1 + user_id % 20", target="income * 3 + 100000", monthly="income / 60", p=12, where=""))
def f42_goal_planner(spark, d):
    x = people(spark, d)
    x = T.goal(x, F.col("income") * 3 + 100_000, F.col("savings"), F.col("income") / 60, 1 + F.col("user_id") % 20, 12.0)
    return r(x.select(*_GOAL_COLUMNS), "user_id", "on_track", "allocation", n=0, needed=1, progress=1)


@query(f"with {PEOPLE}, " + _GOAL.format(years="60 - age", target="greatest(1, income / 24) * pow(1.06, 60 - age) * 12 / 0.04", monthly="income / 60", p=12, where="where age < 60"))
def f43_retirement(spark, d):
    x = people(spark, d).where("age < 60")
    years = 60 - F.col("age")
    need = F.greatest(F.lit(1.0), F.col("income") / 24) * F.pow(F.lit(1.06), years) * 12 / 0.04
    x = T.goal(x, need, F.col("savings"), F.col("income") / 60, years, 12.0)
    return r(x.select(*_GOAL_COLUMNS), "user_id", "on_track", "allocation", n=0, needed=1, progress=1)


@query(f"""with {PEOPLE}, c as (select *, income * case when dependents > 0 then 15 else 10 end as life_cover, (1000000 + dependents * 300000) * case tier when 1 then 1.5 when 2 then 1.2 else 1.0 end as health_cover from people),
 g as (select *, greatest(life_cover - savings, 0) as life_gap, greatest(health_cover - 200000, 0) as health_gap, case least(greatest(age // 5 * 5, 25), 50) {' '.join(f'when {k} then {v}' for k, v in T.TERM_PREMIUMS.items())} end as rate from c)
select user_id, round(life_gap, 6) as life_gap, round(health_gap, 6)::double as health_gap, greatest(60 - age, 10)::int as term, round(life_gap / 10000000 * rate + health_gap::double * 0.018, 6) as premium, round(income * 0.25, 6) as emergency_fund from g""")
def f44_cover(spark, d):
    x = T.cover(people(spark, d), F.col("age"), F.col("income"), F.col("dependents"), F.col("savings"), F.lit(200_000.0), F.col("tier"))
    return r(x.select("user_id", "life_gap", "health_gap", "term", "premium", "emergency_fund"), "user_id", "term", n=6)


_LOTS = f"""lots as (select h.user_id, symbol, current_value - quantity * avg_cost as gain, date_diff('day', buy_date, date '{AS_OF}') as days, case when symbol < 'Brand#5' then 'equity' else 'debt' end as asset, income from holdings h join people using (user_id)),
 k as (select *, case when days > case when asset = 'equity' then 365 else 1095 end then 'LTCG' else 'STCG' end as kind from lots)"""


def lots(spark, d):
    x = X.holdings_in_order(spark, d).join(people(spark, d), "user_id")
    return x.select("user_id", "symbol", (F.col("current_value") - F.col("quantity") * F.col("avg_cost")).alias("gain"), F.datediff(F.lit(AS_OF), "buy_date").alias("days"), F.when(F.col("symbol") < "Brand#5", "equity").otherwise("debt").alias("asset"), "income")


@query(f"""with {X.HOLDINGS}, {PEOPLE}, {_LOTS}, b as (select *, coalesce(sum(case when kind = 'STCG' then gain else 0 end) over (partition by user_id order by symbol rows between unbounded preceding and 1 preceding), 0) as before from k),
 m as (select *, round(income + before, 2) as mi from b),
 x as (select *, case when kind = 'LTCG' then 0.125 when asset = 'equity' then 0.20 else case when mi <= 700000 then 0.0 else {_case('mi', T.SLAB_STARTS)} end end::double as rate from m)
select user_id, symbol, kind, rate, round(rate * case when kind = 'LTCG' and asset = 'equity' then greatest(0, gain - 125000) when asset = 'equity' then gain else greatest(0, gain) end, 6) + 0.0 as tax from x""")
def f36_lot_taxes(spark, d):
    return T.capital_gains(lots(spark, d), "user_id", "income", "symbol").select("user_id", "symbol", "kind", "rate", (F.round("tax", 6) + 0.0).alias("tax"))


@query(f"""with {X.HOLDINGS}, {PEOPLE}, {_LOTS}, g as (select user_id, max(income) as income, coalesce(sum(gain) filter (kind = 'LTCG'), 0) as lt, coalesce(sum(gain) filter (kind = 'STCG'), 0) as st from k group by 1),
 x as (select *, greatest(0, lt - 125000) * 0.125::double + st * 0.20::double as base, round(income + greatest(0, st) + greatest(0, lt - 125000), 2) as ti from g), y as (select *, base * ({_case('ti', T.SURCHARGES, '>')})::double as sur from x)
select user_id, round(lt, 6) + 0.0 as long_total, round(st, 6) + 0.0 as short_total, round(sur, 6) + 0.0 as surcharge, round((base + sur) * 0.04::double, 6) + 0.0 as cess, round((base + sur) * 1.04::double, 6) + 0.0 as total_tax from y""")
def f36_capital_gains_tax(spark, d):
    x = T.gains_tax(T.capital_gains(lots(spark, d), "user_id", "income", "symbol"), "user_id", "income")
    return x.select("user_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("long_total", "short_total", "surcharge", "cess", "total_tax")))


@query(f"""with {X.HOLDINGS}, l as (select user_id, symbol, current_value - quantity * avg_cost as pnl, date_diff('day', buy_date, date '{AS_OF}') as days from holdings)
select user_id, symbol, round(-pnl)::bigint as loss, case when days < 365 then 'STCG' else 'LTCG' end as kind, round(-pnl * case when days < 365 then 0.15 else 0.125 end::double)::bigint as saving from l where pnl < 0""")
def f34_loss_harvest(spark, d):
    """Losses that could be taken, and the tax they would save; the exact arithmetic of gains and days is in F36."""
    x = X.holdings_in_order(spark, d)
    x = x.select("user_id", "symbol", (F.col("current_value") - F.col("quantity") * F.col("avg_cost")).alias("gain"), F.datediff(F.lit(AS_OF), "buy_date").alias("days")).where("gain < 0")
    short = F.col("days") < 365
    return x.select("user_id", "symbol", F.round(-F.col("gain")).cast("bigint").alias("loss"), F.when(short, "STCG").otherwise("LTCG").alias("kind"), F.round(-F.col("gain") * F.when(short, 0.15).otherwise(0.125)).cast("bigint").alias("saving"))


@query(f"""with {PEOPLE}, e as (select user_id, event_type as category, round(sum(value) * 40, 2) as amount from events group by 1, 2), t as (select user_id, sum(amount) as spent, any_value(round(income / 12, 2)) as monthly, list_sort(list(category) filter (amount / round(income / 12, 2) * 100 > 30)) as high from e join people using (user_id) where income > 0 group by 1)
select user_id, round(spent, 4) as spent, round(spent / monthly * 100, 4) as expense_ratio, round(monthly * 0.2::double, 6) as savings_target, round(monthly - spent - monthly * 0.2::double, 6) as surplus, round(monthly * 0.5::double, 6) as needs, round(monthly * 0.3::double, 6) as wants, coalesce(array_to_string(high, ','), '') as high_spend from t""")
def a23_budget(spark, d):
    """A month's spending by category against income: ratio, surplus, the 50/30/20 split, categories over 30 %."""
    e = X.table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("category")).agg(F.round(F.sum("value") * 40, 2).alias("amount"))
    x = e.join(people(spark, d).where("income > 0").withColumn("monthly", F.round(F.col("income") / 12, 2)), "user_id")
    m = F.col("monthly")
    high = F.array_sort(F.collect_list(F.when(F.col("amount") / m * 100 > 30, F.col("category"))))
    t = x.groupBy("user_id").agg(F.sum("amount").alias("spent"), F.max("monthly").alias("monthly"), high.alias("high"))
    return t.select("user_id", F.round("spent", 4).alias("spent"), F.round(F.col("spent") / m * 100, 4).alias("expense_ratio"), F.round(m * 0.2, 6).alias("savings_target"), F.round(m - F.col("spent") - m * 0.2, 6).alias("surplus"), F.round(m * 0.5, 6).alias("needs"), F.round(m * 0.3, 6).alias("wants"), F.array_join("high", ",").alias("high_spend"))


def drift_input(spark, d):
    """portfolio, symbol, current (its own weight), target (the mean of all portfolios'), price, days held."""
    w = X.weights(spark, d)
    t = w.groupBy("symbol").agg(F.round(F.avg("weight"), 9).alias("target"), F.round(F.avg("weight") * 1000, 6).alias("price"))
    return w.join(t, "symbol").select("portfolio", "symbol", F.col("weight").alias("current"), "target", "price", (F.crc32(F.concat("portfolio", "symbol").cast("binary")) % 700).cast("int").alias("days"))


_DRIFT = f"""{X.WEIGHTS}, t as (select symbol, round(avg(weight), 9) as target, round(avg(weight) * 1000, 6) as price from weights group by 1),
 i as (select portfolio, symbol, weight as w, target, price from weights join t using (symbol)), n as (select *, round(w / sum(w) over (partition by portfolio), 9) as current from i),
 c as (select *, round(target - current, 9) as drift, (current - target) / target * 100 as relative from n),
 dr as (select *, case when drift > 0.005::double * target then case when drift > 0 then 'BUY' else 'SELL' end when drift < -0.005::double * greatest(target, 0.01) then 'SELL' else 'HOLD' end as action from c)"""


@query(f"with {_DRIFT} select portfolio, symbol, round(drift, 6) as drift, round(relative, 2) as relative, action from dr")
def f28_drift_report(spark, d):
    return T.drift_report(drift_input(spark, d), "portfolio", 0.005).select("portfolio", "symbol", F.round("drift", 6).alias("drift"), F.round("relative", 2).alias("relative"), "action")


@query(f"with {_DRIFT} select portfolio, bool_or(action <> 'HOLD') as needed from dr group by 1")
def f28_needs_rebalancing(spark, d):
    return T.drift_report(drift_input(spark, d), "portfolio", 0.005).groupBy("portfolio").agg(F.bool_or(F.col("action") != "HOLD").alias("needed"))


_TRADES = _DRIFT + """, v as (select *, round(abs(drift) * 10000000, 2) as value, case when drift > 0 then 'BUY' else 'SELL' end as side from dr where action <> 'HOLD'),
 tr as (select *, case when abs(round(relative, 2)) > 15 then 'REQUIRED' else 'RECOMMENDED' end as priority, case when side = 'BUY' then 0 else greatest(0, value - 125000) * 0.125::double end as tax from v)"""


def _trades(spark, d, held):
    return T.rebalance_trades(T.drift_report(drift_input(spark, d).withColumn("days", held), "portfolio", 0.005), F.lit(10_000_000.0), "price", "days")


@query(f"with {_TRADES} select portfolio, symbol, side, value, round(value / price, 2) as quantity, priority, round(tax, 6) as tax from tr")
def f29_rebalance_trades(spark, d):
    return _trades(spark, d, F.lit(400)).select("portfolio", "symbol", "side", "value", F.round(F.col("value") / F.col("price"), 2).alias("quantity"), "priority", F.round("tax", 6).alias("tax"))


@query(f"""with {_TRADES}, o as (select *, coalesce(sum(value) over (partition by portfolio order by case priority when 'REQUIRED' then 0 when 'RECOMMENDED' then 1 else 2 end, -value, symbol rows between unbounded preceding and 1 preceding), 0) as used from tr)
select portfolio, symbol, round(least(value, 100000 - used), 2) as filled, round(tax * least(value, 100000 - used) / value, 6) as tax from o where used < 100000""")
def w37_turnover_budget(spark, d):
    """The reference's order of priorities; the budget is 1 % of the value, so that the limit cuts."""
    rank = F.when(F.col("priority") == "REQUIRED", 0).when(F.col("priority") == "RECOMMENDED", 1).otherwise(2)
    x = T.within_budget(_trades(spark, d, F.lit(400)), "portfolio", F.lit(100_000.0), [rank, -F.col("value"), F.col("symbol")])
    return x.select("portfolio", "symbol", F.round("filled", 2).alias("filled"), F.round("tax", 6).alias("tax"))


@query(f"""with {_DRIFT}, v as (select *, round(abs(drift) * 10000000, 2) as value, 340 as days from dr where action = 'SELL' and drift < 0)
select portfolio, count(*) filter (365 - days > 30) as immediate, count(*) filter (365 - days <= 30) as deferred, round(coalesce(sum(value * 0.20::double) filter (365 - days <= 30), 0), 6) as tax_deferred from v group by 1""")
def f31_tax_aware_split(spark, d):
    """Sales of lots 30 days or fewer from the long-term rate wait."""
    x = _trades(spark, d, F.lit(340)).where("side = 'SELL'")
    near = F.col("days_to_long").between(1, 30)
    return x.groupBy("portfolio").agg(F.count_if(~near).alias("immediate"), F.count_if(near).alias("deferred"), F.round(F.coalesce(F.sum(F.when(near, F.col("tax"))), F.lit(0.0)), 6).alias("tax_deferred"))


@query(f"""with {_DRIFT}, x as (select portfolio, count(*) as trades, sum(abs(target - w)) * 1000000 as moved from dr where abs(target - w) >= 0.001 group by 1)
select portfolio, trades, round(moved / 2000000, 6) as turnover, round(moved * 0.001, 2) as cost, round(least(1, 0.05 / (moved / 2000000)), 4) as scale from x""")
def f32_simple_rebalance(spark, d):
    """Trades of 0.1 % or more, turnover, cost of 0.1 %, and the factor that brings turnover down to a limit of 5 %."""
    moved = F.sum(F.abs(F.col("target") - F.col("current"))) * 1_000_000
    x = drift_input(spark, d).where(F.abs(F.col("target") - F.col("current")) >= 0.001).groupBy("portfolio").agg(F.count("*").alias("trades"), moved.alias("moved"))
    turnover = F.col("moved") / 2_000_000
    return x.select("portfolio", "trades", F.round(turnover, 6).alias("turnover"), F.round(F.col("moved") * 0.001, 2).alias("cost"), F.round(F.least(F.lit(1.0), 0.05 / turnover), 4).alias("scale"))


@query(f"""with {X.HOLDINGS}, {X.SECTORS}, w as (select user_id, symbol, coalesce(sector, 'UNKNOWN') as sector, round(current_value / sum(current_value) over (partition by user_id), 9) as share from holdings left join sectors using (symbol)),
 p as (select *, row_number() over (partition by user_id order by share desc, symbol) as place from w)
select user_id, 'stock' as rule, symbol as what, round(share, 4) as share from p where share > 0.10 union all
select user_id, 'top ten', 'all', round(sum(share), 4) from p where place <= 10 group by 1 having sum(share) > 0.55 union all
select user_id, 'sector', sector, round(sum(share), 4) from p group by 1, 3 having sum(share) > 0.25 union all
select user_id, 'holdings', 'all', count(*) filter (share > 0.005)::double from p group by 1 having count(*) filter (share > 0.005) < 10""")
def f35_constraint_violations(spark, d):
    x = X.holdings(spark, d).join(F.broadcast(X.sectors(spark, d)), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN"))).withColumnRenamed("current_value", "weight")
    return T.constraint_violations(x, "user_id").withColumn("share", F.round("share", 4))
