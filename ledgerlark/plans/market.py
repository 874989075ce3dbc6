"""Queries: bars and indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators import bars as B
from ledgerlark.operators import indicators as I
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query

W = "(partition by symbol order by d)"
_T = "over (partition by symbol order by d rows between {} preceding and current row)"


def t(n: int) -> str:
    return _T.format(n - 1)


#: Added before rounding means of cents, which can lie exactly on a rounding edge.
OFF = 1e-6


def rounded(df, *cols, n=6):
    return df.select("symbol", "d", *(F.round(c, n).alias(c) for c in cols))


@query(f"with {X.BARS} select * from bars")
def a01_daily_bars(spark, d):
    return X.bars(spark, d)


@query(f"""with {X.BARS}, m as (select *, "close" - lag("close") over {W} as mv from bars),
 i as (select symbol, d, avg("close") {t(20)} as sma_20, stddev_pop("close") {t(20)} as sd, "close",
 100 - 100 / (1 + avg(greatest(mv, 0)) {t(14)} / (avg(greatest(-mv, 0)) {t(14)} + 1e-10)) as rsi,
 max("close") over (partition by symbol order by d rows unbounded preceding) as peak from m)
select symbol, d, round(sma_20 + 1e-6, 4) as sma_20, round(rsi, 6) as rsi, round(sma_20 + 2 * sd, 0) as bb_upper, round(sma_20 - 2 * sd, 0) as bb_lower,
 round("close" / peak - 1, 9) as drawdown from i""")
def flagship_bars_indicators(spark, d):
    x = I.with_bollinger(I.with_rsi_simple(X.bars(spark, d)))
    peak = F.max("close").over(I.by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return x.select("symbol", "d", F.round(F.col("bb_mid") + OFF, 4).alias("sma_20"), F.round("rsi", 6).alias("rsi"), F.round("bb_upper", 0).alias("bb_upper"), F.round("bb_lower", 0).alias("bb_lower"), F.round(F.col("close") / peak - 1, 9).alias("drawdown"))


@query(f'with {X.BARS} select symbol, d, ' + ", ".join(f'round(avg("close") {t(n)} + 1e-6, 4) as sma_{n}' for n in (5, 10, 20, 50)) + " from bars")
def w01_sma(spark, d):
    return X.bars(spark, d).select("symbol", "d", *(F.round(I.sma("close", n) + OFF, 4).alias(f"sma_{n}") for n in (5, 10, 20, 50)))


@query(f"""with {X.BARS} select symbol, round(avg("close") filter (k <= 50), 4) as sma_50, count(*) as n
 from (select *, row_number() over (partition by symbol order by d desc) as k from bars) group by symbol""")
def w02_sma_last(spark, d):
    x = X.bars(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))))
    return x.groupBy("symbol").agg(F.round(F.avg(F.when(F.col("k") <= 50, F.col("close"))), 4).alias("sma_50"), F.count("*").alias("n"))


_REC = f"""with recursive {X.BARS}, s as (select symbol, d, "close" as x, row_number() over {W} as k, "close" / lag("close") over {W} - 1 as r from bars),
 e as (select symbol, d, k, x, x as ema, x as fast, x as slow, 0.0::double as signal, 0.0::double as var from s where k = 1
  union all select s.symbol, s.d, s.k, s.x, e.ema + 2.0 / 21 * (s.x - e.ema), e.fast + 2.0 / 13 * (s.x - e.fast), e.slow + 2.0 / 27 * (s.x - e.slow),
   e.signal + 0.2 * ((e.fast + 2.0 / 13 * (s.x - e.fast)) - (e.slow + 2.0 / 27 * (s.x - e.slow)) - e.signal), e.var + 0.06 * (s.r * s.r - e.var)
  from e join s on s.symbol = e.symbol and s.k = e.k + 1)"""


@query(_REC + " select symbol, d, round(ema, 3) as ema_20 from e")
def w03_ema(spark, d):
    return I.recursive_indicators(X.bars(spark, d)).select("symbol", "d", F.round("ema_20", 3).alias("ema_20"))


@query(_REC + " select symbol, round(arg_max(ema, k), 3) as ema from e group by symbol")
def w03_ema_last_fold(spark, d):
    return I.ema_last(X.bars(spark, d), 20).select("symbol", F.round("ema", 3).alias("ema"))


@query(_REC + " select symbol, d, round(fast - slow, 3) as macd, round(signal, 3) as signal, round(fast - slow - signal, 3) as histogram from e")
def w05_macd(spark, d):
    return rounded(I.recursive_indicators(X.bars(spark, d)), "macd", "signal", "histogram", n=3)


@query(f"""with recursive {X.BARS}, s as (select symbol, d, row_number() over {W} as k, greatest("close" - lag("close") over {W}, 0) as u, greatest(lag("close") over {W} - "close", 0) as l from bars),
 g as (select symbol, avg(u) as gain, avg(l) as loss from s where k between 2 and 15 group by 1),
 e as (select s.symbol, s.d, s.k, g.gain, g.loss from s join g using (symbol) where k = 15
  union all select s.symbol, s.d, s.k, (e.gain * 13 + s.u) / 14, (e.loss * 13 + s.l) / 14 from e join s on s.symbol = e.symbol and s.k = e.k + 1)
select symbol, d, 50.0 as rsi from s where k < 15 union all select symbol, d, case when loss = 0 then 100 else round(100 - 100 / (1 + gain / loss), 6) end from e""")
def w07_rsi_wilder(spark, d):
    return I.recursive_indicators(X.bars(spark, d)).select("symbol", "d", F.round("rsi_wilder", 6).alias("rsi"))


@query(f"""with {X.BARS}, m as (select *, "close" - lag("close") over {W} as mv from bars)
select symbol, d, round(100 - 100 / (1 + avg(greatest(mv, 0)) {t(14)} / (avg(greatest(-mv, 0)) {t(14)} + 1e-10)), 6) as rsi from m""")
def w08_rsi_simple(spark, d):
    return rounded(I.with_rsi_simple(X.bars(spark, d)), "rsi")


@query(f"""with {X.BARS}, i as (select symbol, d, "close" as c, avg("close") {t(20)} as m, stddev_pop("close") over (partition by symbol) as sd from bars)
select symbol, d, round(m + 2 * sd, 4) as upper, round(m - 2 * sd, 4) as lower, round((c - (m - 2 * sd)) / (4 * sd) * 100, 6) as position from i""")
def w09_bollinger_whole(spark, d):
    sd = F.stddev_pop("close").over(Window.partitionBy("symbol"))
    x = X.bars(spark, d).withColumn("m", I.sma("close", 20)).withColumn("sd", sd)
    lower = F.col("m") - 2 * F.col("sd")
    return x.select("symbol", "d", F.round(F.col("m") + 2 * F.col("sd"), 4).alias("upper"), F.round(lower, 4).alias("lower"), F.round((F.col("close") - lower) / (4 * F.col("sd")) * 100, 6).alias("position"))


for _name, _sd in (("w10_bollinger_pop", f'stddev_pop("close") {t(20)}'), ("w11_bollinger_sample", f'coalesce(stddev_samp("close") {t(20)}, 0)')):

    @query(f"""with {X.BARS}, i as (select symbol, d, "close" as c, avg("close") {t(20)} as m, {_sd} as sd from bars)
select symbol, d, round(m + 2 * sd, 0) as bb_upper, round(m - 2 * sd, 0) as bb_lower, round(4 * sd / m, 6) as bb_width,
 round((c - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0), 6) as bb_position from i""", _name)
    def _bollinger(spark, d, sample=_name.endswith("sample")):
        x = rounded(I.with_bollinger(X.bars(spark, d), sample=sample), "bb_width", "bb_position", "bb_upper", "bb_lower", n=6)
        return x.withColumn("bb_upper", F.round("bb_upper", 0)).withColumn("bb_lower", F.round("bb_lower", 0))


@query(f"""with {X.BARS} select symbol, d, round(100 * ("close" - min(low) {t(14)}) / nullif(max(high) {t(14)} - min(low) {t(14)}, 0), 6) as k,
 round(100 * ("close" - min("close") {t(14)}) / nullif(max("close") {t(14)} - min("close") {t(14)}, 0), 6) as k_close from bars""")
def w12_stochastic(spark, d):
    return X.bars(spark, d).select("symbol", "d", F.round(I.stochastic(), 6).alias("k"), F.round(I.stochastic(14, "close", "close"), 6).alias("k_close"))


@query(f"""with {X.BARS}, r as (select *, lag("close") over {W} as p from bars), tr as (select symbol, d, greatest(high - low, abs(high - p), abs(low - p)) as tr from r)
select symbol, d, round(avg(tr) {t(14)}, 4) as atr from tr""")
def w13_atr(spark, d):
    return rounded(I.with_atr(X.bars(spark, d)), "atr", n=4)


@query(f"""with {X.BARS}, m as (select symbol, d, abs("close" - lag("close") over {W}) as m, row_number() over (partition by symbol order by d desc) as k from bars)
select symbol, round(avg(m), 4) as atr from m where k <= 14 group by symbol""")
def w14_atr_close(spark, d):
    x = X.bars(spark, d).withColumn("m", F.abs(F.col("close") - I.previous("close"))).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))))
    return x.where("k <= 14").groupBy("symbol").agg(F.round(F.avg("m"), 4).alias("atr"))


@query(f"""with {X.BARS}, s as (select symbol, d, coalesce(sign("close" - lag("close") over {W}), 0) * volume as v from bars)
select symbol, d, sum(v) over (partition by symbol order by d rows unbounded preceding) as obv from s""")
def w15_obv(spark, d):
    return I.with_obv(X.bars(spark, d)).select("symbol", "d", "obv")


@query(f"""with {X.BARS}, p as (select symbol, max(high) as h, min(low) as l, arg_max("close", d) as c from bars group by 1), q as (select *, (h + l + c) / 3 as p from p)
select symbol, round(p, 4) as "pivot", round(2 * p - l, 4) as r1, round(2 * p - h, 4) as s1, round(p + (h - l), 4) as r2, round(p - (h - l), 4) as s2 from q""")
def w16_pivots(spark, d):
    p = X.bars(spark, d).groupBy("symbol").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "d").alias("c")).withColumn("pivot", (F.col("h") + F.col("l") + F.col("c")) / 3)
    return p.selectExpr("symbol", "round(pivot, 4) as pivot", "round(2 * pivot - l, 4) as r1", "round(2 * pivot - h, 4) as s1", "round(pivot + (h - l), 4) as r2", "round(pivot - (h - l), 4) as s2")


@query(f"""with {X.BARS}, m as (select symbol, d, "close" as c, avg("close") {t(20)} as a, avg("close") {t(50)} as b from bars)
select symbol, d, case when c > a and a > b then 'bullish' when c < a and a < b then 'bearish' else 'sideways' end as trend from m""")
def w17_trend(spark, d):
    a, b, c = I.sma("close", 20), I.sma("close", 50), F.col("close")
    x = X.bars(spark, d).withColumn("a", a).withColumn("b", b)
    return x.select("symbol", "d", F.when((c > F.col("a")) & (F.col("a") > F.col("b")), "bullish").when((c < F.col("a")) & (F.col("a") < F.col("b")), "bearish").otherwise("sideways").alias("trend"))


@query(f'with {X.BARS} select symbol, d, round(avg(volume) {t(10)}, 6) as vol_sma, round(volume / avg(volume) {t(10)}, 6) as vol_ratio from bars')
def w18_volume_sma(spark, d):
    return X.bars(spark, d).select("symbol", "d", F.round(I.sma("volume", 10), 6).alias("vol_sma"), F.round(F.col("volume") / I.sma("volume", 10), 6).alias("vol_ratio"))


@query(f'with {X.BARS} select symbol, d, coalesce(round(ln("close" / lag("close") over {W} + 1e-10), 6), 0) as log_1, coalesce(round(ln("close" / lag("close", 5) over {W} + 1e-10), 6), 0) as log_5 from bars')
def w19_log_returns(spark, d):
    logs = [F.round(I.finite(F.ln(F.col("close") / I.previous("close", n) + 1e-10)), 6).alias(f"log_{n}") for n in (1, 5)]
    return X.bars(spark, d).select("symbol", "d", *logs)


@query(f"""with {X.BARS}, a as (select *, "close" / lag("close") over {W} - 1 as r1, (high - low) / "close" as rg from bars)
select symbol, d, coalesce(round(r1, 6), 0) as ret_1, {", ".join(f'coalesce(round("close" / lag("close", {n}) over {W} - 1, 6), 0) as ret_{n}' for n in (5, 10, 20))},
 {", ".join(f'coalesce(case when count("close") {t(n)} = {n} then round("close" / avg("close") {t(n)} - 1, 6) end, 0) as from_sma_{n}' for n in (5, 20))},
 {", ".join(f'coalesce(case when count(r1) {t(n)} = {n} then round(stddev_samp(r1) {t(n)}, 6) end, 0) as vol_{n}' for n in (5, 20))}, round(rg, 6) as range,
 coalesce(case when count("close") {t(20)} = 20 then round((rg - avg(rg) {t(20)}) / nullif(stddev_samp(rg) {t(20)}, 0), 6) end, 0) as range_z,
 coalesce(round(open / lag("close") over {W} - 1, 6), 0) as gap from a""")
def w21_price_features(spark, d):
    x = I.price_features(X.bars(spark, d))
    return rounded(x, *x.columns[2:])


@query(f"""with {X.BARS}, p as (select *, lag("close") over {W} as pc, lag(volume) over {W} as pv from bars)
select symbol, d, coalesce(round(volume / nullif(pv, 0) - 1, 6), 0) as vol_change, coalesce(round(volume / nullif(avg(volume) {t(20)}, 0), 6), 0) as vol_ratio,
 coalesce(case when count(volume) {t(20)} = 20 then round((volume - avg(volume) {t(20)}) / nullif(stddev_samp(volume) {t(20)}, 0), 6) end, 0) as vol_z,
 case when sign("close" - pc) * sign(volume - pv) < 0 then 1.0::double else 0.0::double end as divergence from p""")
def w22_volume_features(spark, d):
    x = I.volume_features(X.bars(spark, d))
    return rounded(x, *x.columns[2:])


@query(f"with {X.PRICES} select symbol, d, round((px - lag(px) over {W}) / lag(px) over {W}, 6) as ret from prices")
def w23_simple_returns(spark, d):
    return X.prices(spark, d).select("symbol", "d", F.round((F.col("px") - I.previous("px")) / I.previous("px"), 6).alias("ret"))


@query(_REC + " select symbol, round(sqrt(arg_max(var, k) * 252), 6) as vol from e group by symbol")
def w30_ewma_volatility(spark, d):
    return I.recursive_indicators(X.bars(spark, d)).groupBy("symbol").agg(F.round(F.max_by("ewma_vol", "d"), 6).alias("vol"))


@query(f"""with {X.BARS}, k as (select symbol, d, "close" as c, row_number() over {W} - 1 as i, count(*) over (partition by symbol) as n from bars)
select symbol, case when i < floor(n * 0.8) then 'train' else 'val' end as part, count(*) as rows, min(d) as first, max(d) as last from k group by 1, 2""")
def w33_chronological_split(spark, d):
    w = Window.partitionBy("symbol")
    x = X.bars(spark, d).withColumn("i", F.row_number().over(w.orderBy("d")) - 1).withColumn("n", F.count("*").over(w))
    part = F.when(F.col("i") < F.floor(F.col("n") * 0.8), "train").otherwise("val")
    return x.groupBy("symbol", part.alias("part")).agg(F.count("*").alias("rows"), F.min("d").alias("first"), F.max("d").alias("last"))


@query(f"""with {X.BARS}, s as (select symbol, d, "close" as c, avg("close") over (partition by symbol) as m, stddev_pop("close") over (partition by symbol) as s from bars)
select symbol, d, round((c - m) / case when s < 1e-8 then 1 else s end, 6) as z from s""")
def w34_z_normalise(spark, d):
    w = Window.partitionBy("symbol")
    s = F.stddev_pop("close").over(w)
    return X.bars(spark, d).select("symbol", "d", F.round((F.col("close") - F.avg("close").over(w)) / F.when(s < 1e-8, 1.0).otherwise(s), 6).alias("z"))


@query(f"""with {X.BARS}, k as (select symbol, d, "close" as c, row_number() over {W} as i from bars),
 w as (select symbol, d, i, list(c) over (partition by symbol order by d rows between 7 preceding and current row) as past, list(c) over (partition by symbol order by d rows between 1 following and 2 following) as next from k)
select symbol, d, round(list_sum(past), 3) as past, round(list_sum(next), 3) as next from w where len(past) = 8 and len(next) = 2 and i % 4 = 0""")
def w32_training_windows(spark, d):
    return _training_windows(spark, d, 8, 2)


@query(f"""with {X.BARS}, k as (select symbol, d, "close" as c, row_number() over {W} as i from bars),
 w as (select symbol, d, i, list(c) over (partition by symbol order by d rows between 95 preceding and current row) as past, list(c) over (partition by symbol order by d rows between 1 following and 24 following) as next from k)
select symbol, d, round(list_sum(past), 3) as past, round(list_sum(next), 3) as next from w where len(past) = 96 and len(next) = 24 and i % 4 = 0""")
def w32_training_windows_96_24(spark, d):
    return _training_windows(spark, d, 96, 24)


def _training_windows(spark, d, context, horizon):
    """Sums of each window of ``context`` rows and of the ``horizon`` rows after it, at every fourth row; full windows only."""
    w = I.by_symbol()
    x = X.bars(spark, d).withColumn("i", F.row_number().over(w)).withColumn("past", F.collect_list("close").over(w.rowsBetween(1 - context, 0))).withColumn("next", F.collect_list("close").over(w.rowsBetween(1, horizon)))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 3)
    return x.where(f"size(past) = {context} and size(next) = {horizon} and i % 4 = 0").select("symbol", "d", total("past").alias("past"), total("next").alias("next"))


@query(f"""with {X.BARS}, k as (select symbol, "close" as c, 20 - row_number() over (partition by symbol order by d desc) as t from bars qualify t >= 0),
 f as (select symbol, regr_slope(c, t) as s, regr_intercept(c, t) as a, arg_max(c, t) as c from k group by 1)
select symbol, step::int as step, round(a + s * (19 + step), 3) as forecast, case when s * 5 / c > 0.02 then 'up' when s * 5 / c < -0.02 then 'down' else 'flat' end as trend from f, range(1, 6) r(step)""")
def w35_linear_forecast(spark, d):
    return I.linear_forecast(X.bars(spark, d)).withColumn("forecast", F.round("forecast", 3))


_F = "coalesce({0}, last_value({0} ignore nulls) over (partition by symbol order by d rows between 3 preceding and 1 preceding)) as {0}"


@query(f"""with {X.BARS}, dirty as (select symbol, d, case when k % 7 in (2, 3) then null else open end as op, case when k % 11 = 4 then low - 1 else high end as hi, case when k % 11 = 4 then high else low end as lo,
 case when k % 7 = 2 or k % 13 in (3, 4, 5, 6) then null when k % 29 = 0 then -1.0 else "close" end as cl from (select *, row_number() over {W} as k from bars)),
 f as (select symbol, d, {", ".join(_F.format(c) for c in ("op", "hi", "lo", "cl"))} from dirty),
 g as (select symbol, d, {", ".join(f"coalesce({c}, lead({c}) over {W}) as {c}" for c in ("op", "hi", "lo", "cl"))} from f),
 h as (select symbol, d, case when op is not null then greatest(0, op) end as op, case when coalesce(hi, lo) is not null then greatest(0, hi, lo) end as hi, case when coalesce(hi, lo) is not null then greatest(0, least(hi, lo)) end as lo, greatest(0, cl) as cl from g where cl is not null)
select symbol, d, op as open, hi as high, lo as low, cl as "close", coalesce(abs(cl / nullif(lag(cl) over {W}, 0) - 1) > 0.2, false) as corporate_action from h""")
def p05_clean_bars(spark, d):
    k = F.row_number().over(I.by_symbol())
    x = X.bars(spark, d).withColumn("k", k)
    x = x.selectExpr(
        "symbol", "d", "case when k % 7 in (2, 3) then null else open end as open", "case when k % 11 = 4 then low - 1 else high end as high", "case when k % 11 = 4 then high else low end as low",
        "case when k % 7 = 2 or k % 13 in (3, 4, 5, 6) then null when k % 29 = 0 then -1.0 else close end as close", "volume",
    )
    return B.clean_bars(x).select("symbol", "d", "open", "high", "low", "close", "corporate_action")


@query(f"""with {X.BARS}, m as (select *, row_number() over {W} as seq, case when day(d) = 13 then -open else open end as o, case when day(d) = 7 then low else high end as h from bars)
select symbol, count(*) filter (least(o, h, low, "close") <= 0) as bad_price, count(*) filter (volume < 0) as bad_volume, count(*) filter (h < greatest(o, "close")) as bad_high,
 count(*) filter (low > least(o, "close")) as bad_low from m group by 1""")
def p04_bar_violations(spark, d):
    x = X.bars(spark, d).withColumn("seq", F.row_number().over(I.by_symbol())).withColumn("open", F.when(F.dayofmonth("d") == 13, -F.col("open")).otherwise(F.col("open"))).withColumn("high", F.when(F.dayofmonth("d") == 7, F.col("low")).otherwise(F.col("high")))
    return B.bar_violations(x).groupBy("symbol").agg(*(F.count_if(c).alias(c) for c in ("bad_price", "bad_volume", "bad_high", "bad_low")))


@query(f"""with {X.RETURNS.replace("returns as", "daily as")}, returns as (select symbol, cast(date_trunc('month', d) as date) as d, round(sum(ret), 6) as ret from daily where symbol != 'Brand#13' or month(d) = 5 group by 1, 2),
 n as (select floor(count(distinct d) * 0.9) as need from returns), rich as (select symbol from returns, n group by symbol, need having count(ret) >= need),
 kept as (select * from returns where symbol in (select symbol from rich)), days as (select d from kept group by d having count(*) = (select count(distinct symbol) from kept))
select symbol, d, ret from kept where d in (select d from days)""")
def p06_complete_returns(spark, d):
    return B.complete_returns(X.returns(spark, d).withColumn("d", F.trunc("d", "MM")).groupBy("symbol", "d").agg(F.round(F.sum("ret"), 6).alias("ret")).where("symbol != 'Brand#13' or month(d) = 5"), 0.9)


@query(f"""with {X.RETURNS}, b as (select symbol, max(case when ret <= 0 then d end) as bad from returns group by 1)
select symbol, round(sum(ret), 6) as total, round(avg(ret), 6) as mean, count(*) filter (ret > 0) as positive_days, count(*) filter (bad is null or d > bad) as streak from returns join b using (symbol) group by 1""")
def p11_flow_streak(spark, d):
    return I.trailing_positive_streak(X.returns(spark, d), "ret").select("symbol", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), "positive_days", "streak")


@query(f"""with {X.BARS} select symbol, round(avg("close"), 4) as mean, round(stddev_pop("close"), 4) as std, max("close") as high, min("close") as low, round((arg_max("close", d) / arg_min("close", d) - 1) * 100, 6) as change_pct from bars group by 1""")
def a12_price_stats(spark, d):
    c = F.col("close")
    return X.bars(spark, d).groupBy("symbol").agg(F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_pop(c), 4).alias("std"), F.max(c).alias("high"), F.min(c).alias("low"), F.round((F.max_by(c, "d") / F.min_by(c, "d") - 1) * 100, 6).alias("change_pct"))


@query(f"""with {X.BARS}, x as (select symbol, d, "close" as px, 0 as side from bars where month(d) <= 6 union all select symbol, d, "close" + 1, 1 from bars where month(d) >= 6)
select symbol, d, arg_max(px, side) as px from x group by 1, 2""")
def k01_upsert_bars(spark, d):
    b = X.bars(spark, d).select("symbol", "d", F.col("close").alias("px"))
    return B.upsert(b.where(F.month("d") <= 6), b.where(F.month("d") >= 6).withColumn("px", F.col("px") + 1), ["symbol", "d"])


@query(f"""with {X.TICKS} select symbol, cast(ts as date) as d, count(*) as n from ticks where symbol in ('BUILDING', 'MACHINERY') and ts >= timestamp '1996-01-01' and ts < timestamp '1996-07-01' group by 1, 2""")
def s01_scan_symbols_range(spark, d):
    x = X.ticks(spark, d).where(F.col("symbol").isin("BUILDING", "MACHINERY") & (F.col("ts") >= "1996-01-01") & (F.col("ts") < "1996-07-01"))
    return x.groupBy("symbol", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))


@query("""with l as (select event_id, ts + interval 330 minute as t from events)
select event_id, (hour(t) * 60 + minute(t) between 555 and 930) and dayofweek(t) between 1 and 5 as open from l""")
def s05_trading_hours(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", B.trading_hours(F.col("ts").cast("timestamp")).alias("open"))


@query("""select o_custkey as user_id, o_orderkey as order_id from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def p14_latest_per_user(spark, d):
    return X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("order_id"))


@query("""select user_id, event_id, k from (select user_id, event_id, row_number() over (partition by user_id order by ts desc) as k from events) where k <= 10""")
def o07_latest_events_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"))
    return X.table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 10").withColumn("k", F.col("k").cast("bigint"))


@query("""select event_id, count(*) over (partition by user_id order by epoch(ts) range between 3600 preceding and current row) as n,
 count(*) over (partition by user_id order by epoch(ts) range between 3600 preceding and current row) > 3 as limited from events""")
def w40_rate_limit(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-3600, 0)
    return X.table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), (F.count("*").over(w) > 3).alias("limited"))


def _ema_weight(i, n, p):
    """Weight of the i-th of n values in the last EMA seeded by a mean, as SQL."""
    a = 2.0 / (p + 1)
    return f"case when {i} < {p} then pow({1 - a}::double, greatest({n} - {p}, 0)) / {p} else {a}::double * pow({1 - a}::double, {n} - 1 - {i}) end"


@query(f"""with {X.BARS}, x as (select symbol, "close" as c, row_number() over (partition by symbol order by d) - 1 as i, count(*) over (partition by symbol) as n, list("close") over (partition by symbol order by d rows between 25 preceding and current row) as w from bars),
 m as (select *, case when i >= 26 then list_dot_product(w, {I.macd_weights()}::double[]) end as m from x),
 g as (select symbol, sum(c * ({_ema_weight('i', 'n', 12)} - {_ema_weight('i', 'n', 26)})) as line, sum(m * ({_ema_weight('(i - 26)', '(n - 26)', 9)})) as sig from m group by 1)
select symbol, round(line, 4) as macd_line, round(coalesce(sig, line), 4) as signal_line, round(line - coalesce(sig, line), 4) as histogram, case when line > coalesce(sig, line) then 'bullish' else 'bearish' end as signal from g""")
def w06_macd_reseeded(spark, d):
    x = I.macd_reseeded(X.bars(spark, d))
    return x.select("symbol", *(F.round(c, 4).alias(c) for c in ("macd_line", "signal_line", "histogram")), "signal")
