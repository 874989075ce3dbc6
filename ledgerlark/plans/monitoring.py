"""Queries: drift, model quality, back-test summaries, company and sector figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators import backtest as T
from ledgerlark.operators import monitoring as M
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query
from ledgerlark.plans.risk import _EQ, P, r


def samples(spark, d):
    """feature (event type), value, cur: events before and from the 16th."""
    e = X.table(spark, d, "events")
    return e.select(F.col("event_type").alias("feature"), "value", (F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'")).alias("cur"))


_S = "x as (select event_type as feature, value, ts >= timestamp '2024-01-16' as cur from events)"
_SEV = "case when {0} < {1} then 'none' when {0} < {2} then 'low' when {0} < {3} then 'medium' else 'high' end"
_PSI = f"""e as (select feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as edges from x group by 1),
 b as (select x.feature, cur, least(len(list_filter(edges, lambda t: t <= value)), len(edges) - 1) as bin from x join e on x.feature = e.feature),
 c as (select feature, bin, count(*) filter (not cur) as r, count(*) filter (cur) as c from b group by 1, 2),
 s as (select feature, r / sum(r) over w + 1e-6 as p, c / sum(c) over w + 1e-6 as q from c window w as (partition by feature)),
 psi as (select feature, sum((q - p) * ln(q / p)) as psi from s group by 1)"""
_STEPS = """v as (select feature, value, count(*) filter (not cur) as r, count(*) filter (cur) as c from x group by 1, 2),
 st as (select feature, value, sum(r) over (partition by feature) as nr, sum(c) over (partition by feature) as nc,
  sum(r) over w / sum(r) over (partition by feature) - sum(c) over w / sum(c) over (partition by feature) as gap, lead(value) over (partition by feature order by value) - value as step
  from v window w as (partition by feature order by value rows unbounded preceding))"""
_KS = """k0 as (select feature, max(abs(gap)) as ks, max(nr)::double as nr, max(nc)::double as nc from st group by 1),
 ks as (select feature, ks, least(1, greatest(0, (select sum(case when k % 2 = 1 then 2 else -2 end * exp(-2 * k * k * ks * ks * nr * nc / (nr + nc))) from range(1, 21) t(k)))) as p_value from k0)"""
_PLEVEL = "case when p_value > 0.05 then 'none' when p_value > 0.01 then 'low' when p_value > 0.001 then 'medium' else 'high' end"


@query(f"with {_S}, {_PSI} select feature, round(psi, 6) as psi, {_SEV.format('psi', 0.1, 0.25, 0.5)} as severity from psi")
def d1_psi(spark, d):
    return r(M.psi(samples(spark, d)), "feature", "severity")


@query(f"with {_S}, {_STEPS}, {_KS} select feature, round(ks, 6) as ks, round(p_value, 6) as p_value, {_PLEVEL} as severity from ks")
def d2_ks(spark, d):
    return r(M.ks(samples(spark, d)), "feature", "severity")


@query(f"""with {_S}, {_STEPS}, w as (select feature, sum(abs(gap) * coalesce(step, 0)) as distance from st group by 1), n as (select w.*, distance / s as normalised from w join (select feature, stddev_pop(value) as s from x where not cur group by 1) using (feature))
select feature, round(distance, 5) as distance, round(normalised, 6) as normalised, {_SEV.format('normalised', 0.1, 0.3, 0.5)} as severity from n""")
def d3_wasserstein(spark, d):
    return r(M.wasserstein(samples(spark, d)), "feature", "severity", distance=5)


_JS = """h as (select x.feature, cur, least(floor((value - lo) / (hi - lo) * 20), 19) as bin from x join (select feature, min(value) as lo, max(value) as hi from x group by 1) using (feature)),
 hc as (select feature, bin, count(*) filter (not cur) as r, count(*) filter (cur) as c from h group by 1, 2), hs as (select feature, r / sum(r) over w as p, c / sum(c) over w as q from hc window w as (partition by feature)),
 js as (select feature, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as js from hs group by 1)"""


@query(f"with {_S}, {_JS} select feature, round(js, 6) as js, {_SEV.format('js', 0.02, 0.05, 0.1)} as severity from js")
def d4_js_distance(spark, d):
    return r(M.js_distance(samples(spark, d)), "feature", "severity")


_WORST = f"""pd as (select feature, greatest(psi, ks) as statistic, p_value, ['none', 'low', 'medium', 'high'][greatest(list_position(['none', 'low', 'medium', 'high'], {_SEV.format('psi', 0.1, 0.25, 0.5)}), list_position(['none', 'low', 'medium', 'high'], {_PLEVEL}))] as severity,
 (select abs(avg(value) filter (cur) - avg(value) filter (not cur)) / (abs(avg(value) filter (not cur)) + 1e-10) * 100 from x where x.feature = psi.feature) as shift from psi join ks using (feature))"""
_DRIFTED = f"with {_S}, {_PSI}, {_STEPS}, {_KS}, {_WORST}"


@query(_DRIFTED + " select feature, round(statistic, 6) as statistic, round(p_value, 6) as p_value, severity, round(shift, 5) as mean_shift_pct from pd")
def d5_prediction_drift(spark, d):
    return r(M.prediction_drift(samples(spark, d)), "feature", "severity", mean_shift_pct=5)


@query(_DRIFTED + """ select count(*) as features, count(*) filter (severity <> 'none') as drifted, arg_max(severity, list_position(['none', 'low', 'medium', 'high'], severity)) as worst,
 coalesce(string_agg('[' || upper(severity) || '] ' || feature, '; ' order by feature) filter (severity <> 'none'), '') as alerts from pd""")
def d6_drift_report(spark, d):
    x = M.prediction_drift(samples(spark, d)).withColumn("drift", F.col("severity") != "none")
    alerts = F.array_sort(F.collect_list(F.when(F.col("drift"), F.struct("feature", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "feature").alias("alert")))))
    return x.agg(F.count("*").alias("features"), F.count_if("drift").alias("drifted"), F.max_by("severity", M.rank_of(F.col("severity"))).alias("worst"), F.array_join(F.transform(alerts, lambda a: a["alert"]), "; ").alias("alerts"))


@query(_DRIFTED + " select round(avg((severity <> 'none')::int), 6) as share, avg((severity <> 'none')::int) >= 0.5 as dataset_drift from pd")
def a26_drift_share(spark, d):
    share = F.avg((F.col("severity") != "none").cast("double"))
    return M.prediction_drift(samples(spark, d)).agg(F.round(share, 6).alias("share"), (share >= 0.5).alias("dataset_drift"))


def forecasts(spark, d):
    """symbol, d, px, guess: the day before as a forecast; half: 0 or 1 of the symbol's days."""
    w = Window.partitionBy("symbol").orderBy("d")
    return X.prices(spark, d).withColumn("guess", F.lag("px").over(w)).withColumn("half", F.ntile(2).over(w)).where("guess is not null")


_FC = f"{X.PRICES}, fc as (select * from (select *, lag(px) over (partition by symbol order by d) as guess, ntile(2) over (partition by symbol order by d) as half from prices) where guess is not null)"
_RM = """rm as (select {k}, avg(abs(px - guess)) as mae, avg((px - guess) ** 2) as mse, sqrt(avg((px - guess) ** 2)) as rmse, 1 - avg((px - guess) ** 2) / var_pop(px) as r2, 1 - var_pop(px - guess) / var_pop(px) as explained_variance,
 avg(abs((px - guess) / px)) as mape, avg(same::int) as directional_accuracy from (select *, (px - lag(px) over o) * (guess - lag(guess) over o) > 0 as same from fc window o as (partition by {k} order by d)) group by {k})"""


@query(f"with {_FC}, {_RM.format(k='symbol')} select symbol, round(mae, 5) as mae, round(mse, 3) as mse, round(rmse, 5) as rmse, round(r2, 6) as r2, round(explained_variance, 6) as explained_variance, round(mape, 6) as mape, round(directional_accuracy, 6) as directional_accuracy from rm")
def a25_regression_metrics(spark, d):
    return r(M.regression_metrics(forecasts(spark, d), "symbol", "px", "guess", "d"), "symbol", mae=5, mse=3, rmse=5)


_CHANGE = f"""{_FC}, {_RM.format(k='symbol, half')}, u as (unpivot rm on mae, mse, rmse, r2, explained_variance, mape, directional_accuracy into name metric value v),
 ch as (select a.symbol, a.metric, a.v as old, b.v as new, round(b.v - a.v, 9) as change from u a join u b on a.symbol = b.symbol and a.metric = b.metric and a.half = 1 and b.half = 2)"""


def metric_changes(spark, d):
    x = forecasts(spark, d).withColumn("k", F.struct("symbol", "half"))
    m = M.regression_metrics(x, "k", "px", "guess", "d")
    u = m.unpivot("k", [c for c in m.columns if c != "k"], "metric", "v").groupBy("k.symbol", "metric").agg(F.max(F.when(F.col("k.half") == 1, F.col("v"))).alias("old"), F.max(F.when(F.col("k.half") == 2, F.col("v"))).alias("new"))
    return u.withColumn("change", F.round(F.col("new") - F.col("old"), 9))


@query(f"""with {_CHANGE}, t(prefix, sign, threshold) as (values {', '.join(f"('{p}', {s}, {t}::double)" for p, s, t in M.ALERTS)})
select symbol, metric, round(change, 4) as change, threshold, case when sign > 0 then 'increased' else 'decreased' end as direction from ch join t on starts_with(metric, prefix) and change * sign > threshold""")
def d7_degradation_alerts(spark, d):
    x = M.degradation_alerts(metric_changes(spark, d).select("symbol", "metric", "change"))
    return x.withColumn("change", F.round("change", 4))


@query(f"""with {_CHANGE}, p as (select symbol, avg((new - old) / abs(old)) as i from ch where old <> 0 group by 1) select symbol, round(i, 6) as improvement, i >= 0.02 as promoted from p""")
def d9_champion_challenger(spark, d):
    """Mean relative improvement of the second half's metrics over the first's; signs as they are, also where lower is better."""
    i = F.avg((F.col("new") - F.col("old")) / F.abs("old"))
    x = metric_changes(spark, d).where("old != 0").groupBy("symbol").agg(i.alias("i"))
    return x.select("symbol", F.round("i", 6).alias("improvement"), (F.col("i") >= 0.02).alias("promoted"))


@query(f"""with {_DRIFTED.removeprefix('with ')}, m as (select event_type as feature, count(*) as preds, date_diff('day', cast(max(ts) filter (ts < timestamp '2024-01-02') as date), date '2024-02-15') as days from events group by 1)
select feature, severity in ('high', 'critical') or days > 30 or preds > 1000 as retrain,
 array_to_string(list_filter([case when severity in ('high', 'critical') then 'drift severity: ' || severity end, case when days > 30 then 'days since retrain: ' || days || ' > 30' end, case when preds > 1000 then 'predictions since retrain: ' || preds || ' > 1000' end], lambda x: x is not null), '; ') as reason from pd join m using (feature)""")
def d8_retrain_decision(spark, d):
    """Triggers: drift, days since the last training (over 30), predictions since (over 1,000 here; the operator's users name their own)."""
    e = X.table(spark, d, "events").groupBy(F.col("event_type").alias("feature"))
    m = e.agg(F.count("*").alias("preds"), F.datediff(F.lit("2024-02-15"), F.max(F.when(F.col("ts") < F.expr("timestamp_ntz'2024-01-02'"), F.col("ts")))).alias("days"))
    x = M.prediction_drift(samples(spark, d)).join(m, "feature")
    why = [(F.col("severity").isin("high", "critical"), F.concat(F.lit("drift severity: "), "severity")), (F.col("days") > 30, F.concat(F.lit("days since retrain: "), "days", F.lit(" > 30"))), (F.col("preds") > 1000, F.concat(F.lit("predictions since retrain: "), "preds", F.lit(" > 1000")))]
    reason = F.array_join(F.array_compact(F.array(*(F.when(c, t) for c, t in why))), "; ")
    return x.select("feature", (why[0][0] | why[1][0] | why[2][0]).alias("retrain"), reason.alias("reason"))


@query("""with x as (select lang, quality as t, (n_chars >= 2000)::int as g, round(least(1, n_chars / 4000.0), 6)::double as p from documents join labels using (doc_id) where quality is not null),
 c as (select lang, k, count(*) filter (t = k) as re, count(*) filter (g = k) as sa, count(*) filter (t = k and g = k) as hit from x, (values (0), (1)) v(k) group by 1, 2 having count(*) filter (t = k) + count(*) filter (g = k) > 0),
 m as (select *, case when sa > 0 then hit / sa else 0 end as pr, case when re > 0 then hit / re else 0 end as rc from c), f as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1 from m),
 o as (select lang, sum(hit) / sum(re) as accuracy, avg(pr) as pm, avg(rc) as rm, avg(f1) as fm, sum(f1 * re) / sum(re) as fw from f group by 1),
 a as (select lang, -avg(case when t = 1 then ln(greatest(p, 1e-15)) else ln(1 - least(p, 1 - 1e-15)) end) as ll, count(*) filter (t = 1) as n1, count(*) filter (t = 0) as n0 from x group by 1),
 rk as (select lang, sum(case when t = 1 then r + (n - 1) / 2 else 0 end) as s from (select *, rank() over (partition by lang order by p) as r, count(*) over (partition by lang, p) as n from x) group by 1)
select lang, round(accuracy, 6) as accuracy, round(pm, 6) as precision_macro, round(rm, 6) as recall_macro, round(fm, 6) as f1_macro, round(fw, 6) as f1_weighted, round(ll, 5) as log_loss, round((s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) as roc_auc from o join a using (lang) join rk using (lang)""")
def a24_classification_metrics(spark, d):
    """Long texts taken for good ones, against the labels, by language."""
    x = X.table(spark, d, "documents").join(X.table(spark, d, "labels").where("quality is not null"), "doc_id")
    x = x.select("lang", F.col("quality").alias("t"), (F.col("n_chars") >= 2000).cast("int").alias("g"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 4000), 6).alias("p"))
    return r(M.classification_metrics(x, "lang", "t", "g", "p"), "lang", log_loss=5)


@query(_EQ + f""", k as (select *, row_number() over (partition by portfolio order by ret, d) as rn, count(*) over (partition by portfolio) as n from q),
 g as (select portfolio, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 as ar, stddev_samp(ret) * sqrt(252) as vol, stddev_samp(ret - {(1.07 ** (1 / 252) - 1)!r}) filter (ret < {(1.07 ** (1 / 252) - 1)!r}) * sqrt(252) as down, min(dd) as mdd,
  max(ret) filter (rn = floor(n * 0.05) + 1) as v95, avg(ret) filter (rn <= floor(n * 0.05) + 1) as c95, max(ret) filter (rn = floor(n * 0.01) + 1) as v99, avg(ret) filter (rn <= floor(n * 0.01) + 1) as c99, max(ret) as best_day, min(ret) as worst_day,
  avg((ret > 0)::int) as win_rate, avg(ret) filter (ret > 0) as avg_win, avg(ret) filter (ret < 0) as avg_loss, skewness(ret) as skew, kurtosis(ret) as kurt, exp(sum(ln(1 + ret))) * 1000000 as final, exp(sum(ln(1 + ret)) - ln(1 + arg_min(ret, d))) - 1 as total from k group by 1)
select portfolio, round(ar, 6) as annualised_return, round(vol, 6) as annualised_volatility, round((ar - 0.07) / vol, 5) as sharpe_ratio, round((ar - 0.07) / down, 5) as sortino_ratio, round(mdd, 6) as max_drawdown, round(ar / abs(mdd), 5) as calmar_ratio,
 round(v95, 6) as var_95, round(c95, 6) as cvar_95, round(v99, 6) as var_99, round(c99, 6) as cvar_99, best_day, worst_day, round(win_rate, 6) as win_rate, round(avg_win, 6) as avg_win, round(avg_loss, 6) as avg_loss, round(avg_win / abs(avg_loss), 5) as profit_loss_ratio,
 round(skew, 5) as skewness, round(kurt, 5) as excess_kurtosis, round(final, 0) as final_value, round(total, 6) as total_return, 0.07::double as risk_free_rate from g""")
def f11_backtest_metrics(spark, d):
    x = X.portfolio_returns(spark, d)
    return r(T.backtest_metrics(x), "portfolio", "best_day", "worst_day", "risk_free_rate", sharpe_ratio=5, sortino_ratio=5, calmar_ratio=5, profit_loss_ratio=5, skewness=5, excess_kurtosis=5, final_value=0)


@query(f"""with {X.RETURNS}, {X.WEIGHTS}, {X.SECTORS}, m as (select symbol, avg(ret) * 252 as ar from returns group by 1), c as (select portfolio, symbol, sector, weight, ar, weight * ar as contribution from weights join m using (symbol) left join sectors using (symbol))
select portfolio, symbol, coalesce(sector, 'UNKNOWN') as sector, round(weight, 6) as weight, round(ar, 5) as annualised_return, round(contribution, 6) as contribution, round(contribution / sum(contribution) over (partition by portfolio) * 100, 3) as contribution_pct from c""")
def f12_attribution(spark, d):
    m = X.returns(spark, d).groupBy("symbol").agg((F.avg("ret") * 252).alias("annualised_return"))
    x = X.weights(spark, d).join(m, "symbol").join(X.sectors(spark, d), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))
    x = x.withColumn("contribution", F.col("weight") * F.col("annualised_return"))
    x = x.withColumn("contribution_pct", F.col("contribution") / F.sum("contribution").over(Window.partitionBy("portfolio")) * 100)
    return r(x, "portfolio", "symbol", "sector", annualised_return=5, contribution_pct=3)


@query(f"with {P} select a.portfolio as a, b.portfolio as b, count(*) as days, round(corr(a.ret, b.ret), 6) as corr from pret a join pret b on a.d = b.d and a.portfolio < b.portfolio group by 1, 2")
def f13_strategy_correlation(spark, d):
    x = X.portfolio_returns(spark, d).withColumnRenamed("portfolio", "symbol")
    return T.correlation_pairs(x).select("a", "b", "days", F.round("corr", 6).alias("corr"))


@query(f"with {P} select a.portfolio as a, b.portfolio as b, round(covar_samp(a.ret, b.ret) * 252, 7) as cov, round(covar_samp(a.ret, b.ret) / var_samp(b.ret), 6) as beta from pret a join pret b on a.d = b.d group by 1, 2")
def a07_covariance(spark, d):
    """Annual covariance matrix of the portfolios, and the beta of each to each other."""
    x = X.portfolio_returns(spark, d)
    y = x.select("d", F.col("portfolio").alias("b"), F.col("ret").alias("y"))
    cov = F.covar_samp("ret", "y")
    return x.join(y, "d").groupBy(F.col("portfolio").alias("a"), "b").agg(F.round(cov * 252, 7).alias("cov"), F.round(cov / F.var_samp("y"), 6).alias("beta"))


@query(f"""with {P}, m as (select portfolio, avg(ret) as m, stddev_samp(ret) as s from pret group by 1)
select portfolio, round(avg(((ret - m) / s) ** 3), 6) as skew, round(avg(((ret - m) / s) ** 4) - 3, 6) as excess_kurtosis from pret join m using (portfolio) group by 1""")
def a11_plain_moments(spark, d):
    x = T.moments(X.portfolio_returns(spark, d))
    return x.select("portfolio", F.round("skew_sample", 6).alias("skew"), F.round(F.col("kurt_sample") - 3, 6).alias("excess_kurtosis"))


_QUARTERS = """e as (select p_brand as symbol, cast(date_trunc('quarter', l_shipdate) as date) as q, round(sum(l_extendedprice), 2) as revenue, round(sum(l_extendedprice * (l_discount - 0.05)), 2) as profit from lineitem join part on l_partkey = p_partkey group by 1, 2),
 o as (select *, row_number() over (partition by symbol order by q) as i, count(*) over (partition by symbol) as n, lag(revenue) over w as r1, lag(profit) over w as p1, lag(revenue, 3) over w as r3, lag(profit, 3) over w as p3, first_value(revenue) over w as r0, first_value(profit / revenue) over w as m0,
  avg(profit / revenue * 100) over w as am, avg((profit > 0)::int) over w as pq from e window w as (partition by symbol order by q))"""


@query(f"""with {_QUARTERS} select symbol, n as quarters, round(profit / revenue * 100, 4) as margin, round((revenue - r1) / r1 * 100, 4) as qoq_revenue, round((profit - p1) / p1 * 100, 3) as qoq_profit, round((revenue - r3) / r3 * 100, 4) as yoy_revenue, round((profit - p3) / p3 * 100, 3) as yoy_profit,
 round(am, 5) as mean_margin, case when profit / revenue > m0 then 'improving' else 'declining' end as trend, round(pq * 100, 4) as consistency, round((pow(revenue / r0, 4.0 / (n - 1)) - 1) * 100, 4) as cagr from o where i = n and n >= 4""")
def a13_earnings(spark, d):
    """The last quarter against those before; "yoy" is three quarters back, as the reference has it."""
    x = X.table(spark, d, "lineitem").join(X.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.groupBy(F.col("p_brand").alias("symbol"), F.trunc(F.col("l_shipdate"), "quarter").alias("q")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 2).alias("profit"))
    g = x.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("q", "revenue", "profit"))).alias("s"), F.count("*").alias("n"), F.avg(F.col("profit") / F.col("revenue") * 100).alias("mean"), F.avg((F.col("profit") > 0).cast("double")).alias("pq")).where("n >= 4")
    at = lambda k, c: F.element_at("s", k)[c]
    growth = lambda c, k: (at(-1, c) - at(k, c)) / at(k, c) * 100
    margin = lambda k: at(k, "profit") / at(k, "revenue")
    return g.select(
        "symbol", F.col("n").alias("quarters"), F.round(margin(-1) * 100, 4).alias("margin"), F.round(growth("revenue", -2), 4).alias("qoq_revenue"), F.round(growth("profit", -2), 3).alias("qoq_profit"), F.round(growth("revenue", -4), 4).alias("yoy_revenue"), F.round(growth("profit", -4), 3).alias("yoy_profit"),
        F.round("mean", 5).alias("mean_margin"), F.when(margin(-1) > margin(1), "improving").otherwise("declining").alias("trend"), F.round(F.col("pq") * 100, 4).alias("consistency"), F.round((F.pow(at(-1, "revenue") / at(1, "revenue"), 4 / (F.col("n") - 1)) - 1) * 100, 4).alias("cagr"),
    )


@query("""with m as (select p_type as sector, round(avg(p_retailprice / p_size), 6) as pe, round(avg(p_retailprice), 6) as price, round(stddev_samp(p_retailprice), 6) as roe from part group by 1), u as (unpivot m on pe, price, roe into name metric value v)
select sector, metric, v, round(avg(v) over (partition by metric), 5) as mean, rank() over (partition by metric order by case when metric in ('pe', 'pb', 'debt_equity', 'p_e', 'p_b') then v else -v end) as rank from u""")
def a14_sector_comparison(spark, d):
    """Rank of each sector by each metric; lower is better for prices over earnings and the like."""
    m = X.table(spark, d, "part").groupBy(F.col("p_type").alias("sector")).agg(F.round(F.avg(F.col("p_retailprice") / F.col("p_size")), 6).alias("pe"), F.round(F.avg("p_retailprice"), 6).alias("price"), F.round(F.stddev_samp("p_retailprice"), 6).alias("roe"))
    u = m.unpivot("sector", ["pe", "price", "roe"], "metric", "v")
    better = F.when(F.col("metric").isin("pe", "pb", "debt_equity", "p_e", "p_b"), F.col("v")).otherwise(-F.col("v"))
    w = Window.partitionBy("metric")
    return u.select("sector", "metric", "v", F.round(F.avg("v").over(w), 5).alias("mean"), F.rank().over(w.orderBy(better)).cast("bigint").alias("rank"))


@query("""with m as (select event_type as model, case when avg(value) > 20 then 'high' when avg(value) > 10 then 'critical' else 'low' end as drift_severity, round(abs(avg(value) filter (user_id % 2 = 0) / avg(value) - 1) * 4, 3) as performance_drop,
 cast(min(ts) as date) as last_retrained, count(*) * 12 as predictions from events group by 1), w as (select *, date_diff('day', last_retrained, date '2024-01-31') as days_since,
 list_filter([case when drift_severity in ('high', 'critical') then 'drift severity: ' || drift_severity end, case when performance_drop > 0.1 then printf('performance drop: %.1f%%', performance_drop * 100) end,
 case when date_diff('day', last_retrained, date '2024-01-31') > 30 then 'days since retrain: ' || date_diff('day', last_retrained, date '2024-01-31') || ' > 30' end, case when predictions > 10000 then 'predictions since retrain: ' || predictions || ' > 10000' end], lambda x: x is not null) as why from m)
select model, days_since::int as days_since, predictions, len(why) > 0 as should_retrain, case when len(why) > 0 then array_to_string(why, '; ') else 'No triggers met' end as reason from w""")
def x10_retraining(spark, d):
    """A kind of event as a model, each event as twelve predictions."""
    v = F.col("value")
    drift = F.when(F.avg(v) > 20, "high").when(F.avg(v) > 10, "critical").otherwise("low")
    m = X.table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(
        drift.alias("drift_severity"), F.round(F.abs(F.avg(F.when(F.col("user_id") % 2 == 0, v)) / F.avg(v) - 1) * 4, 3).alias("performance_drop"),
        F.min("ts").cast("date").alias("last_retrained"), (F.count("*") * 12).alias("predictions"),
    )
    return M.retraining_decisions(m, "2024-01-31").select("model", "days_since", "predictions", "should_retrain", "reason")
