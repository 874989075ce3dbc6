"""Queries: stores, sessions, filters, set operations and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators.retrieval import best_by_prefix, cosine_search, cosine_top_k, last_of_group
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query
from ledgerlark.streaming.rollup import daily_bars_stream, first_of_key, hourly_rollup, latest_of_key, request_counts, run_to_end, sessions


@query("select event_type, count(*) as n from events group by 1")
def a02_event_counts(spark, d):
    return X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""with {X.RETURNS} select symbol, cast(date_trunc('month', d) as date) as m, round(product(1 + ret) - 1, 6) as ret from returns group by 1, 2""")
def a06_monthly_returns(spark, d):
    r = X.returns(spark, d).groupBy("symbol", F.trunc("d", "MM").alias("m"))
    return r.agg(F.round(F.product(1 + F.col("ret")) - 1, 6).alias("ret"))


@query(f"""with {X.HOLDINGS} select user_id, symbol, round(current_value - quantity * avg_cost, 2) as pnl,
 round(case when quantity * avg_cost > 0 then (current_value - quantity * avg_cost) / (quantity * avg_cost) * 100 else 0 end, 4) as pnl_pct,
 round(case when sum(current_value) over w > 0 then current_value / sum(current_value) over w else 0 end, 6) as weight from holdings window w as (partition by user_id)""")
def p03_holding_detail(spark, d):
    cost, total = F.col("quantity") * F.col("avg_cost"), F.sum("current_value").over(Window.partitionBy("user_id"))
    pnl = F.col("current_value") - cost
    return X.holdings(spark, d).select(
        "user_id",
        "symbol",
        F.round(pnl, 2).alias("pnl"),
        F.round(F.when(cost > 0, pnl / cost * 100).otherwise(0.0), 4).alias("pnl_pct"),
        F.round(F.when(total > 0, F.col("current_value") / total).otherwise(0.0), 6).alias("weight"),
    )


@query("select event_id, user_id, value from events where event_type in ('purchase', 'click') and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def p08_episode_filter(spark, d):
    e = X.table(spark, d, "events").where(F.col("event_type").isin("purchase", "click") & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-10'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-20'")))
    return e.select("event_id", "user_id", "value")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def p12_page(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def p13_json_field(spark, d):
    return X.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("select event_id, least(1, greatest(0, round(value / 490 + 0.25, 9))) as importance from events")
def k08_clamped_update(spark, d):
    return X.table(spark, d, "events").select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.col("value") / 490 + 0.25, 9))).alias("importance"))


@query("""with t as (select doc_id, sha256(coalesce(text, '')) as checksum from documents) select doc_id, checksum from t where checksum not in (select checksum from t join labels using (doc_id))""")
def j11_not_stored(spark, d):
    """Documents whose checksum no labelled document has."""
    t = X.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    stored = t.join(X.table(spark, d, "labels").select("doc_id"), "doc_id").select("checksum")
    return t.join(stored, "checksum", "left_anti").select("doc_id", "checksum")


@query(f"""with {X.WEIGHTS}, a as (select symbol, weight from weights where portfolio = 'BUILDING' and weight > 0.04), b as (select symbol, weight from weights where portfolio = 'MACHINERY' and weight > 0.04)
 select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.weight, 0) as current, coalesce(b.weight, 0) as target, round(coalesce(b.weight, 0) - coalesce(a.weight, 0), 9) as change
 from a full join b on a.symbol = b.symbol""")
def j03_weight_drift(spark, d):
    w = X.weights(spark, d).where("weight > 0.04")
    a = w.where("portfolio = 'BUILDING'").select("symbol", F.col("weight").alias("a"))
    x = a.join(w.where("portfolio = 'MACHINERY'").select("symbol", F.col("weight").alias("b")), "symbol", "full")
    now, then = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return x.select("symbol", now.alias("current"), then.alias("target"), F.round(then - now, 9).alias("change"))


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 50")
def w39_last_messages(spark, d):
    return last_of_group(X.table(spark, d, "conversations"), "conv_id", "turn", 50).select("conv_id", "turn", "role", "text")


@query("""select doc_id, n_chars from documents where text is not null
 qualify row_number() over (partition by substring(trim(text), 1, 200) order by n_chars desc, doc_id) = 1""")
def u03_best_by_prefix(spark, d):
    return best_by_prefix(X.table(spark, d, "documents"), "text", [F.desc("n_chars"), F.col("doc_id")], 200).select("doc_id", "n_chars")


@query("""with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 0)
 select vec_id, round(list_cosine_similarity(cast(embedding as double[]), q), 6) as similarity from embeddings, q where vec_id <> 0
 order by list_cosine_similarity(cast(embedding as double[]), q) desc, vec_id limit 10""")
def o01_vector_top_k(spark, d):
    e = X.table(spark, d, "embeddings")
    asked = e.where("vec_id = 0").first().embedding
    return cosine_top_k(e.where("vec_id != 0"), "vec_id", "embedding", asked, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
 s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 9) as c from e q, e where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)
 select query_id, vec_id, round(c, 6) as similarity from s qualify row_number() over (partition by query_id order by c desc, vec_id) <= 10""")
def o01_vector_search(spark, d):
    """Every row whose id is divisible by 100 against all rows; ``o01_vector_top_k`` asks for one."""
    e = X.table(spark, d, "embeddings")
    return cosine_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2
 having hour + interval 1 hour <= (select max(ts) - interval 1 hour from events)""")
def x01_hourly_rollup(spark, d):
    schema = X.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return run_to_end(hourly_rollup(events)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _stream(spark, d, name):
    return spark.readStream.schema(X.table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("""with t as (select o_orderstatus as symbol, o_orderdate as ts, o_orderkey as seq, o_totalprice as price from orders)
select symbol, cast(ts as date) as d, arg_min(price, (ts, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, seq)) as "close", count(*)::double as volume from t group by 1, 2
having cast(ts as date) + interval 1 day <= (select max(ts) - interval 3 day from t)""")
def x01_daily_bars_stream(spark, d):
    """A continuous aggregate of daily bars; the last three days are still open. Prices are orders by status."""
    o = _stream(spark, d, "orders")
    return run_to_end(daily_bars_stream(o.select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))))


@query("select event_id, user_id from events")
def x03_idempotent_stream(spark, d):
    """Every event delivered twice counts once."""
    e = _stream(spark, d, "events")
    return run_to_end(first_of_key(e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again"), ["event_id"]).select("event_id", "user_id"))


@query("""with l as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 24 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from l)
select user_id, min(ts) as started, max(ts) as last_active, count(*) as turns from s group by user_id, k having max(ts) + interval 24 hour <= (select max(ts) - interval 1 hour from events)""")
def x04_sessions(spark, d):
    x = run_to_end(sessions(_stream(spark, d, "events")))
    return x.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last_active").cast("timestamp_ntz").alias("last_active"), "turns")


@query("""with w as (select user_id, time_bucket(interval 10 second, ts) - interval 10 second * k as start from events, range(0, 6) t(k))
select user_id, start, count(*) as n, count(*) > 100 as limited from w group by 1, 2 having start + interval 60 second <= (select max(ts) - interval 1 minute from events)""")
def x05_request_counts(spark, d):
    x = run_to_end(request_counts(_stream(spark, d, "events")))
    return x.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as updates from events group by 1")
def x07_latest_status(spark, d):
    """The latest event of a user as the status of a query."""
    return latest_of_key(_stream(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"])


@query("""select conv_id, count(*) as chunks, max(turn) as last_chunk, arg_max(role, turn) = 'assistant' as done, sum(length(coalesce(text, ''))) as n_chars, count(*) = max(turn) - min(turn) + 1 as whole from conversations group by 1""")
def x06_chunk_log(spark, d):
    """Chunks of each session in their order: the last one and whether it ends the answer, characters, and whether no number is missing."""
    t = F.col("turn")
    x = X.table(spark, d, "conversations").groupBy("conv_id")
    return x.agg(F.count("*").alias("chunks"), F.max(t).alias("last_chunk"), (F.max_by("role", t) == "assistant").alias("done"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), (F.count("*") == F.max(t) - F.min(t) + 1).alias("whole"))
