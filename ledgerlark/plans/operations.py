"""Queries: filters, joins, rankings, set operations, stores and memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions.filters import build_filter
from ledgerlark.functions.vectors import cosine
from ledgerlark.operators import bars as B
from ledgerlark.operators.retrieval import last_of_group
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query


@query("select doc_id, source, n_chars from documents where (lang in ('en', 'de') and n_chars > 500 and n_chars <= 5000) or (source <> 'web' and n_chars < 300)")
def p01_filter_dsl(spark, d):
    asked = {"$or": [{"$and": [{"lang": {"$in": ["en", "de"]}}, {"n_chars": {"$gt": 500, "$lte": 5000}}]}, {"source": {"$ne": "web"}, "n_chars": {"$lt": 300}}]}
    x = X.table(spark, d, "documents")
    return x.where(build_filter(asked, x.schema)).select("doc_id", "source", "n_chars")


@query("select doc_id, n_chars from documents where lang in ('en', 'fr') and n_chars >= 1000")
def p02_where_builder(spark, d):
    """A list means any of its values; an operator that is not known is skipped."""
    x = X.table(spark, d, "documents")
    return x.where(build_filter({"lang": ["en", "fr"], "n_chars": {"$gte": 1000, "$like": "%"}}, x.schema, strict=False)).select("doc_id", "n_chars")


@query(f"""with {X.RETURNS}, {X.WEIGHTS}, i as (select * from returns where d between date '1998-01-01' and date '1998-12-31'), k as (select symbol from i group by 1 having count(*) >= 20)
select portfolio, symbol, round(weight / sum(weight) over (partition by portfolio), 6) as weight from weights where symbol in (select symbol from k)""")
def p07_period_weights(spark, d):
    r = X.returns(spark, d).where("d between date'1998-01-01' and date'1998-12-31'").groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 20")
    w = X.weights(spark, d).join(r, "symbol", "left_semi")
    return w.select("portfolio", "symbol", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("portfolio")), 6).alias("weight"))


_MEM = """m as (select event_id as id, user_id, ts, round(value / 500, 6) as importance, [event_type, 'u' || (user_id % 5)] as tags, event_type as kind from events)"""


def memories(spark, d):
    """id, user_id, ts, importance, tags, kind: events as memories."""
    e = X.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", F.round(F.col("value") / 500, 6).alias("importance"), F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("tags"), F.col("event_type").alias("kind"))


@query(f"with {_MEM} select user_id, id, importance from m where list_has_any(tags, ['u1', 'refund']) qualify row_number() over (partition by user_id order by importance desc, ts desc) <= 5")
def p09_tag_overlap(spark, d):
    x = memories(spark, d).where(F.arrays_overlap("tags", F.array(F.lit("u1"), F.lit("refund"))))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("ts")))
    return x.withColumn("k", k).where("k <= 5").select("user_id", "id", "importance")


@query(f"with {_MEM} select user_id, id from m where kind = 'purchase' qualify row_number() over (partition by user_id order by importance desc, ts desc) <= 20")
def m11_memories_of_kind(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("ts")))
    return memories(spark, d).where("kind = 'purchase'").withColumn("k", k).where("k <= 20").select("user_id", "id")


@query(f"with {_MEM} select id, round(0.6 * ((id * 37) % 100) / 100 + 0.4 * importance, 6)::double as score from m order by 0.6 * ((id * 37) % 100) / 100 + 0.4 * importance desc, id limit 25")
def a21_memory_score(spark, d):
    """0.6 of a similarity (made up from ids) and 0.4 of importance; the 25 best."""
    score = F.lit(0.6) * (F.col("id") * 37 % 100) / 100 + 0.4 * F.col("importance")
    return memories(spark, d).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)


@query(f"with {X.HOLDINGS}, x as (select user_id, symbol, (current_value - quantity * avg_cost) / (quantity * avg_cost) * 100 as pct from holdings) select user_id, symbol, case when pct < -50 then 'high' else 'medium' end as severity from x where pct < -50 or pct > 200")
def p10_extreme_pnl(spark, d):
    x = X.holdings(spark, d)
    cost = F.col("quantity") * F.col("avg_cost")
    x = x.withColumn("pct", (F.col("current_value") - cost) / cost * 100)
    return x.where("pct < -50 or pct > 200").select("user_id", "symbol", F.when(F.col("pct") < -50, "high").otherwise("medium").alias("severity"))


@query("""select c_custkey as user_id, c_mktsegment as pref, coalesce(o.last, []) as last_orders, coalesce(n, 0) as orders from customer left join (select o_custkey, count(*) as n, list(o_orderkey order by o_orderdate desc, o_orderkey desc)[1:10] as last from orders group by 1) o on o_custkey = c_custkey""")
def p15_context_profile(spark, d):
    """A user's preference, last ten orders and their number; the lists are cut to ten rows a user before they are gathered."""
    o = X.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("k", F.row_number().over(w)).where("k <= 10").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("last"))
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    x = X.table(spark, d, "customer").join(last.join(n, "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("pref"), F.coalesce("last", F.expr("array()").cast("array<bigint>")).alias("last_orders"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("select l_orderkey, l_linenumber, o_orderdate from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 49")
def j01_chunks_with_documents(spark, d):
    x = X.table(spark, d, "lineitem").where("l_quantity >= 49").join(X.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("l_orderkey", "l_linenumber", "o_orderdate")


@query(f"with {X.RETURNS}, b as (select d, round(avg(ret), 9) as b from returns group by 1 having count(*) >= 20), k as (select symbol, count(*) as days, round(sum(ret * b), 8) as product from returns join b using (d) where ret is not null group by 1) select * from k where days >= 20")
def j04_with_benchmark(spark, d):
    r = X.returns(spark, d)
    b = r.groupBy("d").agg(F.round(F.avg("ret"), 9).alias("b"), F.count("*").alias("n")).where("n >= 20")
    return r.where("ret is not null").join(b, "d").groupBy("symbol").agg(F.count("*").alias("days"), F.round(F.sum(F.col("ret") * F.col("b")), 8).alias("product")).where("days >= 20")


@query(f"with {X.RETURNS}, {X.WEIGHTS} select portfolio, symbol, count(*) as days, round(sum(weight * ret), 7) as contribution from returns join weights using (symbol) group by 1, 2")
def j05_weights_with_returns(spark, d):
    x = X.returns(spark, d).join(X.weights(spark, d), "symbol")
    return x.groupBy("portfolio", "symbol").agg(F.count("*").alias("days"), F.round(F.sum(F.col("weight") * F.col("ret")), 7).alias("contribution"))


@query(f"with {X.SECTORS}, s as (select * from sectors where symbol < 'Brand#4') select p_partkey, coalesce(sector, 'UNKNOWN') as sector from part left join s on symbol = p_brand")
def j06_sector_lookup(spark, d):
    """Brands of which the dimension knows nothing get the default."""
    return X.table(spark, d, "part").join(X.sectors(spark, d).where("symbol < 'Brand#4'"), F.col("p_brand") == F.col("symbol"), "left").select("p_partkey", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"))


@query(f"with {X.WEIGHTS}, s(scenario, shock) as (values ('crash', -35.0::double), ('correction', -10.0), ('panic', -15.0)) select portfolio, symbol, scenario, round(weight * shock, 9) as impact from weights, s")
def j07_scenarios_by_holding(spark, d):
    shocks = F.create_map(*(F.lit(v) for kv in (("crash", -35.0), ("correction", -10.0), ("panic", -15.0)) for v in kv))
    return X.weights(spark, d).select("portfolio", "symbol", F.explode(shocks).alias("scenario", "shock"), "weight").select("portfolio", "symbol", "scenario", F.round(F.col("weight") * F.col("shock"), 9).alias("impact"))


@query(f"with {X.RETURNS} select a.symbol as a, b.symbol as b, count(*) as days, round(avg(abs(a.ret - b.ret)), 8) as gap from returns a join returns b on a.d = b.d and a.symbol < b.symbol group by 1, 2")
def j08_pairs(spark, d):
    r = X.returns(spark, d)
    a, b = r.select("d", F.col("symbol").alias("a"), F.col("ret").alias("x")), r.select("d", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "d").where("a < b").groupBy("a", "b").agg(F.count("*").alias("days"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 8).alias("gap"))


@query(f"with {X.HOLDINGS}, {X.PRICES}, p as (select symbol, arg_max(px, d) as px from prices group by 1) select user_id, symbol, round((px - avg_cost) * quantity, 4) as pnl from holdings join p using (symbol)")
def j09_holdings_with_prices(spark, d):
    p = X.prices(spark, d).groupBy("symbol").agg(F.max_by("px", "d").alias("px"))
    return X.holdings_in_order(spark, d).join(p, "symbol").select("user_id", "symbol", F.round((F.col("px") - F.col("avg_cost")) * F.col("quantity"), 4).alias("pnl"))


@query("select 'page' as kind, page_id as id, length(html) as n from pages union all select 'document', doc_id, length(text) from documents union all select 'item', item_id, length(text) from benchmark")
def j10_collections(spark, d):
    """Several collections as one."""
    from ledgerlark.sources.files import union_of

    parts = (("page", "pages", "page_id", "html"), ("document", "documents", "doc_id", "text"), ("item", "benchmark", "item_id", "text"))
    return union_of([X.table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.length(c).cast("bigint").alias("n")) for k, t, i, c in parts])


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def j12_semi_join(spark, d):
    return X.table(spark, d, "customer").join(X.table(spark, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_ALIGNED = f"with {X.RETURNS}, i as (select *, row_number() over (partition by symbol order by d) as h, row_number() over (partition by symbol order by d desc) as t from returns), n as (select min(c) as n from (select count(*) as c from returns group by symbol))"


@query(_ALIGNED + " select symbol, count(*) filter (h <= n) as kept, round(sum(ret) filter (h <= n), 7) as head, round(sum(ret) filter (t <= n), 7) as tail from i, n group by 1")
def j13_aligned_series(spark, d):
    """Series cut to the shortest one's length, from their heads and from their tails."""
    r = X.returns(spark, d)
    n = r.groupBy("symbol").agg(F.count("*").alias("c")).agg(F.min("c").alias("n"))
    w = Window.partitionBy("symbol")
    x = r.withColumn("h", F.row_number().over(w.orderBy("d"))).withColumn("t", F.row_number().over(w.orderBy(F.desc("d")))).join(F.broadcast(n))  # one row
    part = lambda c: F.round(F.sum(F.when(F.col(c) <= F.col("n"), F.col("ret"))), 7)
    return x.groupBy("symbol").agg(F.count_if(F.col("h") <= F.col("n")).alias("kept"), part("h").alias("head"), part("t").alias("tail"))


@query(f"with {X.RETURNS}, m as (select max(d) as m from returns) select symbol, d, ret from returns, m where symbol in ('Brand#11', 'Brand#22', 'Brand#33') and d > m - interval 1 year")
def j14_symbols_of_a_year(spark, d):
    r = X.returns(spark, d)
    m = r.agg(F.add_months(F.max("d"), -12).alias("since"))
    return r.where(F.col("symbol").isin("Brand#11", "Brand#22", "Brand#33")).join(F.broadcast(m), F.col("d") > F.col("since")).select("symbol", "d", "ret")


@query("select 'events' as name, count(*) as n, count(distinct user_id) as users from events union all select 'conversations', count(*), count(distinct conv_id) from conversations union all select 'documents', count(*), count(distinct source) from documents")
def a03_counts(spark, d):
    one = lambda t, c: X.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.countDistinct(c).alias("users"))
    return one("events", "user_id").unionByName(one("conversations", "conv_id")).unionByName(one("documents", "source"))


_AGENTS = "a as (select user_id, event_type as agent, value < 450 as ok, round(value / 500, 6) as confidence, list_distinct([event_type, 'all']) as sources from events)"


@query(f"with {_AGENTS} select user_id, round(case when bool_or(not ok) then least(0.2, coalesce(avg(confidence) filter (ok), 0)) else avg(confidence) end, 6) as confidence, list_sort(list_distinct(flatten(list(sources)))) as sources from a group by 1")
def a19_confidence(spark, d):
    """Mean over the agents that answered, at most 0.2 if one did not; the union of their sources."""
    e = X.table(spark, d, "events")
    ok, c = F.col("value") < 450, F.round(F.col("value") / 500, 6)
    g = e.groupBy("user_id").agg(F.bool_or(~ok).alias("down"), F.avg(F.when(ok, c)).alias("m"), F.collect_set("event_type").alias("s"))  # as many as there are types
    m = F.coalesce("m", F.lit(0.0))
    return g.select("user_id", F.round(F.when(F.col("down"), F.least(F.lit(0.2), m)).otherwise(m), 6).alias("confidence"), F.array_sort(F.array_union("s", F.array(F.lit("all")))).alias("sources"))


@query("select event_id, round(0.25 * r + 0.25 * a + 0.15 * k + 0.15 * c + 0.20 * u, 4)::double as score, round(0.25 * r + 0.25 * a + 0.15 * k + 0.15 * c + 0.20 * u, 4) >= 0.5 as passes from (select event_id, (event_id % 10) / 10 as r, (event_id % 7) / 7 as a, (event_id % 5) / 5 as k, (event_id % 3) / 3 as c, (user_id % 9) / 9 as u from events)")
def a20_quality_score(spark, d):
    """Five dimensions by weight, and whether the score reaches a threshold."""
    part = lambda c, n: F.col(c) % n / n
    score = F.round(0.25 * part("event_id", 10) + 0.25 * part("event_id", 7) + 0.15 * part("event_id", 5) + 0.15 * part("event_id", 3) + 0.20 * part("user_id", 9), 4)
    return X.table(spark, d, "events").select("event_id", score.alias("score"), (score >= 0.5).alias("passes"))


@query("select o_orderkey, o_orderpriority from orders order by case left(o_orderpriority, 1) when '1' then 3 when '2' then 2 else 1 end desc, o_orderkey limit 100")
def o04_ordinal_sort(spark, d):
    rank = F.when(F.left("o_orderpriority", F.lit(1)) == "1", 3).when(F.left("o_orderpriority", F.lit(1)) == "2", 2).otherwise(1)
    return X.table(spark, d, "orders").orderBy(rank.desc(), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, -o_totalprice, o_orderkey) as place from orders")
def o05_trade_order(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return X.table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"with {X.RETURNS}, z as (select symbol, d, round(abs(ret - avg(ret) over (partition by symbol)) / stddev_pop(ret) over (partition by symbol), 6) as z from returns) select symbol, max(z) as worst from z group by 1 order by max(z) desc, symbol limit 3")
def o08_most_anomalous(spark, d):
    w = Window.partitionBy("symbol")
    x = X.returns(spark, d).withColumn("z", F.round(F.abs(F.col("ret") - F.avg("ret").over(w)) / F.stddev_pop("ret").over(w), 6))
    return x.groupBy("symbol").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "symbol").limit(3).select("symbol", F.col("z").alias("worst"))


@query(f"with {X.RETURNS}, z as (select symbol, d, round(abs(ret - avg(ret) over (partition by symbol)) / stddev_pop(ret) over (partition by symbol), 6) as z from returns) select symbol, d, z, z > 1.5 as odd from z")
def m01_z_flags(spark, d):
    w = Window.partitionBy("symbol")
    z = F.round(F.abs(F.col("ret") - F.avg("ret").over(w)) / F.stddev_pop("ret").over(w), 6)
    return X.returns(spark, d).withColumn("z", z).select("symbol", "d", "z", (F.col("z") > 1.5).alias("odd"))


@query(f"with {X.WEIGHTS}, s(scenario, shock) as (values ('crash', -35.0::double), ('panic', -15.0)), i as (select portfolio, scenario, symbol, round(weight * shock, 9) as impact from weights, s), t as (select portfolio, scenario, sum(impact) as loss, arg_min(symbol, (impact, symbol)) as worst_holding from i group by 1, 2) select portfolio, arg_min(scenario, (loss, scenario)) as worst_scenario, arg_min(worst_holding, (loss, scenario)) as worst_holding from t group by 1")
def o09_worst_scenario(spark, d):
    shocks = F.create_map(*(F.lit(v) for kv in (("crash", -35.0), ("panic", -15.0)) for v in kv))
    i = X.weights(spark, d).select("portfolio", "symbol", "weight", F.explode(shocks).alias("scenario", "shock")).withColumn("impact", F.round(F.col("weight") * F.col("shock"), 9))
    t = i.groupBy("portfolio", "scenario").agg(F.sum("impact").alias("loss"), F.min_by("symbol", F.struct("impact", "symbol")).alias("h"))
    o = F.struct("loss", "scenario")
    return t.groupBy("portfolio").agg(F.min_by("scenario", o).alias("worst_scenario"), F.min_by("h", o).alias("worst_holding"))


@query("select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 50")
def o10_first_of_feed(spark, d):
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return X.table(spark, d, "documents").withColumn("k", k).where("k <= 50").select("source", "doc_id")


@query("select source, n_chars as chars, doc_id from documents where trim(coalesce(source, '')) <> '' qualify row_number() over (partition by source order by length(coalesce(text, '')) desc, doc_id) = 1")
def u02_longest_per_key(spark, d):
    return B.longest_per_key(X.table(spark, d, "documents"), "source", "text", "doc_id").select("source", F.col("n_chars").alias("chars"), "doc_id")


@query(f"with {X.WEIGHTS} select symbol, bool_or(portfolio = 'BUILDING') as a, bool_or(portfolio = 'MACHINERY') as b from weights where (portfolio = 'BUILDING' and symbol < 'Brand#4') or (portfolio = 'MACHINERY' and symbol > 'Brand#2') group by 1")
def u05_key_union(spark, d):
    """The keys of two maps, and which has each."""
    w = X.weights(spark, d)
    a = w.where("portfolio = 'BUILDING' and symbol < 'Brand#4'").select("symbol", F.lit(True).alias("a"))
    x = a.join(w.where("portfolio = 'MACHINERY' and symbol > 'Brand#2'").select("symbol", F.lit(True).alias("b")), "symbol", "full_outer")
    return x.select("symbol", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))


@query("select user_id, list_sort(list_distinct(list(event_type))) as kinds from events group by 1")
def u08_unique_extend(spark, d):
    """Lists joined in order, each element once (sorted here, as rows have no order)."""
    return X.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("with n as (select doc_id, sha256(coalesce(text, '')) as c from documents where doc_id >= 500), o as (select sha256(coalesce(text, '')) as c from documents where doc_id < 500) select doc_id from n where c not in (select c from o)")
def u09_new_checksums(spark, d):
    x = X.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("c"))
    return x.where("doc_id >= 500").join(x.where("doc_id < 500"), "c", "left_anti").select("doc_id")


@query("""select id, lang, case when id % 2 = 0 then upper(coalesce(lang, '')) else source end as source from (select doc_id as id, lang, source from documents)""")
def k02_upsert_articles(spark, d):
    """New rows give every second document a source and no language; the language stays where the new one is null."""
    old = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    new = old.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("lang"), F.upper(F.coalesce("lang", F.lit(""))).alias("source"))
    return B.upsert(old, new, ["id"], fill=["lang"])


@query("select sha256(coalesce(text, '')) as checksum, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def k04_checksum_ingest(spark, d):
    """One row of each checksum in a batch."""
    return X.table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def k06_delete_by_ids(spark, d):
    gone = X.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return X.table(spark, d, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("select event_id, date_diff('day', cast(ts as date), date '2024-03-01') as age from events where date_diff('day', cast(ts as date), date '2024-03-01') > 45 order by ts limit 500")
def k11_stale(spark, d):
    age = F.datediff(F.lit("2024-03-01"), F.col("ts").cast("date"))
    return X.table(spark, d, "events").withColumn("age", age).where("age > 45").orderBy("ts").limit(500).select("event_id", "age")


@query("with v as (select p_brand as model, 'v' || p_size as version, p_partkey as id, p_type as status from part) select model, count(*) as versions, max(substring(version, 2)::int) as latest, list_sort(list_distinct(list(status))) as statuses from v group by 1")
def k14_model_registry(spark, d):
    """Versions of each model, the greatest number (not text), and their states."""
    p = X.table(spark, d, "part").select(F.col("p_brand").alias("model"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("version"), F.col("p_type").alias("status"))
    return p.groupBy("model").agg(F.count("*").alias("versions"), F.max(F.substring("version", 2, 20).cast("int")).alias("latest"), F.array_sort(F.collect_set("status")).alias("statuses"))


@query("select p_partkey, split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.' || (split_part(v, '.', 3)::int + 1) as next from (select p_partkey, '1.' || p_size || '.' || (p_partkey % 17) as v from part)")
def m29_version_bump(spark, d):
    v = F.split(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 17).cast("string")), r"\.")
    return X.table(spark, d, "part").select("p_partkey", F.concat_ws(".", v[0], v[1], (v[2].cast("int") + 1).cast("string")).alias("next"))


@query("select event_type, event_id, value from events qualify row_number() over (partition by event_type order by ts desc) <= 10")
def m33_history(spark, d):
    return last_of_group(X.table(spark, d, "events"), "event_type", "ts", 10).select("event_type", "event_id", "value")


@query(f"with {X.RETURNS} select symbol, count(ret) as n from returns group by 1 having count(ret) >= 30")
def m07_enough_returns(spark, d):
    return X.returns(spark, d).groupBy("symbol").agg(F.count("ret").alias("n")).where("n >= 30")


@query(f"with {X.RETURNS}, m as (select symbol, avg(ret) * 252 as ar from returns group by 1) select symbol, round(1.0 / count(*) over (), 9)::double as weight, round(avg(ar) over (), 6) as mean_return, null::double as risk from m")
def m06_equal_weight(spark, d):
    """Equal weights with the mean return and no risk; totals are one row, broadcast."""
    m = X.returns(spark, d).groupBy("symbol").agg((F.avg("ret") * 252).alias("ar"))
    t = m.agg(F.round(1 / F.count("*"), 9).alias("weight"), F.round(F.avg("ar"), 6).alias("mean_return"))
    return m.join(F.broadcast(t)).select("symbol", "weight", "mean_return", F.lit(None).cast("double").alias("risk"))


@query(f"with {X.PORTFOLIO_RETURNS} select portfolio, round(stddev_samp(ret) * sqrt(252), 6) as volatility from pret group by 1")
def m08_annual_volatility(spark, d):
    return X.portfolio_returns(spark, d).groupBy("portfolio").agg(F.round(F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), 6).alias("volatility"))


@query("select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n, count(*) filter (value <= 100) as le_100, count(*) filter (value <= 250) as le_250, round(sum(value), 4) as total from events group by 1, 2")
def x09_histograms(spark, d):
    """Counters and cumulative buckets by window."""
    e = X.table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 100).alias("le_100"), F.count_if(F.col("value") <= 250).alias("le_250"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, count(*) over w as n, count(*) over w > 100 as limited from events window w as (partition by user_id order by epoch(ts) range between 60 preceding and current row)")
def w40_rate_limit_60s(spark, d):
    """The reference's 100 requests in 60 seconds; ``w40_rate_limit`` has another window."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-60, 0)
    return X.table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), (F.count("*").over(w) > 100).alias("limited"))


_ALL_W = f"with {X.WEIGHTS}"


@query(_ALL_W + " select symbol, a.weight as current, b.weight as target, round(b.weight - a.weight, 9) as change from weights a join weights b using (symbol) where a.portfolio = 'BUILDING' and b.portfolio = 'MACHINERY'")
def j03_weight_drift_all(spark, d):
    """All weights of both portfolios; ``j03_weight_drift`` takes those over 0.04."""
    w = X.weights(spark, d)
    x = w.where("portfolio = 'BUILDING'").select("symbol", F.col("weight").alias("current")).join(w.where("portfolio = 'MACHINERY'").select("symbol", F.col("weight").alias("target")), "symbol", "full")
    x = x.na.fill(0.0, ["current", "target"])
    return x.select("symbol", "current", "target", F.round(F.col("target") - F.col("current"), 9).alias("change"))


@query("select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(c as double[])), 6) as similarity, label from embeddings join (select label, list(m order by k) as c from (select label, k, avg(v) as m from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as k from embeddings) group by 1, 2) group by 1) using (label)")
def r01_label_centroids(spark, d):
    """R1 against the mean vector of each label."""
    e = X.table(spark, d, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("m"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("similarity"), "label")
