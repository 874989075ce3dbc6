"""Queries: questions taken apart, reranked collections, contexts for a reader, and what is remembered of interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import interactions as I
from ledgerlark.functions import news as N
from ledgerlark.functions import text as T
from ledgerlark.operators import retrieval as R
from ledgerlark.operators import search as S
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query

_WORDS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9_]+'), lambda x: x <> '')"


def _bm25(name: str, asked: str, docs: str, key: str, k: int) -> str:
    """SQL: ``name`` (key, doc_id, score) holds the k best of ``docs`` for each row of ``asked`` (key, text)."""
    n = name
    return f"""{n}q as (select distinct {key}, unnest({_WORDS.format('text')}) as term from {asked}), {n}d as (select doc_id, unnest({_WORDS.format('text')}) as term from {docs}),
 {n}tf as (select doc_id, term, count(*) as tf from {n}d group by 1, 2), {n}dl as (select doc_id, sum(tf) as n from {n}tf group by 1), {n}st as (select count(*) as docs, avg(n) as mean from {n}dl),
 {n}df as (select term, count(*) as df from {n}tf group by 1),
 {n}bm as (select {key}, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from {n}q join {n}tf using (term) join {n}df using (term) join {n}dl using (doc_id), {n}st group by all),
 {name} as (select * from {n}bm qualify row_number() over (partition by {key} order by score desc, doc_id) <= {k})"""


def _unit(key: str) -> str:
    return f"coalesce((score - min(score) over (partition by {key})) / nullif(max(score) over (partition by {key}) - min(score) over (partition by {key}), 0), 1)"


def _docs(spark, d):
    return X.table(spark, d, "documents").where("doc_id is not null")


def _questions(spark, d):
    """item_id, text: benchmark items as questions, the even ones with two halves."""
    w = lambda i: F.array_join(F.slice(F.split("text", " "), i, 6), " ")
    two = F.concat(F.lit("What is "), w(1), F.lit(" and how does "), w(7), F.lit(" change?"))
    return X.table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, two).otherwise(w(1)).alias("text"))


_ASKED = r"""b as (select item_id, string_split(text, ' ') as w from benchmark), asked as (select item_id, case when item_id %% 2 = 0 then 'What is ' || array_to_string(w[1:6], ' ') || ' and how does ' || array_to_string(w[7:12], ' ') || ' change?' else array_to_string(w[1:6], ' ') end as text from b),
 pieces as (select * from (select item_id, text, list_filter(list_transform(string_split_regex(text, '%s'), lambda y: trim(y)), lambda y: length(y) > 10) as found from asked)),
 sub as (select item_id, unnest(range(0, len(p))) as place, unnest(p) as text from (select item_id, case when item_id %% 2 = 0 and len(found) >= 2 then found else [text] end as p from pieces))""" % N.CONJUNCTION


@query(f"""with {_ASKED}, docs as (select * from documents where doc_id is not null), {_bm25('f', "(select {'q': item_id, 'place': place} as sub, text from sub)", 'docs', 'sub', 10)},
 r as (select sub.q as item_id, sub.place as place, doc_id, {_unit('sub')} as score from f), g as (select r.*, substring(trim(coalesce(text, '')), 1, 300) as start from r join docs using (doc_id)),
 o as (select item_id, start, arg_min(doc_id, (place, -score, doc_id)) as doc_id, arg_min(score, (place, -score, doc_id)) as s, count(*) as n, count(distinct place) as parts from g group by 1, 2),
 e as (select item_id, doc_id, round(case when n > 1 then least(1, s + 0.05::double * (n - 1)) else s end, 6) as score, parts from o)
select item_id, doc_id, score, parts from e qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""")
def r07_decomposed(spark, d):
    """Questions of two halves are taken apart, each half searched for in all documents, and the lists merged."""
    docs = _docs(spark, d)
    search = lambda subs: R.relative(R.bm25(subs, docs, "sub", "doc_id", "text", 10), "sub")
    return S.decomposed(_questions(spark, d), "item_id", "text", search, docs.select("doc_id", F.col("text").alias("content")), "doc_id", 10)


#: Market documents and news, by language, and how many of each a search fetches.
_COLLECTIONS = (("m", "lang = 'en'", 30), ("n", "lang <> 'en'", 10))


def _collection(c: str, where: str, k: int) -> str:
    return f"""{c}docs as (select * from documents where doc_id is not null and {where}), {_bm25(c + 't', 'benchmark', c + 'docs', 'item_id', k)},
 {c}vs as (select q.vec_id as item_id, e.vec_id as doc_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 9) as score from embeddings q join benchmark on q.vec_id = item_id, embeddings e
  where e.vec_id in (select doc_id from {c}docs) and e.vec_id <> q.vec_id), {c}v as (select * from {c}vs qualify row_number() over (partition by item_id order by score desc, doc_id) <= {k}),
 {c}a as (select item_id, doc_id, {_unit('item_id')} as s from {c}v), {c}b as (select item_id, doc_id, {_unit('item_id')} as s from {c}t),
 {c}j as (select coalesce(x.item_id, y.item_id) as item_id, coalesce(x.doc_id, y.doc_id) as doc_id, round(0.7::double * coalesce(x.s, 0) + 0.3::double * coalesce(y.s, 0), 6) as score from {c}a x full join {c}b y on x.item_id = y.item_id and x.doc_id = y.doc_id),
 {c}f as (select * from {c}j qualify row_number() over (partition by item_id order by score desc, doc_id) <= {k})"""


_RERANKED = f"""{', '.join(_collection(*c) for c in _COLLECTIONS)}, l as (select * from mf union all select * from nf),
 x as (select l.item_id, l.doc_id, round(0.4::double * l.score + 0.6::double * coalesce(round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 9), 0), 6) as score, substring(trim(coalesce(text, '')), 1, 200) as start, text, source, lang
  from l join documents using (doc_id) left join embeddings e on e.vec_id = l.doc_id left join embeddings q on q.vec_id = l.item_id),
 u as (select * from x where score >= 0.15 qualify row_number() over (partition by item_id, start order by score desc, doc_id) = 1), top as (select * from u qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10)"""


def _retrieved(spark, d):
    docs, asked, e = _docs(spark, d), X.table(spark, d, "benchmark"), X.table(spark, d, "embeddings")
    lists = None
    for _, where, k in _COLLECTIONS:
        of = docs.where(where)
        text = R.bm25(asked, of, "item_id", "doc_id", "text", k)
        v = R.cosine_search(e.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), e.join(of.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", k)
        v = v.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
        found = R.fused(R.relative(v, "item_id"), R.relative(text, "item_id"), "item_id", "doc_id", 0.7, k)
        lists = found if lists is None else lists.unionByName(found)
    vectors = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return S.reranked(lists, vectors, vectors.withColumnRenamed("doc_id", "item_id"), docs.select("doc_id", F.col("text").alias("content")), "item_id", "doc_id", 10, 0.15)


@query(f"with {_RERANKED} select item_id, doc_id, score from top")
def r06_market_retrieve(spark, d):
    """Hybrid lists of two collections, three times as many as are wanted of the first, reranked by vectors, without doubles."""
    return _retrieved(spark, d)


@query(f"""with {_RERANKED}, n as (select *, row_number() over (partition by item_id order by score desc, doc_id) as i from top),
 h as (select item_id, i, '[Document ' || i || '] Type: ' || coalesce(lang, '') || case when coalesce(source, '') <> '' then ' | Source: ' || source else '' end || ' | Relevance: ' || printf('%.2f', round(score * 100, 2)) || '%' || chr(10)
  || case when length(coalesce(text, '')) > 2000 then substring(text, 1, 2000) || chr(10) || '... [truncated]' else coalesce(text, '') end as block from n where i <= 5)
select item_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as context from h group by 1""")
def t32_context(spark, d):
    """The five best of R6 as one text."""
    x = _retrieved(spark, d).join(_docs(spark, d).select("doc_id", F.col("text").alias("content"), "source", F.col("lang").alias("kind"), F.lit("").alias("title")), "doc_id")
    return S.context(x, "item_id", "doc_id")


_ASKS = ["I prefer low risk funds ", "How is my portfolio doing", " Tell me of my goal", "What moved the market"]
_NAMES = ["portfolio_manager", "market_analyst", "Risk", "News_sentiment", "personal_cfo"]


def _interactions(spark, d):
    """id, user_id, question, agents: an interaction an order."""
    k = F.col("o_orderkey")
    entry = lambda name, value, when=None: F.struct(F.lit(name).alias("key"), (value if when is None else F.when(when, value)).cast("string").alias("value"))
    data = lambda *e: F.map_from_entries(F.filter(F.array(*e), lambda x: x["value"].isNotNull()))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    first = data(entry("symbol", F.concat(F.lit("s"), (k % 7).cast("string"))), entry("price", F.floor("o_totalprice")), entry("sentiment", pick(["Positive", "mixed", "negative"], k), k % 2 == 0), entry("pe_ratio", k % 40, k % 4 == 0), entry("sector", F.col("o_orderpriority"), k % 3 == 0), entry("note", F.lit("n/a")), entry("loss", k % 9, k % 5 == 0))
    second = data(entry("tickers", F.lit('["aa", "s1"]')), entry("total", k % 100), entry("holdings", F.lit('["x", "y"]'), k % 5 == 0), entry("overall_sentiment", F.lit("neutral")))
    agent = lambda name, x: F.struct(name.alias("name"), x.alias("data"))
    agents = F.when(k % 6 == 5, F.array().cast("array<struct<name:string,data:map<string,string>>>")).when(k % 3 == 1, F.array(agent(pick(_NAMES, k), first), agent(F.lit("trade"), second))).otherwise(F.array(agent(pick(_NAMES, k), first)))
    return X.table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("user_id"), pick(_ASKS, k).alias("question"), agents.alias("agents"))


_ON = "select o_orderkey as k, o_orderkey % 6 <> 5 as one, o_orderkey % 6 <> 5 and o_orderkey % 3 = 1 as two, floor(o_totalprice)::bigint as price, o_orderpriority as sector from orders"


@query(f"""with o as ({_ON}) select k as id,
 case when not one then 'general_query' when k % 5 = 4 then 'general_query' else ['portfolio_query', 'market_analysis', 'risk_assessment', 'news_retrieval'][(k % 5 + 1)::int] end as kind,
 case when one and k % 2 = 0 and k % 3 <> 1 then case k % 3 when 0 then 'positive' else 'negative' end else 'neutral' end as sentiment,
 ((3 + case when one and k % 5 = 2 then 2 else 0 end + case when two then 2 else 0 end + case when one and 3 + (k % 2 = 0)::int + (k % 4 = 0)::int + (k % 3 = 0)::int + (k % 5 = 0)::int > 5 then 1 else 0 end) / 10.0)::double as importance,
 case when not one then []::varchar[] when two then list_sort(list_distinct(['S' || (k % 7), 'AA', 'S1'])) else ['S' || (k % 7)] end as tickers,
 case when not one then []::double[] else list_concat([price::double], case when k % 5 = 0 then [(k % 9)::double] else []::double[] end, case when two then [(k % 100)::double] else []::double[] end) end as amounts from o""")
def t27_events(spark, d):
    """Kind, sentiment, importance and entities of each interaction."""
    a = F.col("agents")
    return _interactions(spark, d).select("id", I.event_kind(a).alias("kind"), I.sentiment(a).alias("sentiment"), I.importance(a).alias("importance"), I.tickers(a).alias("tickers"), I.amounts(a).alias("amounts"))


@query(f"""with o as ({_ON}), i as (
 select k as id, 0 as n, 'User preference: ' || ['I prefer low risk funds', '', 'Tell me of my goal'][(k % 4 + 1)::int] as content, 'preference' as kind, ['preference', 'user-stated'] as tags, 0.8::double as importance from o where k % 4 in (0, 2)
 union all select k, 1, 's' || (k % 7) || ' | P/E ratio: ' || (k % 40) || case when k % 3 = 0 then ' | Sector: ' || sector else '' end, 'financial_fact', ['s' || (k % 7), 'fundamentals'], 0.5 from o where one and k % 4 = 0
 union all select k, 2, 'Portfolio has 2 positions', 'portfolio_state', ['portfolio', 'holdings'], 0.4 from o where two and k % 5 = 0)
select id, (row_number() over (partition by id order by n) - 1)::int as place, content, kind, tags, importance from i""")
def t28_insights(spark, d):
    """Preferences, facts and portfolio states to be remembered of each interaction."""
    x = _interactions(spark, d).select("id", F.posexplode(I.insights(F.col("question"), F.col("agents"))).alias("place", "i"))
    return x.select("id", "place", "i.content", "i.kind", "i.tags", "i.importance")


@query(f"with {X.BARS}, x as (select symbol, \"close\" as c, row_number() over (partition by symbol order by d) as i, count(*) over (partition by symbol) as n from bars) " + """
select symbol, round(sum(case when i <= 20 then c / 20 * power(1 - 2.0::double / 21, greatest(0, n - 20)) else c * 2.0::double / 21 * power(1 - 2.0::double / 21, n - i) end), 4) as ema from x group by 1""")
def w04_ema_from_mean(spark, d):
    """The last 20-day exponential mean of each segment, begun from the mean of its first 20 days."""
    from ledgerlark.operators.indicators import ema_from_mean

    return ema_from_mean(X.bars(spark, d), 20).select("symbol", F.round("ema", 4).alias("ema"))


@query(f"""with {X.BARS}, x as (select symbol, d, ln("close" / lag("close") over w + 1e-10) as r1, ln("close" / lag("close", 5) over w + 1e-10) as r5, case when volume = lag(volume) over w then null else 1 / (volume - lag(volume) over w) end as v from bars window w as (partition by symbol order by d))
select symbol, d, round(coalesce(case when isfinite(r1) then r1 end, 0), 6) as r1, round(coalesce(case when isfinite(r5) then r5 end, 0), 6) as r5, round(coalesce(case when isfinite(v) then v end, 0), 6) as v from x""")
def w20_filled(spark, d):
    """Features whose nulls and infinite values are 0."""
    from pyspark.sql import Window

    from ledgerlark.operators.indicators import finite

    w = Window.partitionBy("symbol").orderBy("d")
    logs = lambda n: F.ln(F.col("close") / F.lag("close", n).over(w) + 1e-10)
    step = F.try_divide(F.lit(1.0), F.col("volume") - F.lag("volume").over(w))
    x = X.bars(spark, d).select("symbol", "d", logs(1).alias("r1"), logs(5).alias("r5"), step.alias("v"))
    return x.select("symbol", "d", *(F.round(finite(c), 6).alias(c) for c in ("r1", "r5", "v")))


@query("with x as (select doc_id, string_split(coalesce(text, ''), ' ') as w from documents) select doc_id, ceil(len(w) / 50.0)::int as batches, array_to_string(w[((ceil(len(w) / 50.0) - 1) * 50 + 1)::int:], ' ') as last from x")
def t37_batches(spark, d):
    """Words of whole documents in lists of 50."""
    from ledgerlark.functions.text import batched

    x = X.table(spark, d, "documents").select("doc_id", batched(F.split(F.coalesce("text", F.lit("")), " "), 50).alias("b"))
    return x.select("doc_id", F.size("b").alias("batches"), F.array_join(F.element_at("b", -1), " ").alias("last"))


@query("select event_id, ts - interval 330 minute as utc, ts + interval 330 minute as local from events")
def t38_zones(spark, d):
    """Events' times, taken as of Asia/Kolkata, in UTC; and taken as of UTC, there."""
    from ledgerlark.operators.bars import in_zone

    return X.table(spark, d, "events").select("event_id", in_zone(F.col("ts"), "UTC", "Asia/Kolkata").alias("utc"), in_zone(F.col("ts"), "Asia/Kolkata", "UTC").alias("local"))


_HEADED = "case turn % 3 when 0 then 'Executive Summary' || chr(10) || text when 1 then text || ' Sources: ' || role else text end"


@query(f"select conv_id, turn, regexp_replace({''.join('replace(' for _ in T.ANSWER_HEADINGS)}{_HEADED}{''.join(f", '{p}', '')" for p in T.ANSWER_HEADINGS)}, '^\\s+|\\s+$', '', 'g') as answer from conversations")
def t40_without_headings(spark, d):
    """Turns of conversations, headed as answers are, without the headings."""
    x = X.table(spark, d, "conversations")
    headed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Executive Summary\n"), "text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" Sources: "), "role")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", T.without_phrases(headed, T.ANSWER_HEADINGS).alias("answer"))
