"""Queries: text functions, vectors, retrieval, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.functions import vectors as V
from ledgerlark.functions.words import distinct_words
from ledgerlark.operators import retrieval as R
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query
from ledgerlark.session import cut


def docs(spark, d):
    return X.table(spark, d, "documents")


def _hits(x, words):
    return "(" + " + ".join(f"contains({x}, '{w}')::int" for w in words.split(";")) + ")"


def _first(x, kinds, default):
    return "case " + " ".join(f"when {' or '.join(f'''contains({x}, '{w}')''' for w in words.split(';'))} then '{k}'" for k, words in kinds.items()) + f" else '{default}' end"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SENT = f"""l as (select doc_id, lang, source, lower(coalesce(text, '')) as t from documents), k as (select doc_id, lang, source, {', '.join(f'{_hits("t", w)} as {k}' for k, w in T.SENTIMENT_WORDS.items())} from l),
 n as (select *, {' + '.join(T.SENTIMENT_WORDS)} as hits, {' + '.join(f'({w}) * {k}' for k, w in T.SENTIMENT_WEIGHTS.items())} as net from k), s as (select *, round(case when hits > 0 then greatest(-1, least(1, net / hits / 2)) else 0 end, 9) as score from n),
 sent as (select doc_id, lang, source, score, case when hits = 0 then 'neutral' when score <= -0.6 then 'strongly_bearish' when score <= -0.2 then 'bearish' when score <= 0.2 then 'neutral' when score <= 0.6 then 'bullish' else 'strongly_bullish' end as label,
  round(case when hits = 0 then 0.5 else least(hits / 5, 1) end, 2) as confidence from s)"""


@query(f"with {_SENT} select doc_id, round(score, 4) as score, label, confidence from sent")
def t18_keyword_sentiment(spark, d):
    return T.keyword_sentiment(docs(spark, d), "text").select("doc_id", F.round("score", 4).alias("score"), "label", "confidence")


@query(f"""with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '')) as w from documents),
 s as (select doc_id, len(list_intersect(w, {_list(T.BULL_WORDS)})) - len(list_intersect(w, {_list(T.BEAR_WORDS)})) as diff from w)
select doc_id, case when diff > 0 then 'positive' when diff < 0 then 'negative' else 'neutral' end as sentiment, round(least(1, greatest(0, 0.5 + diff * 0.1)), 6)::double as score from s""")
def t19_bull_bear(spark, d):
    sentiment, score = T.bull_bear(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", sentiment.alias("sentiment"), score.alias("score"))


@query(f"""with {_SENT} select lang, count(*) as n, round(avg(score), 6) as mean, count(*) filter (score > 0.2) as bullish, count(*) filter (score < -0.2) as bearish, round(count(*) filter (score > 0.2) / count(*) * 100, 4) as bullish_pct from sent group by 1""")
def a15_sentiment_aggregate(spark, d):
    s = F.col("score")
    x = T.keyword_sentiment(docs(spark, d), "text").groupBy("lang")
    return x.agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.count_if(s > 0.2).alias("bullish"), F.count_if(s < -0.2).alias("bearish"), F.round(F.count_if(s > 0.2) / F.count("*") * 100, 4).alias("bullish_pct"))


@query(f"""with {_SENT}, m as (select source, label, sum(confidence) as w from sent group by 1, 2), t as (select source, sum(confidence) as w, round(sum(score * confidence) / sum(confidence), 6) as mean from sent group by 1)
select t.source, t.mean, arg_max(label, (m.w, label)) as label, round(max(m.w) / any_value(t.w), 6) as share from t join m on t.source is not distinct from m.source group by t.source, t.mean""")
def a17_weighted_sentiment(spark, d):
    """Mean score weighted by confidence, and the label of the greatest weight (ties: the later name)."""
    x = T.keyword_sentiment(docs(spark, d), "text")
    m = x.groupBy("source", "label").agg(F.sum("confidence").alias("w"), F.sum(F.col("score") * F.col("confidence")).alias("s"))
    g = m.groupBy("source").agg(F.round(F.sum("s") / F.sum("w"), 6).alias("mean"), F.max_by("label", F.struct("w", "label")).alias("label"), F.round(F.max("w") / F.sum("w"), 6).alias("share"))
    return g


@query(f"with {_SENT} select list_sort(list_distinct(list(source))) as sources, list_sort(list_distinct(list(lang))) as langs, min(doc_id) as first_id, max(doc_id) as last_id, round(avg(nullif(score, 0)), 6) as mean_score from sent")
def a18_result_metadata(spark, d):
    x = T.keyword_sentiment(docs(spark, d), "text")
    return x.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("lang")).alias("langs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.round(F.avg(F.nullif("score", F.lit(0.0))), 6).alias("mean_score"))


@query(f"select doc_id, {_first('lower(text)', T.CATEGORIES, 'general')} as category from documents")
def t25_category(spark, d):
    return docs(spark, d).select("doc_id", T.first_kind(F.lower("text"), T.CATEGORIES, "general").alias("category"))


@query(f"select doc_id, list_filter([{', '.join(f'''case when {_hits('lower(text)', w)} > 0 then '{k}' end''' for k, w in T.CATEGORIES.items())}], lambda x: x is not null) as intents from documents where text is not null")
def t26_intents(spark, d):
    """All kinds that a text has, in order (the kinds of T25)."""
    return docs(spark, d).where("text is not null").select("doc_id", T.all_kinds(F.lower("text"), T.CATEGORIES).alias("intents"))


_KIND = _first("lower(text)", T.QUERY_KINDS, "general")


@query(f"select conv_id, turn, {_KIND} as kind from conversations")
def g1_query_kind(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.first_kind(F.lower("text"), T.QUERY_KINDS, "general").alias("kind"))


_ROUTES = {"market_query": ["portfolio_manager", "market_analyst", "news_sentiment", "risk_analyst"], "portfolio_query": ["portfolio_manager", "risk_analyst"], "risk_query": ["risk_analyst"], "personal_finance_query": ["personal_cfo"], "general": ["personal_cfo", "market_analyst"]}


@query(f"with k as (select conv_id, turn, {_KIND} as kind, length(text) as n from conversations) select conv_id, turn, case when kind = 'market_query' and n <= 140 then ['market_analyst'] else case kind {' '.join(f'''when '{k}' then {_list(v)}''' for k, v in _ROUTES.items())} end end as agents from k")
def g2_routes(spark, d):
    """The agents of each kind; a short question about the market goes to one."""
    table = F.create_map(*(c for k, v in _ROUTES.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    x = X.table(spark, d, "conversations").select("conv_id", "turn", T.first_kind(F.lower("text"), T.QUERY_KINDS, "general").alias("kind"), F.length("text").alias("n"))
    short = (F.col("kind") == "market_query") & (F.col("n") <= 140)
    return x.select("conv_id", "turn", F.when(short, F.array(F.lit("market_analyst"))).otherwise(table[F.col("kind")]).alias("agents"))


@query("select page_id, " + "case " + " ".join(f"when regexp_matches(lower(url), '{p}') then '{k}'" for p, k in T.URL_KINDS) + " else 'web_article' end as kind from pages")
def t03_url_kind(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.url_kind(F.col("url")).alias("kind"))


@query(r"select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, length(regexp_replace(html, '(?is)<(script|style|nav|footer|header|aside|noscript|iframe)[^>]*>.*?</(script|style|nav|footer|header|aside|noscript|iframe)>', '', 'g'))::int as n_left from pages")
def t02_html_metadata(spark, d):
    """Title, and what is left without the elements that hold no text of the article."""
    silent = r"(?is)<(script|style|nav|footer|header|aside|noscript|iframe)[^>]*>.*?</(script|style|nav|footer|header|aside|noscript|iframe)>"
    return X.table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.length(F.regexp_replace("html", silent, "")).alias("n_left"))


@query(r"select doc_id, sha256(coalesce(text, '') || ':' || coalesce(source, '')) as checksum, substring(sha256(coalesce(source, '') || ':' || doc_id), 1, 24) as article_id from documents")
def t14_checksums(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit(":"), F.coalesce("source", F.lit(""))), 256).alias("checksum"), F.substring(F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.col("doc_id").cast("string")), 256), 1, 24).alias("article_id"))


@query(r"select doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[\x{C0}-\x{24F}]', 'x', 'g'), '\b([A-Z]{2,5}(?:\.[A-Z]{1,2})?)\b', 1)), lambda x: x not in ('AND', 'THE', 'FOR', 'NOT'))) as tickers from documents where text is not null")
def t16_tickers(spark, d):
    found = F.regexp_extract_all("text", F.lit(T.TICKER), 1)
    return docs(spark, d).where("text is not null").select("doc_id", F.array_sort(F.array_except(found, F.array(*map(F.lit, ("AND", "THE", "FOR", "NOT"))))).alias("tickers"))


@query(r"select doc_id, len(regexp_extract_all(text, '(?i)(?:\$|USD|EUR|INR|Rs\.?)\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?')) as amounts, regexp_extract_all(text, '\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b') as dates, list_filter([" + ", ".join(f"case when {_hits('lower(text)', w)} > 0 then '{k}' end" for k, w in T.SECTOR_WORDS.items()) + "], lambda x: x is not null) as sectors from documents where text is not null")
def t17_entities(spark, d):
    amounts = F.regexp_extract_all("text", F.lit(r"(?i)(?:\$|USD|EUR|INR|Rs\.?)\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?"), 0)
    dates = F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b"), 0)
    return docs(spark, d).where("text is not null").select("doc_id", F.size(amounts).alias("amounts"), dates.alias("dates"), T.all_kinds(F.lower("text"), T.SECTOR_WORDS).alias("sectors"))


@query("""with h as (select doc_id, text, substring(text, 1, 497) as head from documents where text is not null), s as (select *, length(head) - position(' ' in reverse(head)) as cutoff, contains(head, ' ') as sp from h)
select doc_id, case when length(text) <= 500 then text when sp and cutoff > 350 then substring(head, 1, cutoff) || '...' else head || '...' end as short from s""")
def t33_truncated(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.truncated(F.col("text")).alias("short"))


@query("""select o_orderkey, case when x >= 1e7 then '₹' || printf('%.2f', round(x / 1e7, 2)) || 'Cr' when x >= 1e5 then '₹' || printf('%.2f', round(x / 1e5, 2)) || 'L' when x >= 1e3 then printf('%.2f', round(x / 1e3, 2)) || 'K' else printf('%.2f', round(x, 2)) end as shown
from (select o_orderkey, o_totalprice * 37 + 0.001 as x from orders)""")
def t34_large_numbers(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", T.large_number(F.col("o_totalprice") * 37 + 0.001).alias("shown"))


@query("select event_id, json_extract_string(props, '$.k') as \"props.k\", ((row_number() over (order by event_id) - 1) // 100)::bigint as batch from events")
def t35_flat_batches(spark, d):
    """Nested fields by dotted names, and lists cut into batches of 100 rows (ids are dense here, so no task sorts them all)."""
    e = X.table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("props"))
    return e.select("event_id", F.col("props.k").alias("props.k"), F.floor((F.col("event_id") - F.lit(0)) / 100).cast("bigint").alias("batch"))


@query("select o_orderkey, date_diff('day', cast(o_orderdate as date), date '2002-01-01') as days, 'FY' || (year(o_orderdate) - (month(o_orderdate) < 4)::int) || '-' || printf('%02d', (year(o_orderdate) + 1 - (month(o_orderdate) < 4)::int) % 100) as fy from orders")
def t39_holding_days(spark, d):
    y = F.year("o_orderdate") - (F.month("o_orderdate") < 4).cast("int")
    return X.table(spark, d, "orders").select("o_orderkey", F.datediff(F.lit("2002-01-01"), F.col("o_orderdate").cast("date")).alias("days"), F.concat(F.lit("FY"), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")).alias("fy"))


@query("""with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 1), e as (select vec_id, cast(embedding as double[]) as v from embeddings)
select vec_id, round(list_cosine_similarity(v, q), 6) as cosine, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first, len(v[1:10] || [0.0, 0.0]) as fitted, round(case when 1 - list_cosine_similarity(v, q) <= 1 then list_cosine_similarity(v, q) else 1 / (2 - list_cosine_similarity(v, q)) end, 6) as relevance from e, q""")
def t43_vector_functions(spark, d):
    """Cosine, normalisation, padding to a size, relevance from distance. The other vector is one row, broadcast."""
    e = X.table(spark, d, "embeddings").select("vec_id", "embedding")
    x = e.join(F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q"))), how="cross").withColumn("c", V.cosine(F.col("embedding"), F.col("q")))
    return x.select("vec_id", F.round("c", 6).alias("cosine"), F.round(V.normalised(F.col("embedding"))[0], 6).alias("first"), F.size(V.fitted(F.slice("embedding", 1, 10), 12)).cast("bigint").alias("fitted"), F.round(V.relevance(1 - F.col("c")), 6).alias("relevance"))


@query("""with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '')) as w from documents), s as (select a.doc_id as a, b.doc_id as b, a.w as x, b.w as y from w a join w b on b.doc_id = a.doc_id + 1)
select a, b, len(list_intersect(x, y)) as both, round(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 6) as jaccard from s""")
def u06_set_overlap(spark, d):
    """Shared words and Jaccard similarity of each document and the next."""
    w = cut(distinct_words(docs(spark, d), "doc_id", "text"))  # read for both sides
    x = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("w").alias("y")), "doc_id")
    both = F.size(F.array_intersect("w", "y"))
    x = x.select("doc_id", "b", both.cast("bigint").alias("both"), (F.size("w") + F.size("y")).alias("n"))
    return x.select(F.col("doc_id").alias("a"), "b", "both", F.round(F.col("both") / F.nullif(F.col("n") - F.col("both"), F.lit(0)), 6).alias("jaccard"))


_STOP = ["the", "a", "an", "of", "in", "to", "for", "and", "is", "it"]


@query(f"select item_id, list_sort(list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9_]+')), lambda x: x <> '' and x not in ({', '.join(f'''{chr(39)}{w}{chr(39)}''' for w in _STOP)}))) as terms from benchmark")
def u07_without_stop_words(spark, d):
    return X.table(spark, d, "benchmark").select("item_id", F.array_sort(F.array_except(T.words_of(F.col("text")), F.array(*map(F.lit, _STOP)))).alias("terms"))


_TENTH = " where item_id % 10 = 0"


def _terms(asked=_TENTH):
    return f"""qt as (select distinct item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) as term from benchmark{asked}),
 dt as (select doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '')) as term from documents), tf as (select doc_id, term, count(*) as tf from dt group by 1, 2), dl as (select doc_id, sum(tf) as n from tf group by 1),
 st as (select count(*) as docs, avg(n) as mean from dl), df as (select term, count(*) as df from tf group by 1),
 bm as (select item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from qt join tf using (term) join df using (term) join dl using (doc_id), st group by 1, 2),
 top as (select * from bm qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20)"""


@query(f"with {_terms()} select item_id, doc_id, score from top")
def r3_bm25(spark, d):
    """The 20 best documents for each tenth item of the benchmark, over all documents."""
    asked = X.table(spark, d, "benchmark").where("item_id % 10 = 0")
    return R.bm25(asked, docs(spark, d), "item_id", "doc_id", "text", 20).select("item_id", "doc_id", "score")


def _both(asked=_TENTH):
    return f"""{_terms(asked)}, e as (select vec_id, cast(embedding as double[]) as e from embeddings), vs as (select q.vec_id as item_id, e.vec_id as doc_id, round(list_cosine_similarity(e.e, q.e), 9) as c from e q join benchmark on q.vec_id = item_id, e{asked + " and" if asked else " where"} e.vec_id <> q.vec_id),
 v as (select item_id, doc_id, round(c, 6) as vs from vs qualify row_number() over (partition by item_id order by c desc, doc_id) <= 20)"""


def _lists(spark, d, asked):
    """Two lists for each query: by the cosine of its vector to all documents' vectors (of the same ids), and by its text (BM25)."""
    text = R.bm25(asked, docs(spark, d), "item_id", "doc_id", "text", 20)
    e = X.table(spark, d, "embeddings")
    v = R.cosine_search(e.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), e, "vec_id", "embedding", 20)
    return v.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.round("similarity", 6).alias("score")), text


@query(f"""with {_both("")}, j as (select coalesce(v.item_id, t.item_id) as item_id, coalesce(v.doc_id, t.doc_id) as doc_id, round(0.7::double * coalesce(vs, 0) + 0.3::double * coalesce(score, 0), 6) as fused from v full join top t on v.item_id = t.item_id and v.doc_id = t.doc_id)
select item_id, doc_id, fused as score from j qualify row_number() over (partition by item_id order by fused desc, doc_id) <= 10""")
def r4_hybrid_linear(spark, d):
    """R4 with J2 and O2: a full outer join of two ranked lists, fused linearly, for every item of the benchmark."""
    a, b = _lists(spark, d, X.table(spark, d, "benchmark"))
    return R.fused(a, b, "item_id", "doc_id", 0.7, 10).select("item_id", "doc_id", "score")


_UNIT = "coalesce(({0} - min({0}) over w) / nullif(max({0}) over w - min({0}) over w, 0), 1)"


@query(f"""with {_both()}, a as (select item_id, doc_id, {_UNIT.format('vs')} as s from v window w as (partition by item_id)), b as (select item_id, doc_id, {_UNIT.format('score')} as s from top window w as (partition by item_id)),
 j as (select coalesce(a.item_id, b.item_id) as item_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(0.7::double * coalesce(a.s, 0) + 0.3::double * coalesce(b.s, 0), 6) as fused from a full join b on a.item_id = b.item_id and a.doc_id = b.doc_id)
select item_id, doc_id, fused as score from j qualify row_number() over (partition by item_id order by fused desc, doc_id) <= 10""")
def r5_hybrid_relative(spark, d):
    """Each list's scores are first brought to 0 .. 1."""
    a, b = _lists(spark, d, X.table(spark, d, "benchmark").where("item_id % 10 = 0"))
    return R.fused(R.relative(a, "item_id"), R.relative(b, "item_id"), "item_id", "doc_id", 0.7, 10).select("item_id", "doc_id", "score")


@query("""with r as (select doc_id % 4 as q, doc_id, substring(trim(coalesce(text, '')), 1, 300) as k, round((doc_id % 97) / 100.0, 6)::double as s from documents)
select arg_min(doc_id, (q, doc_id)) as doc_id, round(least(1, arg_min(s, (q, doc_id)) + 0.05 * (count(*) - 1)), 6)::double as score from r group by k""")
def u04_merged_results(spark, d):
    """Results of several sub-questions that begin alike are one; the first's score gains 0.05 for each further one."""
    x = docs(spark, d).select((F.col("doc_id") % 4).alias("q"), "doc_id", F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 300).alias("k"), F.round(F.col("doc_id") % 97 / 100, 6).alias("s"))
    first = F.struct("q", "doc_id")
    x = x.groupBy("k").agg(F.min_by("doc_id", first).alias("doc_id"), F.min_by("s", first).alias("s"), F.count("*").alias("n"))
    return x.select("doc_id", F.round(F.least(F.lit(1.0), F.col("s") + 0.05 * (F.col("n") - 1)), 6).alias("score"))


@query()
def t05_recursive_chunks(spark, d):
    return T.chunked(docs(spark, d), "doc_id", "text", T.recursive_chunks)


@query()
def t06_sized_chunks(spark, d):
    return T.chunked(docs(spark, d), "doc_id", "text", lambda t: T.sized_chunks(t, 1000, 200) if t else [])


@query()
def t07_sentences(spark, d):
    return T.chunked(docs(spark, d), "doc_id", "text", T.sentences)


@query()
def t08_similar_sentences(spark, d):
    return T.chunked(docs(spark, d), "doc_id", "text", lambda t: T.similar_chunks(T.sentences(t)))


@query()
def t13_merged_short(spark, d):
    return T.chunked(docs(spark, d), "doc_id", "text", lambda t: T.merged_short([s for s in t.split("\n") if s.strip()], 100))
