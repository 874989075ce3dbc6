"""Queries: news and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import news as N
from ledgerlark.functions import text as T
from ledgerlark.plans import fixtures as X
from ledgerlark.plans.registry import query
from ledgerlark.plans.texts import _first, _hits, _list

#: Parts of the headlines and questions that stand for texts with words of the domain.
SUBJECTS = ["RBI", "TCS", "HDFC Bank", "Reliance", "infy", "SEBI", "A tyre maker", "SUNPHARMA and ITC"]
VERBS = ["announces", "reports", "warns of", "considers", "halts", "beats estimates with"]
NEWS = ["a rate cut", "strong quarterly results and a record high", "a fraud, a crash and a collapse", "a merger", "an IPO listing", "weak credit growth", "a green energy expansion", "new compliance rules", "the appointed CEO", "a routine meeting"]
REMARKS = ["Profits rise on strong demand", "Debt is a concern, as is the loss of revenues", "The outlook stays stable", "Cash flows and dividends beat all", "Risky growth", "Nothing to add"]
HEADS = ["How does PPF work", "What is the tax on a home loan", "Compare ELSS", "Is gold better", "Explain section 80C(2)", "Hello", ""]
LINKS = [" and ", " vs. ", "  along with ", " versus ", ", ", "? "]
TAILS = ["what is the premium of insurance?", "NPS", "fixed deposit rates", "a mutual fund SIP? Really?", "the weather"]


def _picked(key, *lists):
    """A part of each list by the key, as Spark expressions."""
    out, by = [], 1
    for values in lists:
        out.append(F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(({key} div {by}) % {len(values)} + 1 as int)")))
        by *= len(values)
    return out


def _picked_sql(key, *lists):
    """The same as SQL."""
    out, by = [], 1
    for values in lists:
        out.append(f"({_list(values)})[({key} // {by}) % {len(values)} + 1]")
        by *= len(values)
    return out


HEADLINES = f"headlines as (select o_orderkey as news_id, o_orderpriority as source, {" || ' ' || ".join(_picked_sql('o_orderkey', SUBJECTS, VERBS, NEWS))} as text from orders)"
QUESTIONS = f"questions as (select c_custkey as id, {' || '.join(_picked_sql('c_custkey', HEADS, LINKS, TAILS))} as q from customer)"


def headlines(spark, d):
    """news_id, source, text: a headline an order."""
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("news_id"), F.col("o_orderpriority").alias("source"), F.concat_ws(" ", *_picked("o_orderkey", SUBJECTS, VERBS, NEWS)).alias("text"))


def questions(spark, d):
    """id, q: a question a customer."""
    return X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(*_picked("c_custkey", HEADS, LINKS, TAILS)).alias("q"))


_TICKERS = f"list_sort(list_distinct(list_transform(regexp_extract_all(text, '{N.TICKER_PATTERN}', 1), lambda x: upper(x))))"


@query(f"with {HEADLINES} select news_id, {_TICKERS} as tickers from headlines")
def t15_listed_tickers(spark, d):
    return headlines(spark, d).select("news_id", N.tickers(F.col("text")).alias("tickers"))


@query(f"""with {HEADLINES}, k(trend, words) as (values {', '.join(f"('{k}', {_list(w.split(';'))})" for k, w in N.THEMES.items())}),
 w as (select trend, words, unnest(words) as word from k), p as (select source, trend, count(distinct word) as n from headlines, w where contains(lower(text), word) group by 1, 2),
 t as (select source, trend, list_sort(list_distinct(flatten(list({_TICKERS})))) as tickers from headlines, k where len(list_filter(words, lambda v: contains(lower(text), v))) > 0 group by 1, 2)
select source, trend, n as keyword_hits, case when n >= 5 then 'high' when n >= 2 then 'medium' else 'low' end as intensity, tickers from p join t using (source, trend)""")
def t22_themes(spark, d):
    return N.themes(headlines(spark, d), "source", "text")


def _sentiment(table):
    """CTEs that end with ``s``: ``score`` and ``hits`` of the texts of a table."""
    return f"""l as (select *, lower(text) as t from {table}), c as (select *, {', '.join(f'{_hits("t", w)} as {k}' for k, w in T.SENTIMENT_WORDS.items())} from l),
 h as (select *, {' + '.join(T.SENTIMENT_WORDS)} as hits, {' + '.join(f'({w}) * {k}' for k, w in T.SENTIMENT_WEIGHTS.items())} as net from c),
 s as (select *, round(case when hits > 0 then greatest(-1, least(1, net / hits / 2)) else 0 end, 9) as score from h)"""


_LABEL = "case when hits = 0 then 'neutral' when score <= -0.6 then 'strongly_bearish' when score <= -0.2 then 'bearish' when score <= 0.2 then 'neutral' when score <= 0.6 then 'bullish' else 'strongly_bullish' end as label"
_SCORED = f"""{_sentiment('headlines')},
 e as (select news_id, source, score, {_TICKERS} as tickers, {_first('t', N.EVENTS, 'none')} as event,
  {_LABEL},
  case when abs(score) > 0.6 then 'high' when abs(score) > 0.2 then 'moderate' else 'low' end as severity from s),
 ev as (select * from e where event <> 'none')"""


def events(spark, d):
    """news_id, source, event, label, score, severity, tickers of the headlines that tell an event."""
    x = T.keyword_sentiment(headlines(spark, d).withColumn("event", N.event_kind(F.col("text"))).where("event is not null"), "text")
    return x.select("news_id", "source", "event", "label", "score", N.severity(F.col("score")).alias("severity"), N.tickers(F.col("text")).alias("tickers"))


@query(f"with {HEADLINES}, {_SCORED} select news_id, source, event, label, severity, tickers from ev")
def t23_events(spark, d):
    return events(spark, d).drop("score")


_RISES = ", ".join(f"('{k}', '{s}', {round(v[3] * m, 2)}::double, {m}::double, '{v[0]}', '{v[1]}', '{v[2]}')" for k, v in N.IMPACTS.items() for s, m in N.SEVERITIES.items())
_IMPACT = f"""with {HEADLINES}, {_SCORED}, r(kind, severity, rise, m, direct_impact, spillover, duration) as (values {_RISES}),
 i as (select news_id, tickers, ev.severity, case when score > 0.2 then 'positive' when score < -0.2 then 'negative' else 'neutral' end as direction, round(0.02::double * m * (abs(score) + 0.3::double) + 1e-9, 4) as size, rise, duration, direct_impact, spillover
 from ev join r on r.kind = case when event in ({', '.join(f"'{k}'" for k in N.IMPACTS)}) then event else 'macro' end and r.severity = ev.severity),
 im as (select *, case direction when 'positive' then size when 'negative' then -size else 0.0 end::double as price_change from i)"""


def _impacts(spark, d):
    return events(spark, d).select("news_id", "tickers", "severity", *N.impact(F.col("score"), F.col("event"), F.col("severity")))


@query(_IMPACT + " select news_id, severity, direction, price_change, rise as volatility_rise, duration, direct_impact, spillover from im")
def t24_event_impact(spark, d):
    return _impacts(spark, d).drop("tickers")


@query(_IMPACT + """, x as (select unnest(tickers) as ticker, direction, price_change, severity from im), g as (select ticker, count(*) as events, count(*) filter (direction = 'positive') as positive, count(*) filter (direction = 'negative') as negative,
 round(avg(price_change), 6) as mean_change, case when bool_or(severity = 'high') then 'high' else 'moderate' end as severity from x group by 1)
select *, case when positive > negative then 'positive' when negative > positive then 'negative' else 'neutral' end as net_direction from g""")
def a16_ticker_impact(spark, d):
    return N.impact_by_ticker(_impacts(spark, d))


_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _topics(pattern):
    return _UNIQUE.format(f"list_transform(regexp_extract_all(q, '{pattern}'), lambda y: lower(y))")


@query(f"""with {QUESTIONS}, c as (select id, (least(len(regexp_extract_all(q, '(?i)\\band\\b')), 2) + least(len(regexp_extract_all(q, '\\?')), 2) + regexp_matches(q, '{N.COMPARISON}')::int + least(len({_topics(N.KEYWORDS)}), 3))::int as score from questions)
select id, score, score >= 2 as complex from c""")
def t29_complexity(spark, d):
    return questions(spark, d).select("id", N.complexity(F.col("q")).alias("score")).select("id", "score", (F.col("score") >= 2).alias("complex"))


@query(rf"""with {QUESTIONS}, p as (select id, q, list_filter(list_transform(string_split_regex(q, '{N.CONJUNCTION}'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: length(y) > 10) as pieces,
 regexp_replace(regexp_extract(q, '{N.VERSUS}', 1), '^\s+|\s+$', '', 'g') as a, regexp_replace(regexp_extract(q, '{N.VERSUS}', 2), '^\s+|\s+$', '', 'g') as b, {_topics(N.TOPICS)} as topics from questions)
select id, case when len(pieces) >= 2 then pieces when a <> '' and b <> '' then ['What is ' || a || '?', 'What is ' || b || '?', 'How does ' || a || ' compare with ' || b || '?']
 when len(topics) >= 2 then list_concat(list_transform(topics, lambda t: 'What are the rules and benefits related to ' || t || '?'), [q]) else [q] end as parts from p""")
def t29_parts(spark, d):
    return questions(spark, d).select("id", N.parts(F.col("q")).alias("parts"))


#: A question with words of the synthetic documents.
ASKED = "What is the mention of une elle entre avec erint ing, and how does ation change it?"
_TERMS = N.terms_of(ASKED)
_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_SHARED = rf"len(list_intersect(string_split_regex(lower(x), '[^\p{{L}}\p{{N}}_]+'), {_list(_TERMS)}))"


@query(f"""with s as (select doc_id, array_to_string(list_filter({_SENTENCES}, lambda x, i: i = 1 or length(x) < 50 or {_SHARED} > 0), ' ') as k from documents where text is not null)
select doc_id, case when length(k) > 1500 then substring(k, 1, 1500) || '...' else k end as compressed from s where trim(k) <> ''""")
def t30_compressed(spark, d):
    return X.table(spark, d, "documents").where("text is not null").select("doc_id", N.compressed(F.col("text"), _TERMS).alias("compressed")).where("trim(compressed) != ''")


_PLACES = ", ".join(f"nullif(instr(lower(b), '{t}'), 0)" for t in _TERMS)


@query(f"""with s as (select doc_id, (list_sort(list_transform({_SENTENCES}, lambda x, i: {{'o': case when length(x) > 30 then {_SHARED} else 0 end, 'n': -i, 's': x}}), 'DESC')[1]).s as b from documents where text is not null),
 f as (select doc_id, b, coalesce(least({_PLACES}), length(b) + 1) - 1 as first from s)
select doc_id, case when length(b) > 250 then '...' || substring(b, greatest(0, first - 50) + 1, 250) || '...' else b end as highlight from f""")
def t31_highlight(spark, d):
    return X.table(spark, d, "documents").where("text is not null").select("doc_id", N.highlight(F.col("text"), _TERMS).alias("highlight"))


_A = _picked_sql("o_orderkey", NEWS, REMARKS, REMARKS, REMARKS)
ARTICLES = f"articles as (select o_orderkey as news_id, 'They tell of ' || {_A[0]} || '. ' || {_A[1]} || '! ' || {_A[2]} || '. ' || {_A[3]} || '?' as text from orders)"


def articles(spark, d):
    """news_id, text: an article of four sentences an order."""
    a = _picked("o_orderkey", NEWS, REMARKS, REMARKS, REMARKS)
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("news_id"), F.concat(F.lit("They tell of "), a[0], F.lit(". "), a[1], F.lit("! "), a[2], F.lit(". "), a[3], F.lit("?")).alias("text"))


@query(rf"""with {ARTICLES}, p as (select news_id, unnest({_list(N.ASPECTS)}) as aspect, {_SENTENCES} as parts from articles),
 f as (select news_id, aspect, list_filter(parts, lambda x: regexp_matches(x, '(?i)\b(' || aspect || '[a-z]*)\b')) as found from p), m as (select news_id, aspect, len(found) as n_sentences, array_to_string(found, ' ') as text from f where len(found) > 0),
 {_sentiment('m')} select news_id, aspect, n_sentences, score, {_LABEL} from s""")
def t21_aspects(spark, d):
    """Sentiment of the sentences about each aspect, by the keywords of T18."""
    return T.keyword_sentiment(N.aspects(articles(spark, d), "news_id", "text"), "combined").select("news_id", "aspect", "n_sentences", "score", "label")


@query("with k as (select page_id, " + "case " + " ".join(f"when regexp_matches(lower(url), '{p}') then '{k}'" for p, k in T.URL_KINDS) + " else 'web_article' end as kind from pages) select page_id, kind, case "
       + " ".join(f"when kind in ({', '.join(f"'{k}'" for k in kinds)}) then '{way}'" for way, kinds in N.CHUNKINGS.items()) + " else 'recursive' end as chunking from k")
def t04_chunking(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.url_kind(F.col("url")).alias("kind")).select("page_id", "kind", N.chunking(F.col("kind")).alias("chunking"))


def _confidence_sql(agent):
    start, data, tools, context, warned = N.CONFIDENCES[agent]
    some = " or ".join(f"contains(lower(text), '{w}')" for w in N.DISCLAIMERS[agent].split(";") if w) or "false"
    parts = ((data, "turn > 0"), (tools, "turn > 1"), (context, "turn > 2"), (warned, some), (0.05, "length(text) > 300"))
    return f"round(least(1.0::double, {start}::double + " + " + ".join(f"case when {c} then {g}::double else 0 end" for g, c in parts) + f"), 2) as {agent}"


@query(f"select conv_id, turn, {', '.join(map(_confidence_sql, N.CONFIDENCES))} from conversations where role = 'assistant' and text is not null")
def f48_confidence(spark, d):
    """Confidence of three agents in a turn's answer; earlier turns stand for data, tools and context."""
    x = X.table(spark, d, "conversations").where("role = 'assistant' and text is not null")
    return x.select("conv_id", "turn", *(N.confidence(a, F.col("text"), *(F.col("turn") > k for k in range(3))).alias(a) for a in N.CONFIDENCES))
