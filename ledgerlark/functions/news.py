"""News and questions: tickers, themes, events and their impact; complexity, parts, compression and highlights."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import first_kind

# Tickers, themes, events, impacts, stop words and topics.
TICKERS = (
    "RELIANCE TCS INFY HDFCBANK ICICIBANK SBIN BHARTIARTL ITC KOTAKBANK LT AXISBANK BAJFINANCE MARUTI SUNPHARMA TATAMOTORS WIPRO ULTRACEMCO TITAN NESTLEIND NTPC POWERGRID ONGC "
    "JSWSTEEL ADANIENT TATASTEEL HCLTECH COALINDIA BAJAJFINSV INDUSINDBK ASIANPAINT DRREDDY TECHM CIPLA EICHERMOT GRASIM HEROMOTOCO DIVISLAB BRITANNIA HINDALCO UPL BPCL HDFCLIFE SBILIFE M_M SHREECEM"
).split()
THEMES = {
    "interest_rate": "rbi;rate cut;rate hike;repo rate;monetary policy;rate decision",
    "earnings": "earnings;profit;revenue;quarterly;result;eps;ebitda",
    "regulatory": "sebi;regulation;compliance;ban;restriction;fpi;fii;dii",
    "macro": "gdp;inflation;cpi;wpi;manufacturing;pmi;ise",
    "sector_it": "it;tech;tcs;infosys;wipro;hcl tech;software",
    "sector_banking": "bank;hdfc;icici;sbi;kotak;axis;npa;credit growth",
    "sector_oil_gas": "oil;gas;reliance;ongc;petrol;crude;energy",
    "sector_pharma": "pharma;drug;fda;approval;sun pharma;cipla;dr reddy",
    "ipo": "ipo;listing;listing gains;mainboard;sme;nmp",
    "geopolitical": "war;sanction;trade war;tariff;geopolitical;us-china;russia",
    "esg": "esg;green;sustainable;climate;carbon;renewable;solar",
    "fii_dii": "fii;dii;foreign;domestic;inflows;outflows",
}
EVENTS = {
    "earnings_release": "quarterly results;earnings;q1;q2;q3;q4;fy",
    "rate_decision": "rbi;repo rate;rate cut;rate hike;monetary policy",
    "regulatory": "sebi;rbi circular;regulation;compliance;penalty",
    "ipo": "ipo;listing;new issue;fpo;rights issue",
    "m_a": "acquisition;merger;buyout;stake sale;demerger",
    "downgrade_upgrade": "upgrade;downgrade;rating action;outlook",
    "management": "ceo;cfo;resignation;appointed;board",
}
#: Direct impact, spill-over, duration, rise of volatility.
IMPACTS = {
    "earnings": ("high", "medium", "1-5 days", 0.15),
    "regulatory": ("high", "high", "5-30 days", 0.25),
    "macro": ("medium", "high", "1-10 days", 0.20),
    "geopolitical": ("medium", "high", "7-60 days", 0.30),
    "sector": ("high", "medium", "3-15 days", 0.20),
    "company_specific": ("very_high", "low", "1-10 days", 0.35),
}
SEVERITIES = {"low": 0.5, "moderate": 1.0, "high": 1.5, "critical": 2.0}
STOP_WORDS = (
    "what the is a an of in to for and how are was were be been being do does did will would could should can may might this that these those it its with on at by from or not no but "
    "about which who when where why all each every both any"
).split()
COMPARISON = r"(?i)\b(?:compare|difference|vs\.?|versus|between|better|cheaper)\b"
KEYWORDS = r"(?i)\b(?:tax|deduction|section|80C|80D|gst|insurance|mutual fund|fd|ppf|nps|sip|loan|emi|home loan|car loan|education loan|retirement|pension|salary|income|investment|savings)\b"
CONJUNCTION = r"(?i)\s+(?:and|also|plus|along with|as well as)\s+"
VERSUS = r"(?is)^(.*?)\b(?:vs\.?|versus|difference between|compared to|compared with)\b(.*)$"
TOPICS = (
    r"(?i)\b(?:tax|deduction|section \w[\w()]*|gst|insurance|mutual fund|fd|ppf|nps|sip|loan|emi|home loan|car loan|education loan|retirement|pension|salary|income|investment|savings|ltcg|stcg|capital gain|nifty|sensex"
    r"|equity|debt|bond|fixed deposit|recurring deposit|gold|real estate|crypto|elss|ulip)\b"
)
ASPECTS = ["revenue", "earnings", "profit", "growth", "risk", "debt", "cash flow", "dividend", "valuation", "innovation", "regulation", "market share", "guidance", "outlook", "demand"]
CHUNKINGS = {
    "news": "news_article market_commentary".split(),
    "financial_report": "annual_report quarterly_report research_report earnings_transcript sec_filing nse_filing regulatory_filing".split(),
}
#: Start, and what is added for data, for results of tools, for context and for a disclaimer.
CONFIDENCES = {"market_analyst": (0.65, 0.10, 0.10, 0.05, 0.05), "risk_analyst": (0.70, 0.10, 0.10, 0.05, 0.0), "portfolio_manager": (0.65, 0.15, 0.10, 0.0, 0.05)}
DISCLAIMERS = {"market_analyst": "not investment advice;past performance;do your own research", "risk_analyst": "", "portfolio_manager": "not investment advice;past performance;consult your financial advisor;do your own research"}
# End of fixed values.

TICKER_PATTERN = r"(?i)\b(" + "|".join(TICKERS) + r")\b"
SENTENCE_END = r"(?<=[.!?])\s+"


def tickers(text: Column) -> Column:
    """The listed tickers that occur as words of any case, sorted; null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TICKER_PATTERN), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def themes(df: DataFrame, group: str, text: str) -> DataFrame:
    """Themes of each group's texts: how many of a theme's phrases occur in any text, intensity, tickers of the texts that hold one.

    Phrases and tickers are bits of a number each, so that a group's partial state is two numbers a theme, however many texts it has.
    A phrase counts within one text, not across two. Null texts hold nothing.
    """
    low, names = F.lower(F.coalesce(text, F.lit(""))), sorted(TICKERS)
    bit = lambda some, i: F.when(some, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    total = lambda bits: sum(bits[1:], bits[0])
    x = df.select(F.col(group), tickers(F.col(text)).alias("_t"), low.alias("_low"))
    x = x.withColumn("_names", total([bit(F.array_contains("_t", n), i) for i, n in enumerate(names)]))
    x = x.select(group, "_names", *(total([bit(F.contains(F.col("_low"), F.lit(w)), i) for i, w in enumerate(words.split(";"))]).alias(k) for k, words in THEMES.items()))
    x = x.groupBy(group).agg(*(F.struct(F.lit(k).alias("trend"), F.bit_or(F.col(k)).alias("phrases"), F.bit_or(F.when(F.col(k) != 0, F.col("_names")).otherwise(F.lit(0).cast("bigint"))).alias("names")).alias(k) for k in THEMES))
    x = x.select(group, F.explode(F.array(*THEMES)).alias("t")).where("t.phrases != 0")
    n = F.bit_count("t.phrases").cast("bigint")
    held = F.array_compact(F.array(*(F.when(F.col("t.names").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, name) for i, name in enumerate(names))))
    return x.select(group, "t.trend", n.alias("keyword_hits"), F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low").alias("intensity"), held.alias("tickers"))


def event_kind(text: Column) -> Column:
    """The first kind of event of which a phrase occurs; null where none does."""
    return F.nullif(first_kind(F.lower(F.coalesce(text, F.lit(""))), EVENTS, "none"), F.lit("none"))


def severity(score: Column) -> Column:
    return F.when(F.abs(score) > 0.6, "high").when(F.abs(score) > 0.2, "moderate").otherwise("low")


def direction(score: Column) -> Column:
    return F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")


def impact(score: Column, kind: Column, severity: Column) -> list[Column]:
    """Direction, expected price change, rise of volatility, duration, direct impact and spill-over; an unknown kind is as ``macro``, an unknown severity as ``moderate``."""
    known = F.when(kind.isin(*IMPACTS), kind).otherwise("macro")
    strength = F.when(severity.isin(*SEVERITIES), severity).otherwise("moderate")

    def of(key: Column, values: dict) -> Column:
        out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
        for k, v in values.items():
            out = out.when(key == k, F.lit(v))
        return out

    size = F.round(0.02 * of(strength, SEVERITIES) * (F.abs(score) + 0.3) + 1e-9, 4)
    rise = of(F.concat_ws(":", known, strength), {f"{k}:{s}": round(v[3] * m, 2) for k, v in IMPACTS.items() for s, m in SEVERITIES.items()})
    to = direction(score)
    return [
        to.alias("direction"), F.when(to == "positive", size).when(to == "negative", -size).otherwise(0.0).alias("price_change"), rise.alias("volatility_rise"),
        *(of(known, {k: v[i] for k, v in IMPACTS.items()}).alias(n) for i, n in ((2, "duration"), (0, "direct_impact"), (1, "spillover"))),
    ]


def impact_by_ticker(events: DataFrame) -> DataFrame:
    """``events``: ``tickers``, ``direction``, ``price_change``, ``severity``. Counts, net direction, mean change and severity of each ticker."""
    x = events.select(F.explode("tickers").alias("ticker"), "direction", "price_change", "severity").groupBy("ticker")
    up, down = F.count_if(F.col("direction") == "positive"), F.count_if(F.col("direction") == "negative")
    return x.agg(
        F.count("*").alias("events"), up.alias("positive"), down.alias("negative"), F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral").alias("net_direction"),
        F.round(F.avg("price_change"), 6).alias("mean_change"), F.when(F.bool_or(F.col("severity") == "high"), "high").otherwise("moderate").alias("severity"),
    )


def complexity(question: Column) -> Column:
    """Points for conjunctions, question marks, comparisons and topics; from 2 on a question is taken apart."""
    many = lambda pattern, most: F.least(F.regexp_count(question, F.lit(pattern)), F.lit(most))
    topics = F.size(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(KEYWORDS), 0), F.lower)))
    return many(r"(?i)\band\b", 2) + many(r"\?", 2) + question.rlike(COMPARISON).cast("int") + F.least(topics, F.lit(3))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parts(question: Column) -> Column:
    """Sub-questions: by conjunctions, else by a comparison, else one for each of several topics and the question itself, else the question."""
    pieces = F.filter(F.transform(F.split(question, CONJUNCTION), _stripped), lambda p: F.length(p) > 10)
    left, right = (_stripped(F.regexp_extract(question, VERSUS, i)) for i in (1, 2))
    compared = F.array(F.concat(F.lit("What is "), left, F.lit("?")), F.concat(F.lit("What is "), right, F.lit("?")), F.concat(F.lit("How does "), left, F.lit(" compare with "), right, F.lit("?")))
    topics = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(TOPICS), 0), F.lower))
    asked = F.concat(F.transform(topics, lambda t: F.concat(F.lit("What are the rules and benefits related to "), t, F.lit("?"))), F.array(question))
    return F.when(F.size(pieces) >= 2, pieces).when((left != "") & (right != ""), compared).when(F.size(topics) >= 2, asked).otherwise(F.array(question))


def terms_of(question: str) -> list[str]:
    """The words of a question that are no stop words, sorted."""
    return sorted(set(re.findall(r"\w+", question.lower())) - set(STOP_WORDS))


def _shared(sentence: Column, terms: Sequence[str]) -> Column:
    words = F.split(F.lower(sentence), r"[^\p{L}\p{N}_]+")
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))


def compressed(text: Column, terms: Sequence[str], most: int = 1500) -> Column:
    """The first sentence, short ones and those that share a term, at most ``most`` characters; without terms the text as it is."""
    if not terms:
        return text
    kept = F.array_join(F.filter(F.split(text, SENTENCE_END), lambda s, i: (i == 0) | (F.length(s) < 50) | (_shared(s, terms) > 0)), " ")
    return F.when(F.length(kept) > most, F.concat(F.substring(kept, 1, most), F.lit("..."))).otherwise(kept)


def highlight(text: Column, terms: Sequence[str], most: int = 250) -> Column:
    """The sentence of over 30 characters that shares most terms (the first of equals; the first of all if none does), cut to a window around its first term."""
    ranked = F.transform(F.split(text, SENTENCE_END), lambda s, i: F.struct(F.when(F.length(s) > 30, _shared(s, terms)).otherwise(0).alias("shared"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(ranked)["s"]
    places = [F.nullif(F.instr(F.lower(best), t), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.length(best) + 1) - 1 if places else F.length(best)
    window = F.substring(best, F.greatest(F.lit(0), first - 50) + 1, F.lit(most))
    return F.when(F.length(best) > most, F.concat(F.lit("..."), window, F.lit("..."))).otherwise(best)


def aspects(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``aspect``, ``n_sentences`` and ``combined`` for each aspect that a text's sentences mention (a word that begins with it); null texts have none."""
    sentences = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    mention = lambda a: lambda s: s.rlike(rf"(?i)\b({a}[a-z]*)\b")
    about = [F.struct(F.lit(a).alias("aspect"), F.filter("_s", mention(a)).alias("found")) for a in ASPECTS]
    x = df.select(key, sentences.alias("_s")).select(key, F.inline(F.array(*about))).where(F.size("found") > 0)
    return x.select(key, "aspect", F.size("found").cast("bigint").alias("n_sentences"), F.array_join(F.transform("found", _stripped), " ").alias("combined"))


def chunking(kind: Column, default: str = "recursive") -> Column:
    """The way to cut a document of a kind."""
    out = F.when(F.lit(False), default)
    for way, kinds in CHUNKINGS.items():
        out = out.when(kind.isin(*kinds), way)
    return out.otherwise(default)


def confidence(agent: str, text: Column, data: Column, tools: Column, context: Column) -> Column:
    """Confidence in an agent's answer, 0 to 1: a start and a gain for each sign of support; texts over 300 characters gain 0.05."""
    start, *gains = CONFIDENCES[agent]
    warned = F.lit(False)
    for phrase in filter(None, DISCLAIMERS[agent].split(";")):
        warned = warned | F.contains(F.lower(text), F.lit(phrase))
    signs = [*zip((data, tools, context, warned), gains), (F.length(text) > 300, 0.05)]
    return F.round(F.least(F.lit(1.0), sum((F.when(sign, gain).otherwise(0.0) for sign, gain in signs), F.lit(start))), 2)
