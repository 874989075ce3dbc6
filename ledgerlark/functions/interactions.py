"""What is remembered of an interaction: kind, sentiment, importance, entities and insights, from the results of its agents.

``agents`` is an array of (``name``, ``data``), in order; ``data`` maps names to values as text, lists as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of event by a part of an agent's name, in order.
EVENT_KINDS = {
    "portfolio": "portfolio_query", "stock": "stock_analysis", "market": "market_analysis", "risk": "risk_assessment", "news": "news_retrieval", "screener": "stock_screening",
    "watchlist": "watchlist_update", "alert": "alert_management", "backtest": "backtest_run", "sentiment": "sentiment_analysis", "financials": "financial_analysis",
}
#: Names of agents whose events weigh more.
WEIGHTY = ["portfolio", "trade", "backtest", "risk"]
#: Phrases that state a preference.
PREFERENCES = ["i prefer", "i like", "i want", "i need", "my risk", "always use", "never use", "default to", "my goal"]
#: Names under which agents give amounts, in order.
AMOUNTS = ["amount", "value", "price", "total", "gain", "loss"]

def _none() -> Column:
    return F.array().cast("array<string>")


def _agents(agents: Column) -> Column:
    return F.filter(agents, lambda a: a.isNotNull())


def _value(a: Column, name: str) -> Column:
    return F.try_element_at(a["data"], F.lit(name))


def _listed(value: Column) -> Column:
    """The texts of a JSON list, or the one text that is no list."""
    return F.when(value.isNull(), _none()).when(F.ltrim(value).startswith("["), F.coalesce(F.from_json(value, "array<string>"), _none())).otherwise(F.array(value))


def event_kind(agents: Column) -> Column:
    """By the first agent whose name has one of the parts; ``general_query`` if none has, or there is no agent."""

    def kind(a: Column) -> Column:
        out, name = F.when(F.lit(False), ""), F.lower(a["name"])
        for part, k in EVENT_KINDS.items():
            out = out.when(F.contains(name, F.lit(part)), k)
        return out

    found = F.filter(F.transform(_agents(agents), kind), lambda k: k.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("general_query"))


def sentiment(agents: Column) -> Column:
    """The first that an agent states, as ``sentiment`` or else ``overall_sentiment``; ``neutral`` without one."""
    stated = lambda a: F.lower(F.coalesce(F.nullif(_value(a, "sentiment"), F.lit("")), _value(a, "overall_sentiment")))
    known = F.filter(F.transform(_agents(agents), stated), lambda s: s.isin("positive", "negative", "neutral"))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("neutral"))


def importance(agents: Column) -> Column:
    """0.3, and 0.2 for each weighty agent and 0.1 for each with over five results, 1 at most; exact to two digits."""
    of = _agents(F.coalesce(agents, F.array().cast("array<struct<name:string,data:map<string,string>>>")))
    weighty = F.size(F.filter(of, lambda a: F.lower(a["name"]).isin(WEIGHTY)))
    large = F.size(F.filter(of, lambda a: F.coalesce(F.size(a["data"]), F.lit(0)) > 5))
    return F.least(F.lit(10), 3 + 2 * weighty + large) / 10


def tickers(agents: Column) -> Column:
    """In capitals, each once, sorted."""
    each = lambda a: F.concat(*(_listed(_value(a, n)) for n in ("ticker", "symbol", "tickers", "symbols")))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(_agents(agents), each)), F.upper))), _none())


def amounts(agents: Column) -> Column:
    """Numbers under the names of amounts, by agent and name; what is no number is left out."""
    each = lambda a: F.filter(F.array(*(_value(a, n).try_cast("double") for n in AMOUNTS)), lambda x: x.isNotNull())
    return F.coalesce(F.flatten(F.transform(_agents(agents), each)), F.array().cast("array<double>"))


def insights(question: Column, agents: Column) -> Column:
    """An array of (``content``, ``kind``, ``tags``, ``importance``): at most one stated preference, then for each agent the facts of a share and the size of a portfolio."""

    def of(content, kind, tags, weight):
        return F.struct(content.alias("content"), F.lit(kind).alias("kind"), tags.alias("tags"), F.lit(weight).alias("importance"))

    words = lambda *w: F.array(*map(F.lit, w))
    states = F.lit(False)
    for phrase in PREFERENCES:
        states = states | F.contains(F.lower(question), F.lit(phrase))
    preference = F.when(states, of(F.concat(F.lit("User preference: "), F.regexp_replace(question, r"^\s+|\s+$", "")), "preference", words("preference", "user-stated"), 0.8))

    def fact(a: Column) -> Column:
        ticker = F.coalesce(_value(a, "ticker"), _value(a, "symbol"), F.lit("unknown"))
        told = [F.concat(F.lit(f"{label}: "), _value(a, n)) for n, label in (("pe_ratio", "P/E ratio"), ("market_cap", "Market cap"), ("sector", "Sector"))]
        known = _value(a, "pe_ratio").isNotNull() | _value(a, "market_cap").isNotNull()
        return F.when(known, of(F.concat_ws(" | ", ticker, *told), "financial_fact", F.when(ticker == "unknown", words("fundamentals")).otherwise(F.array(ticker, F.lit("fundamentals"))), 0.5))

    def size(a: Column) -> Column:
        both = [F.when(F.ltrim(_value(a, n)).startswith("["), F.size(F.from_json(_value(a, n), "array<string>"))) for n in ("positions", "holdings")]
        n = F.coalesce(F.nullif(both[0], F.lit(0)), both[1])
        return F.when(n > 0, of(F.concat(F.lit("Portfolio has "), n.cast("string"), F.lit(" positions")), "portfolio_state", words("portfolio", "holdings"), 0.4))

    each = F.flatten(F.transform(_agents(agents), lambda a: F.array(fact(a), size(a))))
    return F.filter(F.concat(F.array(preference), F.coalesce(each, F.array().cast("array<struct<content:string,kind:string,tags:array<string>,importance:double>>"))), lambda x: x.isNotNull())
