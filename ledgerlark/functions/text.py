"""Text functions as column expressions; Python only for the chunkers, whose cuts depend on those before."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import with_package

# The word lists, patterns and weights of the heuristics below.
SENTIMENT_WORDS = {
    "strongly_bearish": "crash;plunge;massive loss;bankrupt;fraud;scam;severe downgrade;crisis;collapse;devastating;bloodbath;rout;panic;fear;doom",
    "bearish": "decline;drop;fall;loss;downgrade;weak;disappointing;miss;below expectations;cut;slowdown;concern;risk;warning;slump",
    "neutral": "stable;flat;unchanged;steady;hold;maintain;in-line;as expected;mixed;moderate;average",
    "bullish": "rise;gain;growth;upgrade;beat;strong;above expectations;positive;rally;surge;optimistic;confident;opportunity;expansion",
    "strongly_bullish": "record high;breakthrough;exceptional;outstanding;massive growth;blockbuster;stellar;explosive;soaring;skyrocket;triumph;phenomenal",
}
SENTIMENT_WEIGHTS = {"strongly_bearish": -2, "bearish": -1, "neutral": 0, "bullish": 1, "strongly_bullish": 2}
BULL_WORDS = "surge jump rally gain profit growth beat upgrade outperform strong record bullish soar boost improve exceed positive optimistic".split()
BEAR_WORDS = "drop fall decline loss crash slump miss downgrade underperform weak bearish plunge cut reduce warning negative risk debt".split()
CATEGORIES = {
    "tax": "income tax;tax slab;tds;itr;advance tax;section 80",
    "insurance": "health insurance;life insurance;premium;claim",
    "investment": "mutual fund;sip;equity;bond;fd;ppf;nps",
    "retirement": "retirement;pension;epf;vpf;gratuity",
    "regulation": "sebi;rbi;regulation;compliance;guidelines",
    "gst": "gst;goods and services tax;igst;cgst;sgst",
}
QUERY_KINDS = {
    "risk_query": "risk;var;drawdown;volatility;hedge;stress test;sharpe;beta;correlation;max loss;downside",
    "portfolio_query": "portfolio;allocation;rebalance;weight;diversif;optimize;optimise;asset mix;construct",
    "personal_finance_query": "budget;save;savings;emi;insurance;tax;retire;mutual fund sip;fd;fixed deposit;expense;income;salary;loan;mortgage",
    "market_query": "stock;share;nifty;sensex;index;price;earnings;dividend;ipo;market;sector;gdp;inflation;rbi;fed;interest rate;bull;bear;rally;crash",
}
URL_KINDS = [
    (r"sec\.gov|\.gov/edgar|10-[kq]", "sec_filing"), (r"nseindia|bseindia|\.pdf.*filing|regulation", "nse_filing"), (r"transcript|earnings.call|conference.call", "earnings_transcript"), (r"annual.?report|annual.?review", "annual_report"),
    (r"quarterly|q[1234].?result", "quarterly_report"), (r"news|article|blog|press.?release", "news_article"), (r"research|analysis|report|note", "research_report"),
]
SECTOR_WORDS = {
    "BANKING": "bank;banking;hdfc;sbi;icici;kotak;axis", "IT": "it ;infotech;infosys;tcs;wipro;hcl;tech", "PHARMA": "pharma;pharmaceutical;sun pharma;cipra;dr reddy", "OIL_GAS": "oil;gas;reliance;ongc;petroleum;energy",
    "FMCG": "fmcg;itc;hindustan;nestle;britannia;consumer", "AUTO": "auto;maruti;tata motors;mahindra;vehicle;ev", "REAL_ESTATE": "real estate;dlf;godrej prop;housing;construction",
}
TICKER = r"\b([A-Z]{2,5}(?:\.[A-Z]{1,2})?)\b"


def hits(text: Column, words: str) -> Column:
    """How many of the ``;``-separated phrases occur in ``text`` (each once)."""
    out = F.lit(0)
    for w in words.split(";"):
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def first_kind(text: Column, kinds: dict[str, str], default: str) -> Column:
    """The first kind of which a phrase occurs in ``text``."""
    out = F.when(F.lit(False), default)
    for kind, words in kinds.items():
        some = F.lit(False)
        for w in words.split(";"):
            some = some | F.contains(text, F.lit(w))
        out = out.when(some, kind)
    return out.otherwise(default)


def all_kinds(text: Column, kinds: dict[str, str]) -> Column:
    """Every kind of which a phrase occurs, in order."""
    return F.array_compact(F.array(*(F.when(hits(text, w) > 0, k) for k, w in kinds.items())))


def keyword_sentiment(df: DataFrame, text: str) -> DataFrame:
    """``label``, ``score`` (-1 to 1) and ``confidence`` from the phrases that occur in each text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    x = df.select("*", *(hits(low, w).alias(f"_{k}") for k, w in SENTIMENT_WORDS.items()))
    total, net = F.lit(0), F.lit(0)
    for k, w in SENTIMENT_WEIGHTS.items():
        total, net = total + F.col(f"_{k}"), net + w * F.col(f"_{k}")
    x = x.withColumn("hits", total).withColumn("score", F.round(F.when(F.col("hits") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net / F.col("hits") / 2))).otherwise(0.0), 9))
    s = F.col("score")
    label = F.when(F.col("hits") == 0, "neutral").when(s <= -0.6, "strongly_bearish").when(s <= -0.2, "bearish").when(s <= 0.2, "neutral").when(s <= 0.6, "bullish").otherwise("strongly_bullish")
    confidence = F.when(F.col("hits") == 0, 0.5).otherwise(F.least(F.col("hits") / 5, F.lit(1.0)))
    return x.withColumn("label", label).withColumn("confidence", F.round(confidence, 2)).drop("hits", *(f"_{k}" for k in SENTIMENT_WORDS))


def words_of(text: Column) -> Column:
    """Distinct words (runs of ASCII letters, digits and _), in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != ""))


def bull_bear(text: Column) -> tuple[Column, Column]:
    """(sentiment, score): distinct words of two lists, 0.5 plus or minus a tenth for each more of one than of the other."""
    w = words_of(text)
    diff = F.size(F.array_intersect(w, F.array(*map(F.lit, BULL_WORDS)))) - F.size(F.array_intersect(w, F.array(*map(F.lit, BEAR_WORDS))))
    return F.when(diff > 0, "positive").when(diff < 0, "negative").otherwise("neutral"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + diff * 0.1)), 6)


def url_kind(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, kind in URL_KINDS:
        out = out.when(F.lower(url).rlike(pattern), kind)
    return out.otherwise("web_article")


def truncated(text: Column, n: int = 500, suffix: str = "...") -> Column:
    """At most ``n`` characters, cut at the last space if that is past 70 % of them."""
    head = F.substring(text, 1, n - len(suffix))
    space = F.length(head) - F.instr(F.reverse(head), " ")
    head = F.when((F.instr(head, " ") > 0) & (space > n * 0.7), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(head, F.lit(suffix)))


def large_number(x: Column) -> Column:
    """Crores, lakhs, thousands, or the number, with two digits."""
    a, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    return F.when(a >= 1e7, F.concat(sign, F.lit("₹"), two(a / 1e7), F.lit("Cr"))).when(a >= 1e5, F.concat(sign, F.lit("₹"), two(a / 1e5), F.lit("L"))).when(a >= 1e3, F.concat(sign, two(a / 1e3), F.lit("K"))).otherwise(F.concat(sign, two(a)))


def sized_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters, ended at a space of the last 100 if there is one; each begins ``overlap`` before the last's end, so the text's last characters may come twice."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.rfind(" ", end - min(100, size), end)
            end = space if space > start else end
        out.append(text[start:end].strip())
        start = max(end - overlap, start + 1)
    return [c for c in out if c]


def with_overlap(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk after the end of the one before it, which has its own overlap by then."""
    out = chunks[:1]
    for c in chunks[1:]:
        out.append(f"{out[-1][-overlap:]}\n{c}" if overlap > 0 else c)
    return out


def recursive_chunks(text: str, size: int = 1000, overlap: int = 200, marks: Sequence[str] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Split at the first mark that occurs, and what is still longer than ``size`` by the marks after it, at last by size.
    Marks are dropped, small pieces stay small, and each level puts the end of a piece before the next."""
    mark = next((m for m in marks if m in text), None)
    if mark is None:
        return sized_chunks(text, size, overlap)
    rest, found = marks[marks.index(mark) + 1 :], []
    for part in filter(str.strip, text.split(mark)):
        found += [part] if len(part) <= size else recursive_chunks(part, size, overlap, rest)
    return with_overlap(found, overlap)


def merged_short(chunks: Sequence[str], least: int) -> list[str]:
    """Chunks shorter than ``least`` take the next ones to them, by line feeds."""
    out: list[str] = []
    for c in chunks:
        if out and len(out[-1]) < least:
            out[-1] += "\n" + c
        else:
            out.append(c)
    return out


def similar_chunks(found: Sequence[str], most: int = 2048, back: int = 3, threshold: float = 0.3) -> list[str]:
    """Sentences joined while each shares enough words (Jaccard) with the ``back`` before it and the chunk stays within ``most`` characters."""
    bag = lambda t: set(re.findall(r"\b\w+\b", t.lower()))
    out: list[list[str]] = []
    for s in found:
        a, b = bag(" ".join(out[-1][-back:])) if out else set(), bag(s)
        alike = bool(a and b) and len(a & b) / len(a | b) >= threshold
        if alike and len(" ".join([*out[-1], s])) <= most:
            out[-1].append(s)
        else:
            out.append([s])
    return [" ".join(c) for c in out]


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\n")
_ABBREVIATION = re.compile(r"(?:^|\W)(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|Inc|Ltd|Corp|vs|etc|e\.g|i\.e)\.$")


def sentences(text: str) -> list[str]:
    """Sentences; the period of an abbreviation ends none."""
    out: list[str] = []
    for part in _SENTENCE_END.split(text):
        if out and _ABBREVIATION.search(out[-1]):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return [s.strip() for s in out if s.strip()]


def chunked(df: DataFrame, id_col: str, text_col: str, cut, most: int = 1 << 20) -> DataFrame:
    """Rows (``id_col``, ``chunk``, ``text``) of ``cut(text)`` for each text, in Arrow batches; null texts have none.

    A batch of chunks goes out once it has ``most`` characters, in the middle of a text too, so a task holds the chunks of one text and ``most`` characters, however many texts a batch brings.
    """
    with_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type
            ids, at, out, size = [], [], [], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                i = i.as_py()
                for k, c in enumerate(cut(t.as_py() or "")):
                    ids.append(i)
                    at.append(k)
                    out.append(c)
                    size += len(c)
                    if size >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(at, pa.int64()), pa.array(out, pa.string())], ["id", "chunk", "text"])
                        ids, at, out, size = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(at, pa.int64()), pa.array(out, pa.string())], ["id", "chunk", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, chunk long, text string").withColumnRenamed("id", id_col)


#: Headings that an answer must not carry.
ANSWER_HEADINGS = ["Executive Summary", "Detailed Analysis", "Confidence Level", "Sources Used", "Key Takeaways", "Suggested Follow-up", "Agents:", "Confidence:", "Sources:", "Agent:"]


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """Each phrase taken out wherever it stands, one phrase after the other, then white space at the ends; null stays null."""
    for p in phrases:
        text = F.replace(text, F.lit(p), F.lit(""))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def batched(values: Column, size: int) -> Column:
    """An array's values in arrays of ``size``, the last of what is left; none for an empty one, null for null."""
    n = F.ceil(F.size(values) / size).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * size + 1, F.lit(size)))).when(values.isNotNull(), F.slice(F.array(values), 1, 0))
