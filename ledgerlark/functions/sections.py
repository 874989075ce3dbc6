"""Chunks by headings, headlines, vectors of sentences and packed sections."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import CATEGORIES, first_kind, recursive_chunks

# Headings of financial reports, as patterns.
HEADINGS = [
    "Executive Summary", "Management Discussion", "MD&A", "Financial Summary", "Income Statement", "Balance Sheet", "Cash Flow", "Risk Factors", "Business Overview",
    "Results of Operations", "Liquidity and Capital Resources", "Market Risk", "Outlook", "Forward[- ]Looking Statements", "Revenue", "Expenses", "Net (?:Income|Profit|Loss)",
    "Earnings (?:Per Share|Call|Transcript)", "Shareholder", "Dividend", "Capital Expenditure", "Segment Performance", "Quarterly (?:Results|Highlights)", "Directors.+Report", "Auditors.+Report",
]
_HEADING = re.compile(rf"(?:^|\n)(?:#{{1,3}}\s+|\d+\.?\s+)(?:{'|'.join(HEADINGS)})", re.IGNORECASE)


def report_sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of each section of a report: what stands before the first heading has the heading ''. Only marks of a heading and white space at the ends are not part of either."""
    marks = list(_HEADING.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    lead = [("", text[: marks[0].start()].strip())] if marks else [("", text.strip())]
    return lead + [(m.group().strip(), text[m.end() : e].strip()) for m, e in zip(marks, ends)]


def report_chunks(text: str, size: int = 2000, overlap: int = 200, lead: bool = False) -> list[str]:
    """Sections of a report, each under its heading; a section that is too long with it is cut, its heading before the first part.

    Texts without headings are cut as any text. ``lead`` keeps what stands before the first heading too.
    """
    sections = report_sections(text)
    if len(sections) == 1:
        return recursive_chunks(text, size, overlap)
    out = []
    for heading, body in sections if lead else sections[1:]:
        if not body:
            continue
        under = f"{heading}\n" if heading else ""
        parts = [body] if len(under) + len(body) <= size else recursive_chunks(body, size, overlap)
        out += [under * (k == 0) + part for k, part in enumerate(parts)]
    return out


def headline_chunks(text: str, size: int = 1500, overlap: int = 150) -> list[str]:
    """Paragraphs packed up to ``size`` characters, each chunk after the headline, the first line that is not blank; a longer paragraph is cut, and its last part goes on."""
    headline, _, body = text.strip().partition("\n")
    headline = headline.strip()
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", body.strip()) if p.strip()]
    if not paragraphs:
        return [headline or text]
    packs: list[str] = []
    held = ""
    for p in paragraphs:
        joined = f"{held}\n\n{p}" if held else p
        if len(joined) <= size:
            held = joined
            continue
        packs += [held] if held else []
        *whole, held = recursive_chunks(p, size, overlap) if len(p) > size else [p]
        packs += whole
    return [f"[Headline: {headline}]\n\n{c}" for c in [*packs, held] if c]


def seeded_vector(text: str, dims: int = 384) -> list[float]:
    """Numbers between -1 and 1 drawn with the text's MD5 as the seed: a stand-in where no model is at hand."""
    draw = random.Random(int(hashlib.md5(text.encode()).hexdigest(), 16))
    return [draw.uniform(-1, 1) for _ in range(dims)]


def word_vector(text: str, dims: int = 64) -> list[float]:
    """A vector of a text's words: each adds 1 in the dimension that its checksum names."""
    v = [0.0] * dims
    for w in re.findall(r"\w+", text.lower()):
        v[zlib.crc32(w.encode()) % dims] += 1
    return v


def vector_chunks(found: Sequence[str], embed: Callable[[str], Sequence[float]], most: int = 2048, back: int = 3, threshold: float = 0.5) -> list[str]:
    """Sentences joined until one is not alike the one ``back`` before it (cosine under ``threshold``), or with it the chunk has ``most`` characters; that one begins the next chunk."""
    if not found:
        return []
    v = np.array([embed(s) for s in found], np.float32)
    norms = np.linalg.norm(v, axis=1)
    n = norms[back:] * norms[: len(norms) - back if len(norms) > back else 0]
    dots = (v[back:] * v[: max(0, len(v) - back)]).sum(1)
    alike = np.divide(dots, n, out=np.zeros(len(n)), where=n > 0) >= threshold
    out, start, size = [], 0, sum(len(s) + 1 for s in found[:back]) - 1
    for i in range(back, len(found)):
        size += 1 + len(found[i])
        if not alike[i - back] or size >= most:
            if i > start:
                out.append(" ".join(found[start:i]))
            start, size = i, len(found[i])
    return [*out, " ".join(found[start:])]


def packed_sections(df: DataFrame, url: str, title: str, content: str, size: int = 2000) -> DataFrame:
    """Sections (parted by blank lines) packed in their order into chunks of up to ``size`` characters, with stable ids.

    Each section goes to the open chunk if both fit, with the blank line between them; a section longer than ``size`` is a chunk of its own, uncut. All inside the
    JVM: a fold over the sections holds the open chunk. Returns ``doc_id`` (24 digits of the SHA-256 of address, title and number), ``chunk``, ``content``, ``title``, ``source``,
    ``category``. Null addresses and titles count as empty; blank contents give no chunk.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    sections = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\n{2,}"), strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def fold(a: Column, s: Column) -> Column:
        full = (F.length(a["open"]) + F.length(s) + 2 > size) & (a["open"] != "")
        return F.struct(
            F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"),
            F.when(full | (a["open"] == ""), s).otherwise(F.concat(a["open"], F.lit("\n\n"), s)).alias("open"),
        )

    chunks = F.aggregate(sections, start, fold, lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"]))
    key = [F.coalesce(c, F.lit("")) for c in (url, title)]
    x = df.select(key[0].alias("source"), key[1].alias("title"), F.posexplode(chunks).alias("chunk", "content"))
    made = F.substring(F.sha2(F.concat_ws(":", "source", "title", F.col("chunk").cast("string")), 256), 1, 24)
    return x.select(made.alias("doc_id"), "chunk", "content", "title", "source", first_kind(F.lower("content"), CATEGORIES, "general").alias("category"))
