"""News feeds: RSS and Atom by Spark's XML functions, and articles of a news service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of sources by the domains of their feeds.
SOURCES = {"moneycontrol.com": "Moneycontrol", "economictimes.indiatimes.com": "Economic Times", "livemint.com": "LiveMint", "feeds.reuters.com": "Reuters India"}

#: A text element, with or without attributes.
_TEXT = "struct<_VALUE:string,_type:string>"
_FEED = f"""struct<channel:struct<item:array<struct<title:{_TEXT},link:string,pubDate:string,date:string,description:{_TEXT},encoded:{_TEXT},content:{_TEXT}>>>,
 entry:array<struct<title:{_TEXT},link:array<struct<_href:string>>,published:string,updated:string,summary:{_TEXT},description:{_TEXT},content:{_TEXT}>>,_broken:string>"""


def clean_html(text: Column) -> Column:
    """Without tags, with the common character references decoded, white space as single spaces."""
    x = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def article_id(url: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))), 256), 1, 24)


def source_name(url: Column) -> Column:
    domain = F.replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lit("www."), F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair)), domain), domain)


def parse_feeds(df: DataFrame, url_col: str, xml_col: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Articles of feeds, and the feeds that are no XML.

    Each row of ``df`` is a feed: its address and its text. An RSS feed's items, or else an Atom feed's entries, are read by ``from_xml``
    under one schema, the first ``most`` of a feed in their order. Content comes from the content element, or else the description (its
    first 500 characters). Entries without address, or without title and content, are left out. The second frame has
    ``url`` and ``text`` of feeds that are malformed, null or neither kind, kept aside whole rather than lost.
    """
    feed = F.from_xml(F.regexp_replace(F.col(xml_col), r"(</?)(?:content|dc):", "$1"), _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true", "rowTag": "feed"})
    x = df.select(F.col(url_col).alias("feed"), F.col(xml_col).alias("text"), feed.alias("x"))
    bad = F.coalesce(F.col("x._broken").isNotNull() | (F.col("x.channel").isNull() & F.col("x.entry").isNull()), F.lit(True))
    value = lambda e, name: F.trim(F.coalesce(e[name]["_VALUE"], F.lit("")))
    rss = F.transform("x.channel.item", lambda e: F.struct(
        value(e, "title").alias("title"), F.trim(e["link"]).alias("url"), F.coalesce(e["pubDate"], e["date"], F.lit("")).alias("published"),
        F.coalesce(e["encoded"]["_VALUE"], e["content"]["_VALUE"]).alias("content"), e["description"]["_VALUE"].alias("description")))
    atom = F.transform("x.entry", lambda e: F.struct(
        value(e, "title").alias("title"), F.trim(F.try_element_at(e["link"], F.lit(1))["_href"]).alias("url"), F.coalesce(e["published"], e["updated"], F.lit("")).alias("published"),
        e["content"]["_VALUE"].alias("content"), F.coalesce(e["description"]["_VALUE"], e["summary"]["_VALUE"]).alias("description")))
    a = x.where(~bad).select("feed", F.posexplode(F.when(F.size("x.channel.item") > 0, rss).otherwise(atom)).alias("n", "e")).where(F.col("n") < most)
    full = clean_html(F.coalesce("e.content", F.lit("")))
    brief = F.substring(clean_html(F.coalesce("e.description", F.lit(""))), 1, 500)
    a = a.select("feed", "n", "e.title", "e.url", "e.published", F.when(full != "", full).otherwise(brief).alias("content"))
    a = a.where((F.coalesce("url", F.lit("")) != "") & ((F.col("title") != "") | (F.col("content") != "")))
    out = a.select(article_id(F.col("url"), F.col("title")).alias("article_id"), "title", source_name(F.col("feed")).alias("source"), "url", F.col("published").alias("published_at"),
                   "content", F.substring("content", 1, 500).alias("summary"), F.lit("rss").alias("source_type"), "feed", "n")
    return out, x.where(bad).select(F.col("feed").alias("url"), "text")


def read_feeds(spark: SparkSession, path: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Feed files (one feed a file, of any store that Spark reads), as :func:`parse_feeds`; a feed's address is its file's."""
    return parse_feeds(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed"), "value"), "feed", "value", most)


def normalised_articles(df: DataFrame) -> DataFrame:
    """Articles of a news service (title, description, content, url, source name, publishedAt) as a table of articles.

    The mark of cut content (``[+123 chars]``) is taken off; articles without title and content are left out.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    content = F.trim(F.regexp_replace(text("content"), r"\[\+\d+\s*chars\]", ""))
    x = df.select(text("title").alias("title"), text("description").alias("summary"), text("content").alias("raw"), content.alias("content"), text("url").alias("url"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("publishedAt", F.lit("")).alias("published_at"))
    x = x.where((F.col("title") != "") | (F.col("raw") != ""))
    return x.select(article_id(F.col("url"), F.col("title")).alias("article_id"), "title", "source", "url", "published_at", "content", "summary", F.lit("newsapi").alias("source_type"))
