"""Searches made of searches: questions taken apart, and two collections reranked together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import news
from ledgerlark.functions.vectors import cosine
from ledgerlark.operators.retrieval import best_of


def _start(length: int):
    return F.substring(F.trim(F.coalesce("content", F.lit(""))), 1, length)


def decomposed(asked: DataFrame, query_col: str, text_col: str, search: Callable[[DataFrame], DataFrame], contents: DataFrame, id_col: str, k: int, gain: float = 0.05, prefix: int = 300) -> DataFrame:
    """The ``k`` best rows a question, where a complex one is taken apart and its parts are searched for, each once.

    ``search`` gets ``sub`` and ``text`` and gives ``sub``, ``id_col``, ``score`` (up to 1) for all parts of all questions at once; ``contents``: ``id_col``, ``content``. Results that begin alike
    (trimmed, ``prefix`` characters) are one, known by the first: that of the earliest part, then of the greatest score, then of the least id. Its score grows by ``gain`` for each further one, to 1 at most.
    Returns ``query_col``, ``id_col``, ``score``, ``parts`` (how many found it), ties by id. Null questions find nothing.
    """
    q = F.col(text_col)
    whole = asked.where(q.isNotNull()).select(query_col, F.array_distinct(F.when(news.complexity(q) >= 2, news.parts(q)).otherwise(F.array(q))).alias("p"))
    subs = whole.select(query_col, F.posexplode("p").alias("at", "text")).select(F.struct(F.col(query_col).alias("q"), "at").alias("sub"), "text")
    found = search(subs).join(contents.select(id_col, _start(prefix).alias("start")), id_col)
    first = F.struct(F.col("sub.at").alias("at"), (-F.col("score")).alias("s"), F.col(id_col).alias("id"))
    one = found.groupBy(F.col("sub.q").alias(query_col), "start").agg(F.min(first).alias("f"), F.count("*").alias("n"), F.count_distinct("sub.at").alias("parts"))
    gained = F.when(F.col("n") > 1, F.least(F.lit(1.0), -F.col("f.s") + gain * (F.col("n") - 1))).otherwise(-F.col("f.s"))
    return best_of(one.select(query_col, F.col("f.id").alias(id_col), F.round(gained, 6).alias("score"), "parts"), query_col, id_col, k)


def reranked(lists: DataFrame, vectors: DataFrame, asked: DataFrame, contents: DataFrame, query_col: str, id_col: str, k: int, least: float, share: float = 0.4, prefix: int = 200) -> DataFrame:
    """The ``k`` best rows a query of fetched ``lists`` (``query_col``, ``id_col``, ``score``; more than are wanted, of any number of collections).

    A score becomes ``share`` of itself and for the rest the cosine of the query's and the row's vector (``asked``: ``query_col``, ``vector``; ``vectors``: ``id_col``, ``vector``; an absent or zero vector
    has cosine 0). Scores under ``least`` go; of rows that begin alike (trimmed, ``prefix`` characters) the one of the greatest score stays, ties by id. Only fetched rows meet their vectors and contents.
    """
    x = lists.join(asked.select(query_col, F.col("vector").alias("_q")), query_col, "left").join(vectors.select(id_col, F.col("vector").alias("_v")), id_col, "left")
    near = F.coalesce(cosine(F.col("_q"), F.col("_v")), F.lit(0.0))
    x = x.select(query_col, id_col, F.round(share * F.col("score") + (1 - share) * F.round(near, 9), 6).alias("score")).where(F.col("score") >= least)
    x = x.join(contents.select(id_col, _start(prefix).alias("start")), id_col)
    w = Window.partitionBy(query_col, "start").orderBy(F.desc("score"), id_col)
    return best_of(x.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(query_col, id_col, "score"), query_col, id_col, k)


def context(results: DataFrame, query_col: str, id_col: str, most: int = 5, length: int = 2000) -> DataFrame:
    """One text a query for a reader: its ``most`` best ``results`` (``title``, ``source``, ``kind``, ``score``, ``content``) under numbered headings, contents cut at ``length`` characters."""
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    share = F.format_string("Relevance: %.2f%%", F.round(F.col("score") * 100, 2))
    head = F.concat_ws(" | ", F.concat(F.lit("Type: "), F.coalesce("kind", F.lit(""))), part("Title", "title"), part("Source", "source"), share)
    text = F.coalesce("content", F.lit(""))
    body = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("\n... [truncated]"))).otherwise(text)
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), id_col))
    x = results.withColumn("_i", rank).where(F.col("_i") <= most)
    block = F.concat(F.lit("[Document "), F.col("_i").cast("string"), F.lit("] "), head, F.lit("\n"), body)
    blocks = F.array_sort(F.collect_list(F.struct("_i", block.alias("b"))))
    return x.groupBy(query_col).agg(F.array_join(F.transform(blocks, lambda s: s["b"]), "\n\n---\n\n").alias("context"))
