"""Full-text search by positions: an inverted index and the density of covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.retrieval import best_of


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and _, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda w: w != "")


def positions(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """The inverted index: ``term``, ``id_col``, ``positions`` (rising, from 1). Stop words have no entry, but they count as positions.

    With ``only`` (``term``), other terms have no entry either: an index for one set of queries, which no other words are shuffled for. Every position of a whole text is held. An index that is written, partitioned or bucketed by term, serves any number of searches.
    """
    x = df.select(id_col, F.posexplode(words(F.col(text_col))).alias("p", "term"))
    if stop_words:
        x = x.where(~F.col("term").isin(list(stop_words)))
    if only is not None:
        x = x.join(only.select("term").distinct(), "term", "left_semi")
    return x.groupBy("term", id_col).agg(F.sort_array(F.collect_list(F.col("p") + 1)).alias("positions"))


def cover_density(asked: DataFrame, index: DataFrame, query_col: str, text_col: str, id_col: str, k: int, stop_words: Sequence[str] = (), weight: float = 0.1) -> DataFrame:
    """The ``k`` best texts a query, of those that hold all of its terms, by the density of their covers.

    A cover is a stretch from one position to another that holds every term of the query, and no shorter one inside. With m positions
    of the query's terms in it and j of other words, it adds ``weight`` / (1 + j). The covers of a text are found in one pass over
    its sorted positions: at each, the least of the terms' last positions is where a cover begins, if it has moved on. Words are not stemmed.
    Queries without terms find nothing. Returns ``query_col``, ``id_col``, ``score``, ``covers``; ties by id.
    """
    terms = F.array_distinct(words(F.col(text_col)))
    if stop_words:
        terms = F.array_except(terms, F.array(*map(F.lit, stop_words)))
    q = asked.select(F.col(query_col), terms.alias("t")).select(query_col, F.size("t").alias("n"), F.posexplode("t").alias("j", "term"))
    hits = index.join(q, "term").groupBy(query_col, id_col, "n").agg(F.collect_list(F.struct("j", "positions")).alias("lists")).where(F.size("lists") == F.col("n"))
    places = F.array_sort(F.flatten(F.transform("lists", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("p"), x["j"].alias("j"))))))
    none = F.array_repeat(F.lit(0), F.col("n"))
    start = F.struct(none.alias("last"), none.alias("at"), F.lit(0).alias("i"), F.lit(0).alias("begin"), F.lit(0.0).alias("score"), F.lit(0).alias("covers"))

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        put = lambda array, value: F.transform(array, lambda old, j: F.when(j == x["j"], value).otherwise(old))
        last, at = put(s["last"], x["p"]), put(s["at"], i)
        begin = F.array_min(last)
        moved = begin > s["begin"]
        noise = (x["p"] - begin) - (i - F.array_min(at))
        gain = F.when(moved, F.lit(weight) / (F.lit(1) + noise)).otherwise(F.lit(0.0))
        return F.struct(last.alias("last"), at.alias("at"), i.alias("i"), F.greatest(s["begin"], begin).alias("begin"), (s["score"] + gain).alias("score"), (s["covers"] + moved.cast("int")).alias("covers"))

    found = hits.select(query_col, id_col, F.aggregate(places, start, step).alias("s"))
    return best_of(found.select(query_col, id_col, F.round("s.score", 6).alias("score"), F.col("s.covers").alias("covers")), query_col, id_col, k)
