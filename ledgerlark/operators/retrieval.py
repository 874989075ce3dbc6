"""Top-k, latest-n and best-of-group selections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlark.functions.text import words_of
from ledgerlark.functions.words import word_spans
from ledgerlark.session import cut, with_package


def last_of_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group. Spark limits each task's rows of a group before the shuffle."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return df.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def best_by_prefix(df: DataFrame, text: str, order: Sequence[Column], length: int) -> DataFrame:
    """Of rows whose texts begin alike (trimmed, ``length`` characters), the first in ``order``; null texts are left out."""
    w = Window.partitionBy(F.substring(F.trim(text), 1, length)).orderBy(*order)
    return df.where(F.col(text).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cosine_top_k(df: DataFrame, id_col: str, vector_col: str, asked: Sequence[float], k: int) -> DataFrame:
    """The ``k`` rows of greatest cosine similarity to one vector, ties by id; each task keeps its own best k."""
    v, q = F.col(vector_col).cast("array<double>"), F.array(*(F.lit(float(x)) for x in asked))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda a: a * a))) * F.lit(sum(float(x) ** 2 for x in asked) ** 0.5)
    return df.select(id_col, (dot / norm).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def cosine_search(asked: DataFrame, df: DataFrame, id_col: str, vector_col: str, k: int, block: int = 1000) -> DataFrame:
    """For each row of ``asked`` the ``k`` other rows of ``df`` of greatest cosine similarity (to 9 digits), ties by id.

    Both sides are dealt into blocks of about ``block`` vectors; each pair of blocks gives
    its own best k a query, and these are ranked once more. Vectors that are null or of
    length zero have no similarity and are left out. Returns ``query_id``, ``id_col``, ``similarity``.
    """
    with_package(df.sparkSession)

    def blocks(x: DataFrame, ids: str, vectors: str) -> DataFrame:
        x = x.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        n = max(1, -(-x.count() // block))
        return x.groupBy(F.pmod(F.xxhash64("id"), F.lit(n))).agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(F.col("rows.id").alias(ids), F.col("rows.v").alias(vectors))

    def unit(vectors) -> np.ndarray:
        x = np.array(vectors, float)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, ids = np.array(row["query_ids"]), np.array(row["ids"])
                sims = np.round(unit(row["query_vectors"]) @ unit(row["vectors"]).T, 9)
                for i, s in zip(q, sims):
                    at = np.flatnonzero(~np.isnan(s) & (ids != i))
                    at = at[np.lexsort((ids[at], -s[at]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(ids[at]), pa.array(s[at])], ["query_id", "id", "similarity"])

    pairs = blocks(asked, "query_ids", "query_vectors").crossJoin(blocks(df, "ids", "vectors"))
    found = pairs.mapInArrow(best, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("_k", rank).where(F.col("_k") <= k).select("query_id", F.col("id").alias(id_col), "similarity")


def best_of(df: DataFrame, query_col: str, id_col: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest ``score`` a query, ties by id."""
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), id_col))
    return df.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def _postings(asked: DataFrame, query_col: str, text_col: str, most: int) -> list | None:
    """The distinct (query, term) pairs of ``asked``; None if there are more than ``most``."""
    q = asked.select(query_col, F.explode(words_of(F.coalesce(F.col(text_col), F.lit(""))))).distinct()
    rows = q.limit(most + 1).collect()
    return None if len(rows) > most else [tuple(r) for r in rows]


def _term_counts(df: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """For each id ``n`` (its words) and the wanted ``terms`` that it has: their places in the list, and how often (``tfs``). Texts of one id are counted together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array([t.encode() for t in terms], pa.large_binary())
        for batch in batches:
            for part, spans, n in word_spans(batch, 1):
                at = pc.index_in(spans, wanted).fill_null(-1).to_numpy()[::2]
                rows = np.repeat(np.arange(len(part)), n)
                keys, tfs = np.unique((rows * len(terms) + at)[at >= 0], return_counts=True)
                bounds = pa.array(np.searchsorted(keys, np.arange(len(part) + 1) * len(terms)), pa.int32())
                lists = (pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (keys % max(len(terms), 1), tfs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    x = df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    out = x.mapInArrow(count, "id long, n long, terms array<long>, tfs array<long>")
    if not df.groupBy(id_col).count().where("count > 1").isEmpty():  # ids that repeat
        each = out.select("id", F.explode(F.arrays_zip(F.concat(F.array(F.lit(-1)), "terms").alias("term"), F.concat(F.array("n"), "tfs").alias("tf"))).alias("e"))
        each = each.groupBy("id", F.col("e.term").alias("term")).agg(F.sum("e.tf").alias("tf"))
        lists = each.groupBy("id").agg(F.max(F.when(F.col("term") < 0, F.col("tf"))).alias("n"), F.array_sort(F.collect_list(F.when(F.col("term") >= 0, F.struct("term", "tf")))).alias("e"))
        out = lists.select("id", "n", F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs"))
    return cut(out)  # read for the frequencies and for the scores


class _Best:
    """The ``k`` greatest scores of each of ``n`` queries, ties by id, of all that was added."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.rows, self.size, self.most = k, np.full(n, -np.inf), [], 0, 50_000 + 4 * n * k

    def add(self, ids: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """``scores`` and whether they count: a row for each id, a column for each query."""
        i, q = np.nonzero(found & (scores >= self.least))
        self.rows.append((q, ids[i], scores[i, q]))
        self.size += len(i)
        if self.size > self.most:
            self.kept()

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, s = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        stay = place < self.k
        self.rows = [(q[stay], ids[stay], s[stay])]
        self.size = int(stay.sum())
        return self.rows[0]


def _bm25_of_few(postings: list, df: DataFrame, asked: DataFrame, query_col: str, id_col: str, text_col: str, k: int, k1: float, b: float) -> DataFrame:
    """BM25 for counted queries: each task scores its texts for all of them and keeps its best ``k``, so neither terms nor scores are shuffled."""
    spark = with_package(df.sparkSession)
    terms, queries = sorted({t for _, t in postings}), list(dict.fromkeys(q for q, _ in postings))
    place, at = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(queries)}
    pairs = np.array(sorted((place[t], at[q]) for q, t in postings), np.int64).reshape(-1, 2)
    first, of = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]
    counted = _term_counts(df, id_col, text_col, terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            seen += np.bincount(batch.column(1).flatten().to_numpy(), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(terms))), pa.array(np.concatenate([[docs, total], seen]))], ["term", "n"])

    sums = dict(tuple(r) for r in counted.select("n", "terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row a term
    docs, total, df_of = sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(len(terms))], float)
    idf, mean = np.log(1 + (docs - df_of + 0.5) / (df_of + 0.5)), total / max(docs, 1)
    block = max(1, min((1 << 17) // max(len(queries), 1), (1 << 22) // max(len(of), 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, many = _Best(len(queries), k), np.diff(first)
        for batch in batches:
            for start in range(0, len(batch), block):
                part = batch.slice(start, block)
                t, tf = (part.column(c).flatten().to_numpy() for c in (2, 3))
                rows = np.repeat(np.arange(len(part)), pc.list_value_length(part.column(2)).to_numpy())
                weights = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * part.column(1).to_numpy()[rows] / mean))
                each = np.repeat(np.arange(len(t)), many[t])  # an entry for each query that has the term
                q = of[first[t][each] + np.arange(len(each)) - np.repeat(np.cumsum(many[t]) - many[t], many[t])]
                s = np.bincount(rows[each] * len(queries) + q, weights[each], len(part) * len(queries)).reshape(len(part), -1)
                best.add(part.column(0).to_numpy(), np.floor(s * 1e6 + 0.5) / 1e6, s > 0)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.kept()], ["_q", "id", "score"])

    names = spark.createDataFrame(list(enumerate(queries)), StructType([StructField("_q", LongType()), StructField(query_col, asked.schema[query_col].dataType)]))
    found = counted.where("id is not null and size(terms) > 0").mapInArrow(score, "_q long, id long, score double")
    found = found.join(F.broadcast(names), "_q").select(query_col, F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "score")
    return best_of(found, query_col, id_col, k)


def bm25(asked: DataFrame, df: DataFrame, query_col: str, id_col: str, text_col: str, k: int, k1: float = 1.2, b: float = 0.75, most_terms: int = 100_000) -> DataFrame:
    """The ``k`` best texts for each query by BM25 over runs of ASCII letters, digits and _; ids are whole numbers, those of one id are one text, null ids are never found.

    Lengths and document frequencies are counted over all texts. Where the queries have up to ``most_terms`` terms in all, which is counted, each task
    scores its texts for all queries; else terms and scores are joined as tables.
    """
    postings = _postings(asked, query_col, text_col, most_terms)
    if postings is not None:
        return _bm25_of_few(postings, df, asked, query_col, id_col, text_col, k, k1, b)
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_]+"), lambda w: w != "")
    q = asked.select(query_col, F.explode(words(F.col(text_col))).alias("term")).distinct()
    d = df.select(id_col, words(F.col(text_col)).alias("w"))
    tf = d.select(id_col, F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    tf = cut(tf)  # read for the frequencies and for the scores
    lengths = d.groupBy(id_col).agg(F.sum(F.size("w")).alias("n")).where("n > 0")
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    found = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").join(lengths, id_col).join(q, "term").join(F.broadcast(stats))  # one row
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return best_of(found.groupBy(query_col, id_col).agg(F.round(F.sum(part), 6).alias("score")), query_col, id_col, k)


def relative(df: DataFrame, query_col: str) -> DataFrame:
    """Scores of each query's list brought to 0 .. 1; a list of one score has 1."""
    w = Window.partitionBy(query_col)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("score", F.coalesce((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(1.0)))


def fused(a: DataFrame, b: DataFrame, query_col: str, id_col: str, alpha: float, k: int) -> DataFrame:
    """The ``k`` best of two scored lists a query: ``alpha`` (held within 0 .. 1) of the first's score and the rest of the second's, absent scores 0."""
    alpha = min(1.0, max(0.0, alpha))
    x = a.select(query_col, id_col, F.col("score").alias("_a")).join(b.select(query_col, id_col, F.col("score").alias("_b")), [query_col, id_col], "full_outer")
    zero = F.lit(0.0)
    score = alpha * F.coalesce("_a", zero) + round(1 - alpha, 10) * F.coalesce("_b", zero)
    return best_of(x.select(query_col, id_col, (F.round(score * 1e6) / 1e6).alias("score")), query_col, id_col, k)  # halves of the sixth digit fall as in SQL
