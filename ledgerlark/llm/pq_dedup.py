"""Embedding near-dedup: inverted lists, product-quantised residuals, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, connected_components, cut, prepare

#: Names of entries that have no id start here, above any real id.
_NAMELESS = 1 << 62


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of ``k`` clusters, or of as many as there are points."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (c * c).sum(1) / 2, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass(frozen=True)
class PqIndex:
    """Coarse centres (lists), and codebooks of the residuals' subspaces: books[m] is (codes, width)."""

    centres: np.ndarray
    books: np.ndarray
    margin: float

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, 1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Which lists each query probes: those whose centre is nearly as near as its own list's."""
        s = x @ self.centres.T
        return s >= s.max(1, keepdims=True) - self.margin

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each subspace, and the length of what they leave out."""
        m, _, w = self.books.shape
        parts = residuals.reshape(len(residuals), m, w)
        codes = np.empty((len(parts), m), np.uint8)
        rest = np.zeros(len(parts))
        for j in range(m):
            b = self.books[j]
            codes[:, j] = np.argmax(parts[:, j] @ b.T - (b * b).sum(1) / 2, 1)
            rest += ((parts[:, j] - b[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(rest)

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries (as residuals to the list's centre) to coded vectors, by table look-up."""
        m, _, w = self.books.shape
        total = np.zeros((len(residuals), len(codes)), np.float32)
        for j in range(m):
            q, b = residuals[:, j * w : (j + 1) * w], self.books[j]
            table = (q * q).sum(1)[:, None] - 2 * q @ b.T + (b * b).sum(1)
            total += table.astype(np.float32)[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def _unit(vectors, dims: int) -> np.ndarray:
    """Rows of length 1 in double precision; shorter vectors are filled with zeros."""
    x = np.zeros((len(vectors), dims))
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    if len(vectors):
        x[np.arange(dims) < size[:, None]] = np.concatenate(list(vectors))
    x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), np.finfo(float).tiny)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def split_kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Many centres in two levels: cells, each cut into a share of the centres by its points."""
    if k <= 512:
        return kmeans(x, k, rng)
    cells = kmeans(x, round(k**0.5), rng)
    near = np.argmax(x @ cells.T - (cells * cells).sum(1) / 2, 1)
    return np.concatenate([kmeans(own, max(1, round(k * len(own) / len(x))), rng) for c in range(len(cells)) if len(own := x[near == c])])


def fit_index(sample: np.ndarray, lists: int, threshold: float, subspaces: int, z: float = 2.0, seed: int = 9) -> PqIndex:
    """Train ``lists`` centres and the codebooks on unit vectors.

    A vector at the threshold's angle from a query, in a random direction, sees the gap
    between two centres shift by about tan(angle) * |difference of the centres| / sqrt(dims);
    the query probes every list within ``z`` such shifts of its best. A link is found if
    either of its ends probes the other's list.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    centres = split_kmeans(sample, lists, rng)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    residuals = sample - centres[np.argmax(sample @ centres.T, 1)]
    width = dims // subspaces
    books = np.stack([_filled(kmeans(residuals[:, j * width : (j + 1) * width], 256, rng, 5)) for j in range(subspaces)])
    gap = np.sqrt(2 - 2 * np.clip(centres @ centres.T, -1, 1)).mean()
    tangent = np.sqrt(1 - threshold**2) / threshold
    return PqIndex(centres, books, float(z * tangent * gap / np.sqrt(dims)))


def _filled(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], 256 - len(book), 0)]) if len(book) < 256 else book


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, per_list: int = 256, block: int = 2000, sample_rows: int = 20_000, subspaces: int = 16, most_lists: int = 65_536) -> DataFrame:
    """Links between vectors of cosine ``threshold`` or more, and their connected components.

    Equal vectors are one entry with a count. Entries go into inverted lists by their
    nearest coarse centre, with product-quantised residual codes; every entry is also a
    query of all lists whose centres are nearly as near as its own (see ``fit_index``).
    In a list, a candidate is any entry whose table-look-up distance less its own
    quantisation error is within the threshold's distance, which by the triangle
    inequality misses none; candidates are reranked by exact cosines in double precision.
    Lists and their queries are cut into blocks of about ``block``, one pair of blocks a
    task group, and each group returns counts and a spanning forest of its links rather
    than the links, so a dense group of n vectors gives on the order of n rows. A link that only one
    end's probes find counts for both. Centres
    and codebooks are trained on at most ``sample_rows`` entries, or four for each list if that is
    more (262,144 at ``most_lists``, which are reached at 16.8 million vectors; beyond, lists grow), taken by a hash; all
    entries are indexed.

    Returns ``id_col``, ``n_links`` (other rows linked directly, equal vectors included),
    ``component_id`` (smallest id reachable, itself included), ``kept``. Vectors that are
    null, empty or zero, or hold nulls or non-finite numbers, have no links; so do those of
    different lengths with each other. Rows that repeat an id count as rows of their own,
    and share a component. Null ids count in others' links, and have component null and
    kept null. Other columns are left out. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    scratch = Scratch(spark)
    v = F.col("v")
    valid = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    number = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v")).withColumn("ok", valid)
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0).cast(number))))
    # an entry's number, fixed as it is written, names it in this call
    entries = rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("entry", F.monotonically_increasing_id())
    entries = cut(entries.withColumn("rep", F.coalesce(F.col("rep").cast("bigint"), F.col("entry") + _NAMELESS)))
    n, dims = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    lone = rows.where("not ok").select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").cast("bigint").alias("component_id"))
    if not n:
        return lone.withColumn("kept", F.col(id_col) == F.col("component_id"))
    dims = -(-dims // subspaces) * subspaces
    lists = int(np.clip(n // per_list, 1, most_lists))
    sample_rows = max(sample_rows, 4 * lists)
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= F.lit(int(min(1.0, 1.05 * sample_rows / n) * (1 << 20)))
    sample = entries.where(part).orderBy(F.xxhash64("v", F.lit(1))).limit(sample_rows).select("v").toPandas()
    index = spark.sparkContext.broadcast(fit_index(_unit(sample["v"], dims), lists, threshold, subspaces))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for f in frames:
            x = _unit(f["v"], dims)
            own, probes = ix.assign(x), ix.probes(x)
            row, cell = np.nonzero(probes)
            yield pd.DataFrame({"cell": cell, "entry": f["entry"].to_numpy()[row], "own": own[row] == cell})

    dealt = cut(entries.select("entry", "v").mapInPandas(deal, "cell long, entry long, own boolean"))
    sizes = dealt.groupBy("cell").agg(F.count_if("own").alias("m"), F.count("*").alias("q"))
    sizes = {r.cell: (-(-r.m // block), -(-r.q // block)) for r in sizes.collect()}  # one row a list
    n_lists = len(index.value.centres)
    wide = lambda k: F.from_json(F.lit(str([max(1, sizes.get(c, (0, 0))[k]) for c in range(n_lists)])), "array<bigint>")[F.col("cell").cast("int")]
    dealt = dealt.withColumn("ms", wide(0)).withColumn("qs", wide(1)).withColumn("h", F.xxhash64("entry"))
    members = dealt.where("own").select("cell", "entry", F.pmod("h", "ms").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), F.lit(True).alias("own"))
    queries = dealt.select("cell", "entry", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"), F.pmod("h", "qs").alias("qb"), F.lit(False).alias("own"))
    work = members.unionByName(queries).join(entries.select("entry", "v", "copies"), "entry")

    def compare(key, f: pd.DataFrame) -> pd.DataFrame:
        ix = index.value
        own = f["own"].to_numpy()
        x, ids, copies = _unit(f["v"], dims), f["entry"].to_numpy(), f["copies"].to_numpy()
        size = f["v"].map(len).to_numpy()
        a, b = np.flatnonzero(~own), np.flatnonzero(own)  # queries, members
        if not len(a) or not len(b):
            return pd.DataFrame({"entry": [], "links": [], "to": []})
        centre = ix.centres[int(key[0])]
        codes, rest = ix.encode(x[b] - centre)
        links = np.zeros(len(x), np.int64)
        root = {int(i): int(i) for i in ids}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for s in range(0, len(a), 256):
            q = a[s : s + 256]
            near = ix.distances(x[q] - centre, codes) - rest[None, :].astype(np.float32) <= reach + 1e-3
            i, j = np.nonzero(near)
            qi, mj = q[i], b[j]
            good = (ids[qi] != ids[mj]) & (size[qi] == size[mj])
            qi, mj = qi[good], mj[good]
            cos = np.concatenate([np.einsum("ij,ij->i", x[qi[k : k + 65536]], x[mj[k : k + 65536]]) for k in range(0, len(qi), 65536)]) if len(qi) else np.zeros(0)
            qi, mj = qi[cos >= threshold], mj[cos >= threshold]
            np.add.at(links, qi, copies[mj])
            if len(qi):  # the other end counts the link too, unless it finds it by its own probes
                s, home = x[mj] @ ix.centres.T, ix.assign(x[qi])
                unseen = s[np.arange(len(s)), home] < s.max(1) - ix.margin
                np.add.at(links, mj[unseen], copies[qi[unseen]])
            for p, r in zip(ids[qi].tolist(), ids[mj].tolist()):
                p, r = find(p), find(r)
                if p != r:
                    root[max(p, r)] = min(p, r)
        count = pd.Series(links, ids).groupby(level=0).sum()
        to = np.array([find(int(k)) for k in count.index], np.int64)
        told = (count.to_numpy() > 0) | (to != count.index.to_numpy())
        return pd.DataFrame({"entry": count.index[told], "links": count.to_numpy()[told], "to": to[told]})

    found = cut(work.groupBy("cell", "mb", "qb").applyInPandas(compare, "entry long, links long, to long"))
    names = entries.select("entry", "rep")
    edges = found.where("entry != to").join(names.withColumnRenamed("rep", "a"), "entry").join(names.select(F.col("entry").alias("to"), F.col("rep").alias("b")), "to")
    parts = connected_components(edges.select("a", "b"), scratch)
    per = entries.join(found.groupBy("entry").agg(F.sum("links").alias("links")), "entry", "left").join(parts, F.col("rep") == F.col("node"), "left")
    per = cut(per.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    named = F.when(F.col("component_id") < _NAMELESS, F.col("component_id"))
    out = rows.where("ok").join(per, "v").select(F.col("id").alias(id_col), "n_links", named.alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col(id_col) == F.col("component_id"))
