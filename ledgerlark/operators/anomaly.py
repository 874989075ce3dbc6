"""Outliers: z-scores, quartile fences, isolation forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.order import quantiles
from ledgerlark.session import cut as cut_lineage
from ledgerlark.session import with_package


def z_outliers(df: DataFrame, value: str, limit: float = 3.0, key: str = "symbol") -> DataFrame:
    """Rows over ``limit`` population deviations from their key's mean; keys without spread have none."""
    w = Window.partitionBy(key)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    return df.withColumn("z", z).where(F.abs("z") > limit)


def iqr_outliers(df: DataFrame, key: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows beyond ``k`` interquartile ranges of the quartiles (interpolated)."""
    q = quantiles(df, key, value, [0.25, 0.75]).select(key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = k * (F.col("q3") - F.col("q1"))
    return df.join(q, key).where((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach))


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grown(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, float]]:
    """An isolation tree over the rows of ``x``: for each node its column (-1: a leaf), its cut, the place of its lower child (the upper one is next to it) and a leaf's path length."""
    nodes, work = [(-1, 0.0, -1, 0.0)], [(0, np.arange(len(x)), 0)]
    most = int(np.ceil(np.log2(max(len(x), 2))))
    while work:
        at, rows, depth = work.pop()
        usable = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 and depth < most else ()
        if not len(usable):
            nodes[at] = (-1, 0.0, -1, depth + _average_path(len(rows)))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
        low, child = x[rows, f] < cut, len(nodes)
        nodes[at] = (f, cut, child, 0.0)
        nodes += [(-1, 0.0, -1, 0.0)] * 2
        work += [(child, rows[low], depth + 1), (child + 1, rows[~low], depth + 1)]
    return nodes


def isolation_scores(df: DataFrame, columns: list[str], trees: int = 200, sample: int = 256, pool: int = 4096, block: int = 50_000, key: str = "symbol", order: str = "d", seed: int = 42) -> DataFrame:
    """``key``, ``order`` and ``score`` (near 1: easily isolated) of every row, by a forest of each key's own.

    The trees of a key draw their ``sample`` rows from about ``pool`` of its rows, chosen by a hash (all, if it has no more), so that a forest of bounded size is grown from keys of any
    length; then blocks of about ``block`` rows are scored, each with its key's forest. Nulls and non-finite values count as 0. Scaling does not change which cuts are drawn,
    so columns are not scaled. The same rows give the same scores on any cluster.
    """
    with_package(df.sparkSession)
    value = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c).cast("double"))
    x = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.array(*map(value, columns)).alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    counts = x.groupBy("k").agg(F.count("*").alias("n"))
    place = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k", "o"), 11) + F.lit(0.5)) / float(1 << 53)
    pooled = x.join(counts, "k").where(place * F.col("n") < pool)

    def grow(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o", kind="stable")
        rows, rng = np.stack(f["x"].to_numpy()), np.random.default_rng(seed)
        n = min(sample, len(rows))
        forest = [_grown(rows[rng.choice(len(rows), n, replace=False)], rng) for _ in range(trees)]
        first = np.cumsum([0, *map(len, forest)])
        column, cut, child, path = (np.array(v) for v in zip(*(t for tree in forest for t in tree)))
        child = np.where(child >= 0, child + np.repeat(first[:-1], np.diff(first)), -1)
        return pd.DataFrame({"k": f["k"].iloc[:1], "roots": [first[:-1]], "column": [column], "cut": [cut], "child": [child], "path": [path], "per": [n], "blocks": [-(-int(f["n"].iloc[0]) // block)]})

    forests = pooled.groupBy("k").applyInPandas(grow, f"k {kinds['k']}, roots array<long>, column array<long>, cut array<double>, child array<long>, path array<double>, per long, blocks long")
    forests = cut_lineage(forests)
    dealt = x.join(forests.select("k", "blocks"), "k").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "o"), F.col("blocks"))).drop("blocks")
    models = forests.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def score(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if f.empty or m.empty:
            return pd.DataFrame({"k": [], "o": [], "score": []})
        rows, total = np.stack(f["x"].to_numpy()), np.zeros(len(f))
        roots, column, cut, child, path = (np.asarray(m[c].iloc[0]) for c in ("roots", "column", "cut", "child", "path"))
        for root in roots:
            at = np.full(len(rows), root)
            while (inner := np.flatnonzero(child[at] >= 0)).size:
                node = at[inner]
                at[inner] = child[node] + (rows[inner, column[node]] >= cut[node])
            total += path[at]
        return pd.DataFrame({"k": f["k"], "o": f["o"], "score": 2 ** (-(total / len(roots)) / max(_average_path(int(m["per"].iloc[0])), 1e-9))})

    out = dealt.groupBy("k", "block").cogroup(models.groupBy("k", "block")).applyInPandas(score, f"k {kinds['k']}, o {kinds['o']}, score double")
    return out.toDF(key, order, "score")


def threshold(scores: DataFrame, rate: float = 0.02, key: str = "symbol") -> DataFrame:
    """``key`` and ``threshold``: the score over which the share ``rate`` of a key's rows lies, for rows that are known to be ordinary."""
    return quantiles(scores, key, "score", [1 - rate]).select(key, F.col("q")[0].alias("threshold"))


def flagged(scores: DataFrame, limits: DataFrame, key: str = "symbol") -> DataFrame:
    """Scores with ``anomaly``: over their key's threshold."""
    return scores.join(limits, key).withColumn("anomaly", F.col("score") > F.col("threshold")).drop("threshold")


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 200, sample: int = 256, share: float = 0.05, key: str = "symbol", seed: int = 42, **forest) -> DataFrame:
    """Score of each row of a key's history (:func:`isolation_scores`), and whether it is among the top ``share``."""
    scores = cut_lineage(isolation_scores(df, columns, trees, sample, key=key, seed=seed, **forest))
    return flagged(scores, threshold(scores, share, key), key)


def statistical_flags(df: DataFrame, columns: list[str], limit: float = 3.0, k: float = 1.5, key: str = "symbol", order: str = "d") -> DataFrame:
    """``key``, ``order``, ``by_z`` and ``by_iqr`` of every row: whether any of ``columns`` lies over ``limit`` population deviations from its key's mean, or beyond ``k`` interquartile ranges of its quartiles.

    Nulls and non-finite values count as 0, as in the forest. Statistics are of a key and a column and come from sums and one distributed sort.
    """
    value = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c).cast("double"))
    x = df.select(F.col(key).alias("k"), F.col(order).alias("o"), *(value(c).alias(c) for c in columns))
    long = x.select("k", F.inline(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)))))
    of = long.groupBy("k", "c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    q = quantiles(long.select(F.struct("k", "c").alias("kc"), "v"), "kc", "v", [0.25, 0.75]).select("kc.k", "kc.c", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    stats = of.join(q, ["k", "c"]).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("mean", "sd", "q1", "q3")))).alias("s"))
    z, far = F.lit(False), F.lit(False)
    for i, c in enumerate(columns):
        s = F.col("s")[i]
        z = z | F.coalesce(F.abs((F.col(c) - s["mean"]) / F.nullif(s["sd"], F.lit(0.0))) > limit, F.lit(False))
        reach = k * (s["q3"] - s["q1"])
        far = far | (F.col(c) < s["q1"] - reach) | (F.col(c) > s["q3"] + reach)
    return x.join(stats, "k").select(F.col("k").alias(key), F.col("o").alias(order), z.alias("by_z"), far.alias("by_iqr"))


def ensemble(df: DataFrame, columns: list[str], share: float = 0.05, key: str = "symbol", order: str = "d", limit: float = 3.0, k: float = 1.5, **forest) -> DataFrame:
    """The forest's ``score`` and ``anomaly`` of every row, ``by_z``, ``by_iqr`` and ``flagged``, if any of the three holds. Rows are known by key and order."""
    rows = cut_lineage(df.select(key, order, *columns))
    x = isolation_forest(rows, columns, share=share, key=key, order=order, **forest).join(statistical_flags(rows, columns, limit, k, key, order), [key, order])
    return x.withColumn("flagged", F.col("anomaly") | F.col("by_z") | F.col("by_iqr"))
