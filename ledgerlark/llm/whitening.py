"""Whitening of embeddings by the eigenvectors of their exactly centred covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, prepare

_SCALE, _SHIFT, _MOST = 1024.0, 100_000, 2.0**62


def whole_numbers(vectors: pd.Series, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors are whole (not null, no null or non-finite entry, ``d`` entries if given), and these as integers.

    An entry c becomes floor(1024 c) + 100000; floors beyond 2^62 in size are held there.
    """
    ok = np.array([v is not None and len(v) > 0 and (d is None or len(v) == d) and bool(np.isfinite(np.asarray(v, float)).all()) for v in vectors], bool)
    some = [np.asarray(v, float) for v, k in zip(vectors, ok) if k]
    with np.errstate(over="ignore"):
        x = [np.clip(np.floor(v * _SCALE), -_MOST, _MOST).astype(np.int64) + _SHIFT for v in some]
    return ok, x if d is None else np.stack(x) if x else np.zeros((0, d), np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit integers where they fit, else as Python's."""
    most = max([abs(s) for s in sums], default=0) + n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(c: np.ndarray) -> list[int]:
    """The sum of the squares of each row, exactly: the numbers are split in halves whose products fit in 64 bits."""
    if c.dtype == object or (len(c) and np.abs(c).max() >= 2**50):
        return [sum(int(v) ** 2 for v in row) for row in c]
    high, low = c >> 25, c & (2**25 - 1)
    return [(int(a) << 50) + (int(b) << 26) + int(e) for a, b, e in zip((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))]


@dataclass(frozen=True)
class Whitening:
    """n vectors fitted, sums of each dimension, components in rows, their eigenvalues, the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def _gramian(vectors: DataFrame) -> np.ndarray:
    """The Gramian of the column ``v`` of arrays of doubles, by MLlib."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening | None:
    """Components of the whole vectors of ``df``; None if there is none.

    Sums of each dimension are taken exactly, as integers, in tasks and then by Spark.
    Rows are centred exactly: n x - sums is an integer, which is divided by n once. MLlib sums their Gramian over all rows;
    divided by n it is the covariance, and its eigenvectors are computed on the driver: its size is that of the dimensions, not of the rows.
    Vectors of other lengths than the most frequent (ties: the longest) are not fitted.
    Components without variance, as of vectors all equal, are left out.
    """
    prepare(df.sparkSession)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, list[int]]] = {}
        for f in batches:
            _, x = whole_numbers(f["v"])
            for d in {len(v) for v in x}:
                s = np.array([v for v in x if len(v) == d])
                # halves, so that sums of a batch cannot leave 64 bits
                total = [(int(h) << 31) + int(low) for h, low in zip((s >> 31).sum(0), (s & (2**31 - 1)).sum(0))]
                n, old = held.get(d, (0, [0] * d))
                held[d] = n + len(s), [a + b for a, b in zip(old, total)]
        for d, (n, sums) in held.items():
            yield pd.DataFrame({"d": d, "dim": range(d), "n": n, "s": [str(s) for s in sums]})

    parts = df.select(F.col(vector_col).alias("v")).mapInPandas(add, "d int, dim int, n long, s string")
    sums = parts.groupBy("d", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = sums.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    n, d, exact = best.n, best.d, [int(r.s) for r in best.sums]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            _, x = whole_numbers(f["v"], d)
            yield pd.DataFrame({"v": list((centred(x, n, exact) / n).astype(float))})

    covariance = _gramian(df.select(F.col(vector_col).alias("v")).mapInPandas(rows, "v array<double>")) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    order = [k for k in order if values[k] > max(values[-1], 0) * d * 2.0**-52]
    axes = vectors[:, order].T
    if len(axes):  # of either sign, the one whose largest entry is positive
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Whitening(n, exact, axes, values[order], float(np.trace(covariance)))


def apply(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``deviation`` (decimal, exact: the sum of squares of n x - sums) and ``whitened`` (an array, one entry a component) of each whole vector."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # dimensions x components numbers

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in batches:
            ok, x = whole_numbers(f["v"], len(m.sums))
            c = centred(x, m.n, m.sums)
            w = ((c / m.n).astype(float) @ m.components.T) / np.sqrt(m.values)
            exact = squares(c)
            yield pd.DataFrame({"id": f["id"][ok].reset_index(drop=True), "deviation": [str(s) if s < 10**38 else None for s in exact], "whitened": list(w)})

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(project, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest entry, by size, of the covariance of the column ``whitened`` less the identity; rows are centred first."""
    if k == 0:
        return 0.0
    mean = whitened.agg(*(F.avg(F.col("whitened")[j]).alias(f"m{j}") for j in range(k))).first()
    centre = F.array(*(F.col("whitened")[j] - float(mean[j]) for j in range(k)))
    return float(np.abs(_gramian(whitened.select(centre.alias("v"))) / n - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """Vectors whitened by the components of all of them: a row for each whole vector and component.

    Vectors that are null, empty, hold null or non-finite entries, or have another length than most, are dropped. Returns ``id_col``,
    ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation`` (decimal; null from 10^38 on), ``whitened``, ``explained`` (share of
    the trace), ``eigenvalue`` and ``identity_error`` (one value: how far the whitened covariance is from the identity). Ids may be null or repeat.
    Where all vectors are equal, or there is none, there are no components and no rows. Other columns are left out.
    """
    model = fit(df, vector_col, components)
    kind = df.schema[id_col].dataType.simpleString()
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, eigenvalue double, identity_error double")
    rows = cut(apply(df, model, id_col, vector_col))
    error = identity_error(rows, model.n, len(model.values))
    of = lambda x: F.array(*map(F.lit, map(float, x)))[F.col("k")]
    rows = rows.select(id_col, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        id_col, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        of(model.values / model.trace).alias("explained"), of(model.values).alias("eigenvalue"), F.lit(error).alias("identity_error"),
    )
