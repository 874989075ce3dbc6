"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, prepare, text_or_empty

#: Document statistics, in the order of :func:`statistics`.
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "letters", "digits", "symbols", "upper", "spaces", "non_ascii", "wordless",
    "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "log_line", "ended_lines", "bars", "marked_words", "upper_words", "log_longest_word", "repeated_marks",
)
_MARKS = str.maketrans("", "", "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))


def statistics(text: str) -> list[float]:
    """Numbers of about one size that describe a text; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    words = text.split()
    m = max(len(words), 1)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(raw, minlength=256) / len(raw)
    lower, upper, digits = kinds[97:123].sum(), kinds[65:91].sum(), kinds[48:58].sum()
    wide, spaces = kinds[128:].sum(), kinds[[9, 10, 11, 12, 13, 32]].sum()
    lengths = np.array([len(w) for w in words] or [0])
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    bare = text.translate(_MARKS).split()
    marked = sum(w[-1] in "!#$%&*@~^|<>=+_" for w in words)
    return [
        np.log1p(n) / 4,
        np.log1p(len(words)) / 4,
        min(lengths.mean(), 30) / 6,
        min(lengths.std(), 30) / 4,
        (lower + upper + wide) * 2,
        digits * 10,
        (1 - lower - upper - digits - wide - spaces) * 5,
        upper * 5,
        spaces * 5,
        wide * 5,
        (m - len(bare)) / m * 2,
        len(seen) / m,
        max(seen.values(), default=0) / m * 3,
        len(set(zip(words, words[1:]))) / max(m - 1, 1),
        (1 - len(set(lines)) / max(len(lines), 1)) * 2,
        np.log1p(n / max(len(lines), 1)) / 3,
        sum(x.rstrip()[-1] in ".!?:;" for x in lines) / max(len(lines), 1),
        kinds[124] * 20,
        marked / m * 2,
        sum(w.isupper() and len(w) > 1 for w in words) / m * 2,
        np.log1p(lengths.max()) / 3,
        (text.count("!!") + text.count("**") + text.count("##") + text.count("$$") + text.count("%%") + text.count("&&")) / m * 2,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def waves_of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves_of(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def rising(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing sequence nearest to ``values``, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v, n in zip(values, counts):
        pools.append([v, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, k2 = pools.pop()
            v1, n1, k1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return np.concatenate([np.full(int(k), v) for v, _, k in pools]) if pools else np.zeros(0)


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out, fold 3 calibrates, the others fit."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def _stats(batch: pa.RecordBatch, column: int) -> np.ndarray:
    rows = [statistics(t.as_py() or "") for t in batch.column(column)]
    return np.array(rows, np.float64).reshape(-1, len(STATISTICS))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", waves: int = 256, width: float = 4.0, ridge: float = 1e-3, bins: int = 2048, seed: int = 3) -> QualityModel | None:
    """Fit on all labelled documents outside fold 2. None if there are none.

    Random Fourier features (``waves`` of them, Gaussian kernel of ``width`` standard
    deviations) of the documents' statistics; each partition sums its part of the normal
    equations, the parts are summed in levels, and the driver solves one system of ``waves`` + 1
    unknowns. Scores of fold 3, counted in ``bins`` bins, are calibrated by isotonic
    regression. A document with several labels has their mean; null labels are left out.
    """
    prepare(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stats(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    stats = docs.where(fold(id_col) != 2).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(describe, f"id {kind}, x array<double>")
    rows = cut(stats.join(known, "id").select(fold("id").cast("int").alias("fold"), "x", "y"))
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not moments:
        return None
    rng = np.random.default_rng(seed)
    spread = np.array([max(r.s, 1e-6) for r in moments])
    start = QualityModel(np.array([r.m for r in moments]), spread, rng.standard_normal((len(moments), waves)) / width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.zeros(1))
    size = waves + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((size, size + 1))
        for batch in batches:
            z = start.waves_of(_matrix(batch.column(0)))
            a += z.T @ np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(size * (size + 1))
        for batch in batches:
            for part in batch.column(0):
                a += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["part"])

    fits, tasks = rows.where("fold != 3").select("x", "y").mapInArrow(equations, "part binary"), rows.rdd.getNumPartitions()
    while tasks > 16:  # sums of at most 16 matrices a task, level by level
        tasks = -(-tasks // 16)
        fits = fits.repartition(tasks).mapInArrow(added, "part binary")
    a = sum(np.frombuffer(r.part).reshape(size, size + 1) for r in fits.collect())  # at most 16 matrices
    n = max(a[-1, size - 1], 1)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(a[:, :size] / n + np.diag(penalty), a[:, size] / n)
    model = QualityModel(start.mean, start.spread, start.waves, start.phases, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.floor((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    counts = rows.where("fold = 3").select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if counts:
        n = np.array([r.n for r in counts], float)
        knots = (np.array([r.bin for r in counts]) + 0.5) / bins * 2 - 0.5
        levels = rising(np.array([r.y for r in counts]) / n, n)
    else:
        knots, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return QualityModel(start.mean, start.spread, start.waves, start.phases, weights, knots, levels)


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.7) -> DataFrame:
    """Quality of every whole text under ``model``.

    Returns ``id_col``, ``held_out`` (fold 2, which no fit has seen), ``score`` (0 to 1,
    higher for label 1) and ``predicted`` (1 from ``cut_at`` on). Scores depend on the
    text alone. Null texts score as empty ones. Without a model (no labels) every score
    is 0.5. Null ids are kept, not held out. Repeated rows are kept. Other columns are
    left out. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stats(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rated = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(rate, f"id {kind}, score double")
    return rated.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text", cut_at: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts reach ``cut_at``; all rows without a model. No row is moved."""
    if model is None:
        return docs
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_stats(batch, at)) >= cut_at))

    return docs.mapInArrow(keep, docs.schema)
