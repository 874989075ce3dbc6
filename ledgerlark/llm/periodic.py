"""Runs of words that repeat with a period, by a scan of every lag."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, prepare, text_or_empty, utf8_parts

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20
#: Comparisons that are held at a time.
_PROBES = 1 << 20


def word_ids(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """A number for each word of a text; ``known`` numbers the distinct words."""
    out, at = [], 0
    while at < len(raw):
        m = _SPACE.search(raw, at + _PIECE) if len(raw) - at > _PIECE else None
        end = m.start() if m else len(raw)
        words = raw[at:end].split()  # bytes are split at 32 and 9 to 13
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Slices of lags with about ``_PROBES`` comparisons each."""
    total = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _PROBES, "right")))
        yield slice(a, b)
        a = b


def _suspects(w: np.ndarray, base: np.ndarray, n: np.ndarray, q: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, lag, first word) of m words, each a lag after the other, that equal the word a lag after them; one of every long stretch at least.

    ``base``, ``n`` and ``q`` have one entry for each lag of each text: where the text starts in ``w``, its words, the lag.
    A stretch of m * q equal words has a multiple of m * q in it, and m multiples of q around that.
    """
    counts = (n - q - 1) // (m * q) + 1
    for part in _slices(counts):
        c = counts[part]
        lag = np.repeat(np.arange(part.start, part.start + len(c)), c)
        i = (np.arange(len(lag)) - np.repeat(np.cumsum(c) - c, c)) * m * q[lag]
        b = base[lag] + i
        hit = w[b] == w[b + q[lag]]
        lag, i = lag[hit], i[hit]
        step, back, on = q[lag], np.zeros(len(lag), np.int64), np.zeros(len(lag), np.int64)
        for sign, run in ((1, on), (-1, back)):
            going = np.ones(len(lag), bool)
            for k in range(1, m):
                at = i + sign * k * step
                inside = (at >= 0) & (at + step < n[lag])
                a = base[lag] + np.where(inside, at, 0)
                going &= inside & (w[a] == w[a + np.where(inside, step, 0)])
                run += going
        yes = back + on + 1 >= m
        yield lag[yes], (i - back * step)[yes], ((on + back + 1) * step)[yes]


def _stretches(w: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Starts and lengths of the stretches of at least ``least`` words that equal the word q after them."""
    same = np.concatenate([[False], w[:-q] == w[q:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, length = edges[::2], edges[1::2] - edges[::2]
    return [(int(s), int(k)) for s, k in zip(start, length) if k >= least]


def runs_of(texts: list[np.ndarray], min_exp: int = 4, min_length: int = 6, lags: list[tuple[int, int]] | None = None) -> list[dict[tuple[int, int], int]]:
    """For each list of word numbers, its runs: (start, length) and the smallest period.

    Each lag q up to n / ``min_exp`` is compared: first at words so far apart that no stretch long enough
    lies between them, then, where these agree, throughout; stretches of equal words of at least
    ``min_exp * q`` words are runs. A run of a multiple of a period found is the same run.
    ``lags`` has, for each text, (k, m): only lags of remainder k modulo m are scanned, besides those under 64.
    """
    base = np.cumsum([0, *map(len, texts)])
    w = np.concatenate([*texts, np.zeros(1, np.int32)]) if texts else np.zeros(1, np.int32)
    of, qs = [], []
    for t, x in enumerate(texts):
        most = len(x) // min_exp if len(x) >= min_length else 0
        q = np.arange(1, most + 1)
        if lags and lags[t][1] > 1:
            k, m = lags[t]
            q = q[(q < 64) | (q % m == k)]
        of.append(np.full(len(q), t))
        qs.append(q)
    of, q = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (of, qs))
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    if not len(q):
        return found
    size = np.diff(base)
    done = set()
    for lag, first, span in _suspects(w, base[of], size[of], q, min_exp - 1):
        for k, s, e in zip(lag.tolist(), first.tolist(), (first + span).tolist()):
            if k in done:
                continue
            t, period = int(of[k]), int(q[k])
            # what lies in a run of a divisor of the lag is that run
            if any(period % p == 0 and a <= s and e < a + n for (a, n), p in found[t].items()):
                continue
            done.add(k)
            for start, n in _stretches(texts[t], period, max(min_length, min_exp * period) - period):
                key = (start, n + period)
                found[t][key] = min(found[t].get(key, period), period)
    return found


def _collapsed(raw: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, but for those of a run after its first period."""
    words = raw.split()
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _ordered(runs: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return sorted(((s, n, p) for (s, n), p in runs.items()), key=lambda r: (r[0], r[2]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def _rows(texts: Iterator[tuple[int, bytes]], most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of texts of about ``most`` bytes."""
    held, n = [], 0
    for i, raw in texts:
        held.append((i, raw))
        n += len(raw)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", min_exp: int = 4, min_length: int = 6, split_bytes: int = 1 << 16) -> DataFrame:
    """Runs of words with a period: maximal stretches of ``min_exp`` periods and ``min_length`` words or more, each with its smallest period.

    Words are runs of anything but space and the characters 9 to 13, numbered from 0. A text of up
    to ``split_bytes`` bytes is scanned at all lags by the task that reads it; a longer one is written, and each of
    its ranges of lags, one for every ``split_bytes``, goes to a task of its own, so that a very long text does not hold up one
    task; its runs then meet by the text's row number.

    Returns for each row: ``id_col``, ``n_words``, ``runs`` (array of start, length, period, by start, then
    period), ``collapsed`` (binary: words joined by a space, without those of a run after its first period).
    Null and empty texts have no words and no runs; ids may be null or repeat. Other columns
    are left out. An empty table gives no rows.
    """
    prepare(df.sparkSession)
    text = text_or_empty(text_col) if isinstance(text_col, str) else F.coalesce(text_col, F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    is_long = F.octet_length("text") > split_bytes

    def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
        data, offsets = utf8_parts(batch.column(column))
        raw = data.tobytes()
        for i in range(len(batch)):
            yield i, raw[offsets[i] : offsets[i + 1]]

    def out(batch: pa.RecordBatch, sizes: list, runs: list, kept: list, at: list[int]) -> pa.RecordBatch:
        arrays = [pa.array(sizes, pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(_RUN)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *arrays], ["id", "n_words", "runs", "collapsed"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _rows(texts_of(batch, 1), _PIECE):
                known: dict[bytes, int] = {}
                ids = [word_ids(raw, known) for _, raw in group]
                runs = [_ordered(r) for r in runs_of(ids, min_exp, min_length)]
                yield out(batch, [len(x) for x in ids], runs, [_collapsed(raw, r) for (_, raw), r in zip(group, runs)], [i for i, _ in group])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, k, m = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for i, raw in texts_of(batch, 1):
                found = runs_of([word_ids(raw, {})], min_exp, min_length, [(k[i], m[i])])[0]
                r = np.array([(s, n, p) for (s, n), p in found.items()], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), row[i])), *(pa.array(r[:, c]) for c in range(3))], ["row", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for i, raw in texts_of(batch, 1):
                runs = sorted(((r["start"], r["length"], r["period"]) for r in lists[i] or []), key=lambda r: (r[0], r[2]))
                yield out(batch, [len(raw.split())], [runs], [_collapsed(raw, runs)], [i])

    short = rows.where(~is_long).mapInArrow(whole, f"id {kind}, {_OUT}")
    written = cut(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    parts = F.ceil(F.octet_length("text") / split_bytes).cast("int")
    dealt = written.select("row", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("k"), parts.alias("m")).repartition("row", "k")
    found = dealt.mapInArrow(ranged, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    found = cut(found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")))
    long = written.join(found, "row", "left").select("id", "text", "runs").mapInArrow(joined, f"id {kind}, {_OUT}")
    return short.unionAll(long).select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")
