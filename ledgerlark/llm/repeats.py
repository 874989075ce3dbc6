"""Passages that repeat anywhere in a corpus, found by prefix doubling over content-defined positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, cut, text_or_empty, utf8_parts

#: Bytes of the strings whose hashes choose positions.
_GRAM = 16
#: Offsets of an anchor that are tested together before they are tested one by one.
_BLOCK = 32
#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 18
_BASES = (0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA85)
_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def _mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    v = v * _U(0x9E3779B97F4A7C15)
    v ^= v >> _U(32)
    v *= _U(0xD6E8FEB86659FD93)
    v ^= v >> _U(29)
    return v


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, _CHUNK + 8192), base, _U)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


class Names:
    """64-bit names of the substrings of a byte array: equal strings of 8 bytes or more have equal names, in any array.

    A name is a polynomial, modulo 2^64, of the mixed 8-byte strings at each position.
    """

    def __init__(self, data: np.ndarray):
        v = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
        for s in (1, 2, 4):
            v[:-s] |= v[s:] << _U(8 * s)
        self.grams = _mix(v[: len(data)])
        self._lanes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _lane(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        if lane not in self._lanes:
            g, n = self.grams if lane == 0 else (self.grams >> _U(32)) | (self.grams << _U(32)), len(self.grams)
            sums = np.zeros(n + 1, _U)
            np.cumsum(g * _power(_BASES[lane], n), out=sums[1:])
            self._lanes[lane] = sums, _power(pow(_BASES[lane], -1, 2**64), n + 1)
        return self._lanes[lane]

    def of(self, start: np.ndarray, stop: np.ndarray, lane: int = 0) -> np.ndarray:
        sums, inverse = self._lane(lane)
        return _mix((sums[stop - 7] - sums[start]) * inverse[start] + (stop - start).astype(_U))

    def least(self, width: int) -> np.ndarray:
        """For each position, the leftmost of the next ``width`` (a power of two) positions whose 16-byte string has the least hash."""
        m = self.grams.copy()
        m[:-8] += (self.grams[8:] << _U(7)) | (self.grams[8:] >> _U(57))
        bits = _U(23)  # positions of a chunk
        m = (_mix(m) >> bits << bits) | np.arange(len(m), dtype=_U)
        s = 1
        while s < width:
            m[:-s] = np.minimum(m[:-s], m[s:])
            s *= 2
        return (m & ((_U(1) << bits) - _U(1))).astype(np.int64)


def _chunks(offsets: np.ndarray, margin: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, row after the last, bytes from, bytes to, offset in the row): whole rows together, or parts of a long one with ``margin`` bytes after them."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if (size := int(offsets[i + 1] - offsets[i])) > _CHUNK:
            for q in range(0, size, _CHUNK):
                yield i, i + 1, int(offsets[i]) + q, min(int(offsets[i + 1]), int(offsets[i]) + q + _CHUNK + margin), q
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
            yield i, j, int(offsets[i]), int(offsets[j]), 0
            i = j


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, width: int) -> list[np.ndarray]:
    """The anchors of each row: row number, name, position and its windows in one number, name of the rest, name of the whole.

    Every window of ``width`` positions has one anchor, the position of the least hash, so each
    string of ``length`` bytes that starts at p belongs to the anchor i of the window at p, at the
    offset i - p; the strings of an anchor are those of a range of offsets. Which anchor follows
    i, the least of the next window, hangs on the bytes right of i alone. The anchor's name is that of its phrase: the
    bytes to the next anchor's 16. The rest ends where the bytes end that all of its strings have in common;
    the whole is what its strings span together. An anchor without such strings only serves as the next one of others.
    """
    core, out = length - width + 1, []
    for i0, i1, a, b, base in _chunks(offsets, 4 * length + 4 * width):
        x = np.concatenate([data[a:b], np.zeros(2 * length, np.uint8)])
        st, en = (offsets[i0:i1] - a, offsets[i0 + 1 : i1 + 1] - a) if base == 0 else (np.array([0]), np.array([b - a]))
        en = np.minimum(en, b - a)
        reach = width + _GRAM - 1
        n = np.clip(np.minimum(en - st - reach + 1, _CHUNK), 0, None)
        n[en - st < min(length, b - a)] = 0
        if not (total := int(n.sum())):
            continue
        name = Names(x)
        arg = name.least(width)
        row = np.repeat(np.arange(len(n)), n)
        p = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + st[row]
        at = arg[p]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        last = np.concatenate([first[1:], [total]]) - 1
        i, row, start, stop = at[first], row[first], p[first], p[last]
        keep = i + 1 + reach <= en[row]  # the next anchor is known
        i, row, start, stop = i[keep], row[keep], start[keep], stop[keep]
        stop = np.minimum(stop, offsets[i0 + 1 : i1 + 1][row] - a - length)
        has = stop >= start
        nxt = arg[i + 1]
        rest, whole = np.zeros(len(i), _U), np.zeros(len(i), _U)
        j, s, e = i[has], start[has], stop[has]
        rest[has] = name.of(np.minimum(arg[nxt[has] + 1] + _GRAM, j + core - 8), j + core)
        whole[has] = name.of(s, e + length)
        lo, hi = np.where(has, i - stop, 1), np.where(has, i - start, 0)
        packed = ((i - st[row] + base) << 24) | ((nxt - i) << 16) | (lo << 8) | hi
        out.append((row + i0, name.of(i, nxt + _GRAM), packed, rest, whole))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 8) & 255, at & 255


def _longs(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])


def _numbers(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of numbers in their order, as arrays: rows, the rows before and after them, and whether there are such rows in this partition."""
    tail = None
    for batch in batches:
        if not len(batch):
            continue
        x = _longs(batch)
        if tail is not None:
            x = np.concatenate([tail, x], axis=1)
        lo, hi = (0 if tail is None else tail.shape[1] - 1), x.shape[1] - 1
        if hi > lo:
            cur = np.arange(lo, hi)
            yield x[:, cur], x[:, np.maximum(cur - 1, 0)], x[:, cur + 1], cur > 0, np.ones(len(cur), bool)
        tail = x[:, max(0, hi - 1) :]
    if tail is not None:
        before = tail.shape[1] > 1
        yield tail[:, -1:], tail[:, :1], tail[:, -1:], np.array([before]), np.array([False])


def _same(a: np.ndarray, b: np.ndarray, rows: range) -> np.ndarray:
    return np.logical_and.reduce([a[k] == b[k] for k in rows])


def _repeated(names: int, item: int):
    """Of sorted rows of ``names`` numbers that name a string and ``item`` that name its place: those beside another place of the string, and a partition's first and last, which may be."""

    def found(batches: Iterator[pa.RecordBatch]):
        for x, before, after, has_before, has_after in neighbours(batches):
            of, at = range(names), range(names, names + item)
            twice = (has_before & _same(x, before, of) & ~_same(x, before, at)) | (has_after & _same(x, after, of) & ~_same(x, after, at))
            yield x, before, after, twice, ~(has_before & has_after)

    return found


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    """Sorted throughout; the rows of a name that is frequent are spread over partitions, as its places differ."""
    return df.orderBy(*by)


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once in a task, so that many copies of one text do not go on."""
    met: set[int] = set()
    for batch in batches:
        keys = batch.column(0).to_pylist()
        fresh = []
        for k in keys:
            fresh.append(k not in met)
            met.add(k)
        yield batch.filter(pa.array(fresh))


def _checked_texts(df: DataFrame, text_col: str, length: int, keep) -> tuple[Column, DataFrame]:
    """A 64-bit key of texts that no two texts share, and for the texts of ``length`` bytes or more: key, number of rows, bytes."""
    text = text_or_empty(text_col)
    for seed in range(16):
        key = F.xxhash64(text, F.lit(seed))
        other = F.xxhash64(text, F.lit(seed - 1000))
        size = F.octet_length(text).cast("bigint")
        counts = keep(
            df.select(key.alias("key"), other.alias("other"), size.alias("size")).where(F.col("size") >= length).groupBy("key")
            .agg(F.count("*").alias("n"), F.max("size").alias("size"), ((F.min("other") != F.max("other")) | (F.min("size") != F.max("size"))).alias("clash"))
        )
        if counts.where("clash").isEmpty():
            return key, counts
    raise ValueError("no key tells the texts apart")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """The bytes of each text that lie in a string of ``length`` bytes that also starts anywhere else, and the text without them.

    Texts are bytes of UTF-8; strings do not cross texts; they are compared as the
    texts are given, not as they are left, and may overlap. The work is a suffix sort by prefix doubling,
    over content-defined positions (see :func:`anchors`) rather than all. Spark sorts
    positions by the names of their phrases; those that are unique go. The names of
    position and next position are joined to one name, for double the offset, with the rest to the
    bytes that all strings of a position share, which is past the threshold; Spark sorts
    again, and unique ones go. Where the whole of a position's strings occurs twice, they
    all repeat. The other positions fetch their bytes; blocks of their strings,
    then strings, are sorted by 128-bit names in the same way, which settles each string.

    Rows are known by a key of the text, tested to be unique; a text with copies repeats
    throughout. All strings found in one place only by the sorts are dropped early, all others are settled
    whole, however frequent: rows of a frequent string lie in many sorted partitions.

    Returns for each row: ``id_col``, ``n_bytes``, ``spans`` (array of start and stop of maximal
    removed runs, in order) and ``kept`` (binary). Null texts count as empty; texts shorter than ``length``
    keep all. Ids may be null or repeat. Other columns are left out. An empty table gives no rows.
    """
    if length < 64:
        raise ValueError("strings have 64 bytes or more")
    width = 1
    while width * 2 <= min(128, (length + 1 - _GRAM) // 3):
        width *= 2
    scratch = Scratch(df.sparkSession)
    keep, drop = scratch.keep, scratch.drop
    key, counts = _checked_texts(df, text_col, length, keep)
    text = text_or_empty(text_col)
    texts = df.where(F.octet_length(text) >= length).select(key.alias("key"), text.cast("binary").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_of_task(batches):
            data, offsets = utf8_parts(batch.column(1))
            row, name, at, rest, whole = anchors(data, offsets, length, width)
            keys = batch.column(0).to_numpy()
            for s in range(0, len(row), 1 << 19):
                t = slice(s, s + (1 << 19))
                yield _numbers([name[t].view(np.int64), keys[row[t]], at[t], rest[t].view(np.int64), whole[t].view(np.int64)], ["name", "key", "at", "rest", "whole"])

    kinds = "name long, key long, at long, rest long, whole long"
    every = keep(texts.mapInArrow(emit, kinds))

    def not_unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, twice, edge in _repeated(1, 2)(batches):
            yield _numbers(list(x[:, twice | edge]), ["name", "key", "at", "rest", "whole"])

    once = keep(_sorted(every, "name", "key", "at").mapInArrow(not_unique, kinds))
    drop(every)
    place = F.shiftright("at", 24)
    after = once.select("key", place.alias("place"), F.col("name").alias("next_name"))
    strings = once.where(F.col("at").bitwiseAND(255) >= F.shiftright("at", 8).bitwiseAND(255)).withColumn("place", place + F.shiftright("at", 16).bitwiseAND(255))
    double = keep(strings.join(after, ["key", "place"]).select(F.xxhash64("name", "next_name", "rest").alias("name"), "whole", "key", "at"))
    drop(once)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, before, after, has_before, has_after in neighbours(batches):
            near = []
            for y, has in ((before, has_before), (after, has_after)):
                name, whole, same = has & (x[0] == y[0]), x[1] == y[1], (x[2] == y[2]) & (x[3] == y[3])
                near.append((name & whole & ~same, name & ~whole))
            settled = near[0][0] | near[1][0]
            # one of each whole asks, if there are others of the name: the first and the last of its rows
            asks = near[0][1] | near[1][1] | ~(has_before & has_after)
            some = settled | asks
            yield _numbers([x[2][some], x[3][some], settled[some].astype(np.int64), asks[some].astype(np.int64)], ["key", "at", "settled", "asks"])

    judged = keep(_sorted(double, "name", "whole", "key", "at").mapInArrow(settle, "key long, at long, settled long, asks long"))
    drop(double)
    asked = keep(judged.where("asks = 1").groupBy("key").agg(F.collect_set("at").alias("ats")))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            raw, counted = data.tobytes(), batch.column(2)
            ends, ats = counted.offsets.to_numpy(), counted.values.to_numpy()
            pos, lo, hi = _unpacked(ats[ends[0] : ends[-1]])
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            start = pos - hi
            a, b = (offsets[row] + start).tolist(), (offsets[row] + pos - lo + length).tolist()
            keys = batch.column(0).to_numpy()[row]
            for s in range(0, len(a), 1 << 14):
                t = slice(s, s + (1 << 14))
                numbers = [pa.array(c[t]) for c in (keys, start, lo, hi)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array([raw[i:j] for i, j in zip(a[t], b[t])], pa.binary())], ["key", "start", "lo", "hi", "bytes"])

    around = keep(texts.mapInArrow(_first_of_task, "key long, text binary").join(asked, "key").mapInArrow(contexts, "key long, start long, lo long, hi long, bytes binary"))
    drop(asked)

    def opened(batch: pa.RecordBatch):
        """Parts of a batch of contexts: rows, first bytes, and names."""
        data, offsets = utf8_parts(batch.column(4))
        for i0, i1, a, b, _ in _chunks(offsets, 0):
            yield slice(i0, i1), offsets[i0:i1] - a, Names(np.concatenate([data[a:b], np.zeros(8, np.uint8)]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, start, lo, hi = (batch.column(k).to_numpy() for k in range(4))
            for rows, at, names in opened(batch):
                first, count = lo[rows] // _BLOCK, hi[rows] // _BLOCK - lo[rows] // _BLOCK + 1
                row = np.repeat(np.arange(len(count)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                s = at[row] + hi[rows][row] - _BLOCK * k
                name = _mix(names.of(s, s + length - _BLOCK + 1) + k.astype(_U))
                yield _numbers([name.view(np.int64), keys[rows][row], start[rows][row], k], ["name", "key", "start", "k"])

    tested = keep(around.mapInArrow(blocks, "name long, key long, start long, k long"))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, twice, edge in _repeated(1, 3)(batches):
            yield _numbers(list(x[1:, twice | edge]), ["key", "start", "k"])

    shared = keep(_sorted(tested, "name", "key", "start", "k").mapInArrow(common, "key long, start long, k long").groupBy("key", "start").agg(F.bit_or(F.expr("shiftleft(1L, int(k))")).alias("ks")))
    drop(tested)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, start, lo, hi = (batch.column(k).to_numpy() for k in range(4))
            ks = batch.column(5).to_numpy()
            for rows, at, names in opened(batch):
                count = hi[rows] - lo[rows] + 1
                row = np.repeat(np.arange(len(count)), count)
                back = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[rows][row]
                fine = (ks[rows][row] >> (back // _BLOCK)) & 1 == 1
                row, back = row[fine], back[fine]
                s = hi[rows][row] - back
                b = at[row] + s
                yield _numbers([names.of(b, b + length).view(np.int64), names.of(b, b + length, 1).view(np.int64), keys[rows][row], start[rows][row] + s], ["a", "b", "key", "start"])

    single = keep(around.join(shared, ["key", "start"]).select("key", "start", "lo", "hi", "bytes", "ks").mapInArrow(windows, "a long, b long, key long, start long"))
    drop(around, shared)

    def strings_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, twice, edge in _repeated(2, 2)(batches):
            some = twice | edge
            yield _numbers([*x[:, some], twice[some].astype(np.int64), edge[some].astype(np.int64)], ["a", "b", "key", "start", "twice", "edge"])

    found = keep(_sorted(single, "a", "b", "key", "start").mapInArrow(strings_found, "a long, b long, key long, start long, twice long, edge long"))
    drop(single)
    # the first and last rows of partitions meet each other here: two of each partition at most
    spot = F.struct("key", "start")
    met = found.where("edge = 1").groupBy("a", "b").agg(F.min(spot).alias("least"), F.max(spot).alias("most"), F.collect_set(spot).alias("all")).where("least != most")
    met = met.select(F.explode("all").alias("x")).select("x.key", "x.start")
    one = F.lit(1).cast("bigint").alias("n")
    lo, hi = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    covers = judged.where("settled = 1").select("key", (place - hi).alias("start"), (hi - lo + 1).cast("bigint").alias("n"))
    covers = covers.unionAll(found.where("twice = 1").select("key", "start", one)).unionAll(met.select("key", "start", one))
    covers = covers.unionAll(counts.where("n > 1").select("key", F.lit(0).cast("bigint").alias("start"), (F.col("size") - length + 1).alias("n")))
    covers = cut(covers.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("covers")))
    scratch.close()

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            starts, counts = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            spans, kept = [], []
            for i in range(len(batch)):
                x = data[offsets[i] : offsets[i + 1]]
                if ends[i] == ends[i + 1] or not lists[i].is_valid:
                    spans.append([])
                    kept.append(x.tobytes())
                    continue
                change = np.zeros(len(x) + 1, np.int64)
                s, n = starts[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
                np.add.at(change, s, 1)
                np.add.at(change, s + n - 1 + length, -1)
                gone = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                edges = np.flatnonzero(gone[1:] != gone[:-1])
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(x[~gone[1:-1]].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), text.cast("binary").alias("text")).join(covers, "key", "left").select("id", "text", "covers")
    out = rows.mapInArrow(removed, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")
