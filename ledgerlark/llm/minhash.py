"""Near-duplicates by consistent weighted sampling of TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, connected_components, cut, prepare, text_or_empty
from .shingles import fingerprint, mix, shingle_hashes, word_hashes

#: Document frequencies are counted in this many hashed buckets, as hashing vectorisers do.
BUCKET_BITS = 18
_PART = 1 << 13
#: Tables of the sampling's random variates have this many entries.
_VARIATES = 1 << 16


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket's shingles, and documents that have any. All documents count.

    Each partition sends one array of fixed size, in parts. The parts are summed in two levels, each by about the root
    of as many tasks a part, one array at a time; the sum, of that same size, reaches the driver.
    """
    n_parts = (1 << BUCKET_BITS) // _PART

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for words in word_hashes(batch.column(0)):
                if len(words):
                    df[np.unique(bucket_of(shingle_hashes(words, width)))] += 1
                    n += 1
        parts = [df[i * _PART : (i + 1) * _PART].tobytes() for i in range(n_parts)] + [np.array([n]).tobytes()]
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(n_parts + 1), pa.int32()), pa.array([at] * (n_parts + 1), pa.int32()), pa.array(parts, pa.binary())], ["part", "of", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                x = np.frombuffer(raw.as_py(), np.int64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "of", "counts"])

    schema = "part int, of int, counts binary"
    one = docs.select("text").mapInArrow(count, schema)
    groups = max(1, round(docs.rdd.getNumPartitions() ** 0.5))
    if groups > 8:
        one = one.withColumn("of", F.pmod("of", F.lit(groups))).repartition(groups, "of").mapInArrow(add, schema)
    rows = one.repartition(8, "part").mapInArrow(add, schema).collect()
    parts = {r.part: np.frombuffer(r.counts, np.int64) for r in rows}
    if not parts:
        return np.zeros(1 << BUCKET_BITS, np.int64), 0
    return np.concatenate([parts[i] for i in range(n_parts)]), int(parts[n_parts][0])


def idf_weights(df: np.ndarray, n: int, strength: float) -> np.ndarray:
    """Weight of each bucket's shingles: from 1, in every document, to 1 + ``strength``, in the fewest that can be told.

    A bucket counts the documents of its own shingles and, in a large table, many rare ones by chance; the median bucket
    tells how many. That is subtracted; what is within four standard deviations of it can't be told from a rare shingle.
    """
    by_chance = float(np.median(df)) if len(df) else 0.0
    least = min(1 + 4 * np.sqrt(by_chance), max(n, 1))
    own = np.clip(df - by_chance, least, max(n, least))
    return (1 + strength * np.log((n + 1) / (own + 1)) / max(np.log((n + 1) / (least + 1)), 1e-9)).clip(1, 1 + strength).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: the chance that two texts share a sample is their weighted Jaccard similarity.

    For each shingle and sample there are gamma variates r and c and a uniform b, here from
    seeded tables by a hash of the shingle; with weight w, t = floor(ln w / r + b), and the
    sample is the shingle (and its t) of the least ln c - r (t - b + 1).
    """

    def __init__(self, samples: int, seed: int = 23):
        g = np.random.default_rng(seed)
        self.r = g.gamma(2.0, 1.0, _VARIATES).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.c = np.log(g.gamma(2.0, 1.0, _VARIATES)).astype(np.float32)
        self.b = g.random(_VARIATES).astype(np.float32)
        self.odd = g.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, hashes: np.ndarray, weights: np.ndarray, step: int = 4096) -> np.ndarray:
        """One number for each sample, equal where shingle and t are."""
        best = np.full(len(self.odd), np.inf, np.float32)
        out = np.zeros(len(self.odd), np.uint64)
        for s in range(0, len(hashes), step):
            h, w = hashes[s : s + step], np.log(weights[s : s + step]).astype(np.float32)[:, None]
            at = ((h[:, None] * self.odd) >> np.uint64(48)).astype(np.int64)
            t = np.floor(w * self.inverse[at] + self.b[at])
            a = self.c[at] - self.r[at] * (t + 1 - self.b[at])
            k = np.argmin(a, 0)
            cols = np.arange(len(k))
            less = a[k, cols] < best
            best = np.where(less, a[k, cols], best)
            found = h[k] + (t[k, cols].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out = np.where(less, found, out)
        return out


def drawn(samples: int, bands: int, rows: int, seed: int = 29) -> np.ndarray:
    """Each band is ``rows`` of the samples, drawn anew, so that few samples make many narrow bands."""
    g = np.random.default_rng([seed, rows])
    return np.stack([g.permutation(samples)[:rows] for _ in range(bands)])


def band_keys(sketch: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """One key for each band of a text's samples."""
    s = sketch.astype(np.uint64)[bands]
    key = mix(np.arange(len(s), dtype=np.uint64) + np.uint64(bands.shape[1] << 32))
    for j in range(s.shape[1]):
        key = mix(key * np.uint64(31) + s[:, j])
    return key.astype(np.int64)


def elements(hashes: np.ndarray) -> np.ndarray:
    """A text's shingles with their counts, packed (see :func:`packed`)."""
    return packed(*np.unique(hashes, return_counts=True))


def packed(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distinct shingles and their counts as 32-bit numbers: how many there are, their hashes, of which the top bits stay those of
    the bucket, in order, then the places of those that repeat, then how often they do beyond once. Few texts have many of these."""
    e, at = np.unique((h >> np.uint64(32)).astype(np.uint32), return_inverse=True)
    n = np.bincount(at, n, len(e)).astype(np.int64)
    again = np.flatnonzero(n > 1)
    return np.concatenate([np.array([len(e)], np.uint32), e, again.astype(np.uint32), np.minimum(n[again] - 1, 2**32 - 1).astype(np.uint32)])


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts."""
    k = int(p[0])
    e, rest = p[1 : k + 1], p[k + 1 :]
    n = np.ones(k)
    n[rest[: len(rest) // 2]] += rest[len(rest) // 2 :]
    return e, n


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Similarity of two packed texts: the lesser of both counts of each shingle times its weight, over the greater."""
    shift = np.uint32(32 - BUCKET_BITS)
    (ea, na), (eb, nb) = unpacked(a), unpacked(b)
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    shared = float(weights[both >> shift] @ np.minimum(na[ia], nb[ib]))
    union = float(weights[ea >> shift] @ na + weights[eb >> shift] @ nb) - shared
    return shared / union if union else 0.0


class SetIndex:
    """Packed texts of a block, found by their shingles."""

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray):
        held, times = zip(*map(unpacked, sets))
        every, owner = np.concatenate(held), np.repeat(np.arange(len(sets)), [len(h) for h in held])
        order = np.argsort(every, kind="stable")
        self.weights, self.every, self.owner, self.count = weights, every[order], owner[order], np.concatenate(times)[order]
        self.heavy = np.bincount(self.owner, self._weight(self.every) * self.count, len(sets))

    def _weight(self, e: np.ndarray) -> np.ndarray:
        return self.weights[e >> np.uint32(32 - BUCKET_BITS)].astype(np.float64)

    def similarities(self, text: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of a packed text with each text of the block."""
        e, times = unpacked(text)
        lo, hi = np.searchsorted(self.every, e, "left"), np.searchsorted(self.every, e, "right")
        n, own = hi - lo, self._weight(e)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], np.repeat(own, n) * np.minimum(self.count[at], np.repeat(times, n)), len(self.heavy))
        return shared / (self.heavy + float(own @ times) - shared)


def linked_blocks(strays: DataFrame, parts: DataFrame, sets: DataFrame, weights: Broadcast, threshold: float, block: int) -> DataFrame:
    """Links (``a``, ``b``) of entries with components that they are not in: one for each block of the component's members that has a link.

    ``strays``: ``key`` and the component (``main``) it is to be compared with. A component's members and its strays are both cut
    into blocks of about ``block``; each pair of blocks is a group, so that no task holds more than two blocks, and rows grow as
    members and strays, not as their product.
    """
    sizes = parts.groupBy("component").agg(F.count("*").alias("m")).withColumnRenamed("component", "main")
    plan = strays.groupBy("main").agg(F.count("*").alias("s")).join(sizes, "main")
    plan = plan.select("main", F.ceil(F.col("m") / block).alias("ms"), F.ceil(F.col("s") / block).alias("ss"))
    deal = lambda k: F.pmod(F.xxhash64("key"), F.col(k))
    members = parts.select(F.col("node").alias("key"), F.col("component").alias("main")).join(plan, "main")
    members = members.select("key", "main", deal("ms").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("ss") - 1)).alias("sb"), F.lit(True).alias("member"))
    others = strays.join(plan, "main").select("key", "main", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"), deal("ss").alias("sb"), F.lit(False).alias("member"))
    work = members.unionByName(others).join(sets.hint("merge"), "key")

    def compare(key, f: pd.DataFrame) -> pd.DataFrame:
        w = weights.value
        f = f.sort_values("key")
        ids, sets_ = f["key"].to_numpy(), [np.frombuffer(e, np.uint32) for e in f["elements"]]
        of, out = np.flatnonzero(f["member"].to_numpy()), []
        if not len(of) or len(of) == len(f):
            return pd.DataFrame({"a": [], "b": []})
        index = SetIndex([sets_[i] for i in of], w)
        for i in np.setdiff1d(np.arange(len(f)), of):
            sim = index.similarities(sets_[i])
            for j in np.argsort(-sim, kind="stable"):
                if sim[j] < threshold - 1e-9:
                    break
                if weighted_jaccard(sets_[i], sets_[of[j]], w) >= threshold:
                    out.append((ids[i], ids[of[j]]))
                    break
        return pd.DataFrame(out, columns=["a", "b"])

    return work.groupBy("main", "mb", "sb").applyInPandas(compare, "a long, b long")


def linked_buckets(opened: DataFrame, sets: DataFrame, weights: Broadcast, threshold: float, block: int) -> DataFrame:
    """Links (``a``, ``b``) of entries that share a bucket and are in different components: enough to join all components that have one.

    ``opened``: ``bucket``, ``key`` and ``component``. A bucket is cut into blocks of about ``block`` entries, and each pair of its blocks
    is a group: a bucket of any size is compared in full, no task holds more than two blocks, and no pairs are rows.
    """
    plan = opened.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = opened.join(plan, "bucket").withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    work = dealt.select("bucket", "key", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(sets.hint("merge"), "key")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        w, (_, lo, hi) = weights.value, (x.as_py() for x in key)
        t = t.sort_by("key")
        ids, parts, own = (t[c].to_numpy().copy() for c in ("key", "component", "own"))
        sets_, (of, others) = [np.frombuffer(e.as_py(), np.uint32) for e in t["elements"]], (np.flatnonzero(own == x) for x in (lo, hi))
        index, out = SetIndex([sets_[i] for i in of], w) if len(of) and len(others) else None, []
        for i in others if index else ():
            apart = parts[of] != parts[i]
            if apart.any():
                for j in of[apart & (index.similarities(sets_[i]) >= threshold - 1e-9)]:
                    # what one link has joined needs no other
                    if parts[j] != parts[i] and weighted_jaccard(sets_[i], sets_[j], w) >= threshold:
                        out.append((ids[i], ids[j]))
                        parts[parts == parts[j]] = parts[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return work.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, samples: int = 64, bands: int = 40, rows: int = 6, fine_samples: int = 384, fine_bands: int = 256, fine_rows: int = 14, crowded: int | None = 64, idf_strength: float = 0.5, open_pairs: float = 8.0, block: int = 512
) -> DataFrame:
    """Classes of documents connected by weighted Jaccard similarity of ``threshold`` or more over TF-IDF shingles.

    Words are runs of ASCII letters, digits and non-ASCII characters, in lower case;
    shingles are ``width`` words (a shorter text is one shingle). A shingle's weight is its
    count in the text times an inverse document frequency, damped to 1 .. 1 + ``idf_strength``
    and counted over all documents in hashed buckets. Texts of one word sequence are one
    entry, whatever their ids. Entries meet in a bucket if all samples of one of ``bands``
    bands agree. A band is ``rows`` of the ``samples``, drawn at random: at similarity 0.8 all
    but about one pair in a thousand meet, while texts that share no more than a passage seldom do.

    A bucket's centre is the entry that meets the most others, as the source of many copies
    does. Each entry is first compared with the centres of all its buckets; links make components.
    Entries of a bucket outside its centre's component are then compared with that whole component,
    in blocks of ``block`` entries that are joined by sets of shingles and not by pairs (see
    :func:`linked_blocks`). What this leaves of a bucket in several components goes on; if that is over
    ``crowded`` entries (texts that share a passage, say), they get ``fine_samples`` new samples,
    independent of the first, and are dealt anew into ``fine_bands`` bands of ``fine_rows`` of these. Of
    pairs at similarity 0.8 these miss 0.05 %, the first bands 0.08 % (computed), so a crowded bucket
    loses hardly more than a small one, while texts that share only a passage seldom meet there. In what is
    open then, entries in different components are compared in blocks again (see :func:`linked_buckets`); if
    their pairs were more than ``open_pairs`` times the bucket entries, 1, 2, 4, ... further centres of each
    bucket are compared with it first, which leaves fewer components. So no link between entries that met in
    these buckets is lost, and a group of n copies gives on the order of n pairs. With ``crowded`` None no bucket
    is dealt anew: whatever is open is compared in full, which costs the square of a bucket's open entries.

    Texts are read twice: for the document frequencies, and for an entry's bands and its set of
    shingles, which go to tables in the shared folder and are dropped as the work ends.

    Returns ``id_col``, ``class_id`` (smallest id of the class), ``text_hash`` (xxhash64 of the text)
    and ``kept``: the row of that id stays, and if the class has several texts of that id, the one of
    the smallest hash. Empty and null texts are equal, and so one class; a text without words is like
    its equals only. Null ids take part, after all others; class_id is null if the class has no id.
    Rows that repeat an id with different texts are documents of their own, each in the
    class of its text; rows that repeat both share their verdict. Other columns are left out. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    scratch = Scratch(spark)
    keep, drop = scratch.keep, scratch.drop
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    weights = spark.sparkContext.broadcast(idf_weights(*document_frequencies(docs, width), idf_strength))
    picks, fine_picks = drawn(samples, bands, rows), drawn(fine_samples, fine_bands, fine_rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, w = Sampler(samples), weights.value
        for batch in batches:
            prints, buckets, sets = [], [], []
            for text, words in zip(batch.column(1), word_hashes(batch.column(1))):
                prints.append(fingerprint(words, text))
                h, n = np.unique(shingle_hashes(words, width), return_counts=True)
                sets.append(packed(h, n).tobytes())
                buckets.append(band_keys(mix(sampler.sample(h, n * w[bucket_of(h)])) >> np.uint64(32), picks) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "text_hash", "print", "buckets", "elements"])

    def sign_anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, w = Sampler(fine_samples, seed=31), weights.value
        for batch in batches:
            found = [unpacked(np.frombuffer(e.as_py(), np.uint32)) for e in batch.column(1)]
            keys = [band_keys(mix(sampler.sample(mix(e.astype(np.uint64)), n * w[e >> np.uint32(32 - BUCKET_BITS)], 1024)) >> np.uint64(32), fine_picks) for e, n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["key", "buckets"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            sim = [weighted_jaccard(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), w) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    kind = df.schema[id_col].dataType.simpleString()
    # a row's number names it from here on; it is fixed as the table is written
    signed = keep(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, f"id {kind}, text_hash long, print binary, buckets array<long>, elements binary").withColumn("row", F.monotonically_increasing_id()))
    first_row = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash"))
    entries = keep(signed.groupBy("print").agg(F.min("row").alias("key"), first_row.alias("first")))

    def meeting(dealt: DataFrame) -> DataFrame:
        """``key``, its ``buckets`` of several entries, and how many rows those hold in all (``fame``)."""
        each = dealt.select("key", F.explode("buckets").alias("bucket"))
        shared = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        return keep(each.join(shared, "bucket").groupBy("key").agg(F.sum("n").alias("fame"), F.collect_list("bucket").alias("buckets")))

    def ranks(met: DataFrame) -> DataFrame:
        return met.select("key", F.explode("buckets").alias("bucket"), F.struct("fame", (-F.col("key")).alias("k")).alias("rank"))

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("x")).hint("merge"), "a")
        y = x.join(sets.select(F.col("key").alias("b"), F.col("elements").alias("y")).hint("merge"), "b")
        return keep(y.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, sim double"))

    def pairs_of(stars: DataFrame) -> DataFrame:
        return stars.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()

    def components(links: DataFrame) -> DataFrame:
        return connected_components(links, scratch)

    def links_of(sims: DataFrame) -> DataFrame:
        return sims.where(F.col("sim") >= threshold).select("a", "b")

    def still_open(ranked: DataFrame, parts: DataFrame, strays: bool = False) -> DataFrame:
        """Rows of the buckets that hold several components, with the component of the bucket's first in rank (``main``); of a bucket of one component there is no more to find. ``strays``: without that component."""
        of = ranked.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        mixed = of.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.max(F.struct("rank", "component"))["component"].alias("main"))
        mixed = mixed.where("lo != hi").select(F.col("bucket").alias("in"), "n", "main")
        return of.join(mixed, (F.col("bucket") == F.col("in")) & (F.col("component") != F.col("main") if strays else F.lit(True))).drop("in")

    own = signed.where("buckets is not null").select(F.col("row").alias("key"), "buckets").join(entries.hint("merge"), "key", "left_semi")
    dealt = keep(own)
    met = meeting(dealt)
    drop(dealt)
    sets = keep(signed.select(F.col("row").alias("key"), "elements").join(met.hint("merge"), "key", "left_semi"))
    # first each entry with the most famous entry of each of its buckets
    ranked = ranks(met)
    top = ranked.groupBy("bucket").agg((-F.max("rank")["k"]).alias("centre"))
    sims = verified(pairs_of(ranked.join(top, "bucket").where("key != centre").select("key", "centre").distinct()))
    parts = components(links_of(sims))
    # then what is outside the component of its bucket's centre with all of that component
    opened = keep(still_open(ranked, parts, strays=True))
    found = keep(linked_blocks(opened.select("key", "main").distinct(), parts, sets, weights, threshold, block))
    links = keep(links_of(sims).unionByName(found))
    drop(parts, found)
    parts = components(links)
    opened2 = keep(still_open(opened.select("bucket", "key", "rank"), parts).select("bucket", "key", "rank", "n"))
    drop(opened)
    if crowded is None:
        ranked, spent = opened2.select("key", "bucket", "rank"), [opened2]
    else:
        anew = keep(sets.join(opened2.where(F.col("n") > crowded).select("key").distinct(), "key", "left_semi").mapInArrow(sign_anew, "key long, buckets array<long>"))
        fine = meeting(anew)
        ranked, spent = keep(opened2.where(F.col("n") <= crowded).select("key", "bucket", "rank").unionByName(ranks(fine))), [opened2, anew, fine]
    of = keep(still_open(ranked, parts).select("bucket", "key", "rank", "component"))
    drop(*spent)
    wide = 1
    while not of.isEmpty():
        counts = of.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        open_, total = counts.agg(F.sum(F.expr("m * m - cc") / 2), F.sum("m")).first()
        if open_ <= open_pairs * max(total, 100_000):
            found = keep(linked_buckets(of.select("bucket", "key", "component"), sets, weights, threshold, block))
            parts = components(keep(links.unionByName(found)))
            break
        first = of.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("rank")))).where(F.col("r") <= wide).select("bucket", F.col("key").alias("centre"))
        pairs = keep(pairs_of(of.join(first, "bucket").where("key != centre")).join(sims, ["a", "b"], "left_anti"))
        more = verified(pairs)
        both, joined = keep(sims.unionByName(more)), keep(links.unionByName(links_of(more)))
        drop(pairs, more, sims, links, parts)
        sims, links, parts = both, joined, components(joined)
        # an entry that has been compared with a whole bucket needs no more there
        rest = keep(still_open(of.join(first.withColumnRenamed("centre", "key"), ["bucket", "key"], "left_anti").select("bucket", "key", "rank"), parts).select("bucket", "key", "rank", "component"))
        drop(of)
        of, wide = rest, wide * 2
    drop(sets)
    linked = entries.join(parts, F.col("key") == F.col("node")).select("key", "first", "component")
    named = linked.join(linked.groupBy("component").agg(F.min("first").alias("joined")), "component").select("key", "joined")
    classes = keep(entries.join(named, "key", "left").select("print", F.coalesce("joined", "first").alias("first")))
    out = signed.select("id", "text_hash", "print").join(classes.hint("merge"), "print")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    out = cut(out.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), kept.alias("kept"), "text_hash"))
    scratch.close()
    return out
