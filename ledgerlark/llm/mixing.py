"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words as the contract counts them: runs of anything but space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Shards of the mix, each of which has its own quota of every source's blocks.
SHARDS = 16


def _steps(n: int = 8) -> tuple[int, ...]:
    """Multipliers of the block order: primes far apart, of which one is coprime to and far from a multiple of any number of blocks."""
    out = []
    for k in range(n):
        p = int(1_000_000 * 1.618034**k) | 1
        while any(p % q == 0 for q in range(3, int(p**0.5) + 1, 2)):
            p += 2
        out.append(p)
    return tuple(out)


_STEPS = _steps()


def _placed(df: DataFrame, id_col: str, text_col: str, source_col: str, n_cells: int, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its size and a seeded place: a cell, and an order ``h`` in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.crc32(text.cast("binary")).cast("string")).otherwise(F.col(id_col).cast("string"))
    h = F.xxhash64(key, F.lit(seed))
    return df.select(
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("none"),
        F.pmod(h, F.lit(n_cells)).cast("int").alias("cell"),
        h.alias("h"),
        *(F.col(c).alias(f"_{c}") for c in keep),
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, block: int = 64) -> DataFrame:
    """Target words of each source, from a table (src, none, words) of one row a source.

    Sources in code-point order, null last, weigh ``weights``, repeating; all words are
    shared; no target is over ``most`` times its source. The level of the shares is the
    greatest that any number of sources held at their limits gives. Also the block size:
    ``block`` words, or fewer where that would leave under 256 blocks a source.
    The windows run over the table of sources, one row each.
    """
    by_name = Window.orderBy("none", "src")
    w = F.array(*map(F.lit, weights))
    t = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", F.element_at(w, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    by_limit = Window.orderBy(F.col("words") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("words").over(every)).withColumn("n", F.count("*").over(every))
    held = F.coalesce(F.sum(F.col("words") * most).over(by_limit), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_limit), F.lit(0.0))
    t = t.withColumn("level", (F.col("total") - held) / rest).withColumn("level", F.max("level").over(every))
    t = t.withColumn("target", F.least(F.col("words") * most, F.col("level") * F.col("w")))
    return t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.expr("total div (256 * n)"))).cast("bigint")).withColumn(
        "blocks", F.expr("(words + block - 1) div block")
    )


def quotas(targets: DataFrame, shards: int = 16, most: float = 3.0) -> DataFrame:
    """Blocks of each source in the first 1, 2, ... ``shards`` shards of the mix (``upto``), by Sainte-Laguë.

    Rounding each share of the seats gives the apportionment of a number of seats near
    the wanted one; the missing seats go to the highest quotients, surplus ones are taken
    from the lowest. The rule never takes a seat away as seats are added, so the
    difference between two values of ``shard`` is a shard's own quota.
    """
    t = targets.where("target > 0").withColumn("share", F.col("target") / F.col("total")).withColumn("limit", (F.col("blocks") * most).cast("bigint"))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("seats", F.expr(f"(total div block) * shard div {shards}"))
    t = t.withColumn("q", F.least(F.col("limit"), F.floor(F.col("share") * F.col("seats") + 0.5)))
    t = t.withColumn("off", F.col("seats") - F.sum("q").over(Window.partitionBy("shard")))
    steps = t.where("off != 0").select("shard", "rank", "off", "share", "limit", "q", F.explode(F.sequence(F.lit(1), F.abs("off").cast("int"))).alias("j"))
    steps = steps.withColumn("seat", F.when(F.col("off") > 0, F.col("q") + F.col("j")).otherwise(F.col("q") - F.col("j") + 1)).where("seat between 1 and limit")
    quotient = F.col("share") / (2 * F.col("seat") - 1)
    order = Window.partitionBy("shard").orderBy(F.when(F.col("off") > 0, -quotient).otherwise(quotient), F.when(F.col("off") > 0, F.col("rank")).otherwise(-F.col("rank")))
    steps = steps.withColumn("r", F.row_number().over(order)).where("r <= abs(off)").groupBy("shard", "rank").agg(F.sum(F.signum("off")).cast("bigint").alias("fix"))
    return t.join(steps, ["shard", "rank"], "left").select("src", "none", "rank", "shard", (F.col("q") + F.coalesce("fix", F.lit(0))).alias("upto"))


def _laid_out(df: DataFrame, id_col: str, text_col: str, source_col: str, n_cells: int | None, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its span on its source's line of words, and its source's quota."""
    n_cells = n_cells or max(256, -(-df.count() // 50_000))
    rows = _placed(df, id_col, text_col, source_col, n_cells, seed, keep)
    cells = _placed(df, id_col, text_col, source_col, n_cells, seed).groupBy("src", "none", "cell").agg(F.sum("size").alias("cell_words"))
    targets = source_targets(cells.groupBy("src", "none").agg(F.sum("cell_words").alias("words")))
    cuts = F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"])  # SHARDS entries
    quota = quotas(targets, SHARDS).groupBy("rank").agg(cuts.alias("cuts"))
    plan = targets.join(quota, "rank", "left").withColumn("cuts", F.coalesce("cuts", F.array_repeat(F.lit(0).cast("bigint"), SHARDS)))
    plan = plan.select("src", "none", "words", "target", "block", "blocks", "cuts", F.element_at("cuts", -1).alias("quota"))
    before = Window.partitionBy("src", "none").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_words").over(before), F.lit(0))).join(plan, ["src", "none"])
    inside = Window.partitionBy("src", "none", "cell").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["src", "none", "cell"])
    out = out.withColumn("start", F.col("cell_start") + F.col("inside")).withColumn("b", F.greatest("blocks", F.lit(1)))
    turn = seed % len(_STEPS)
    order, b = (*_STEPS[turn:], *_STEPS[:turn]), F.col("b")
    step = F.when(F.lit(False), 1)
    for far in (True, False):  # the first that is no near multiple of b, else any coprime one
        for p in order:
            step = step.when((b % p != 0) & ((F.lit(p) % b / b).between(0.15, 0.85) if far else F.lit(True)), p)
    return out.withColumn("step", step.cast("bigint")).withColumn("shift", F.pmod(F.xxhash64("src", "none", F.lit(seed)), F.col("b"))).withColumn("epochs", F.expr("quota div b")).withColumn("rest", F.expr("quota % b"))


#: Whether the partial epoch takes block k: the first ``rest`` places of a seeded order of the source's blocks.
_TAKES = "pmod(k * step + shift, b) < rest"


def _shard_of(place: str, low: int = 0, high: int = SHARDS - 1) -> str:
    """The shard that takes a place in the seeded order: a search of the shards' last places."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"if({place} < cuts[{mid}], {_shard_of(place, low, mid)}, {_shard_of(place, mid + 1, high)})"


#: A document's taken words by block and round, with their shards. A block has a place in the seeded order of every round; shards take the places in turn, each its quota.
_SHARD_WORDS = f"""flatten(transform(if(size > 0 and quota > 0, sequence(start div block, (start + size - 1) div block), array()),
 k -> transform(filter(transform(sequence(0L, epochs), e -> e * b + pmod(k * step + shift, b)), t -> t < quota),
 t -> struct({_shard_of('t')} as shard, least(start + size, (k + 1) * block) - greatest(start, k * block) as words))))"""


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_cells: int | None = None, seed: int = 17) -> DataFrame:
    """Words that a mix of the sources takes from each document.

    Each source's documents, in a seeded order, form a line of words that is cut into
    equal blocks. Sainte-Laguë gives each source an integer number of blocks in each of
    ``SHARDS`` shards; the shards take them one after another from the source's seeded order of blocks; a source
    whose quota is over its own blocks goes round again, at most three times; the blocks
    of the last, partial round are the first of a seeded order. A document's ``taken``
    is the number of its words in taken blocks, repeats counted.

    The line is laid out by cells of a hash (256, or one for 50,000 rows), so a source of any size is ordered by many
    tasks and a third of all rows in one source is no hot spot. Sums by source and cell
    are the only state; the number of sources is taken to be that of a dimension table.

    Returns ``id_col``, ``size``, ``source_size``, ``target``, ``taken``, ``shard_words`` (these
    by block and round, each with its shard), ``source`` (name as in the input). Null texts have no words; null sources are one source, last
    in order; null ids are placed by their text. Equal rows are placed side by side.
    Reruns agree. An empty table gives no rows; sources without words have target 0.
    """
    rows = _laid_out(df, id_col, text_col, source_col, n_cells, seed)
    blocks = "sequence(start div block, (start + size - 1) div block)"
    part = F.expr(f"if(size > 0 and rest > 0, aggregate({blocks}, 0L, (a, k) -> a + if({_TAKES}, least(start + size, (k + 1) * block) - greatest(start, k * block), 0L)), 0L)")
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        F.col("words").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.col("epochs") * F.col("size") + part).alias("taken"),
        F.expr(_SHARD_WORDS).alias("shard_words"),
        F.expr("if(none, null, src)").alias("source"),
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_cells: int | None = None, seed: int = 17) -> DataFrame:
    """The documents of the mix, with the columns of ``df``: each full round of a source gives its documents whole, the partial round the words of its taken blocks."""
    rest = tuple(c for c in df.columns if c not in (id_col, source_col))
    rows = _laid_out(df, id_col, text_col, source_col, n_cells, seed, rest)
    pattern = (WORD + r"[\x20\x09-\x0D]*").replace("\\", "\\\\")
    words = f"regexp_extract_all(_{text_col}, '{pattern}', 0)"
    whole = f"forall(sequence(start div block, (start + size - 1) div block), k -> {_TAKES})"
    some = f"exists(sequence(start div block, (start + size - 1) div block), k -> {_TAKES})"
    picked = f"array_join(filter({words}, (x, i) -> {_TAKES.replace('k *', '((start + i) div block) *')}), '')"
    part = f"if(size = 0 or rest = 0 or not {some}, null, if({whole}, _{text_col}, {picked}))"
    texts = F.expr(f"concat(if(epochs > 0 and size > 0, array_repeat(_{text_col}, cast(epochs as int)), array()), filter(array({part}), x -> x is not null))")
    made = rows.withColumn("made", F.explode(texts))
    out = {id_col: F.col("id"), source_col: F.expr("if(none, null, src)"), text_col: F.col("made")}
    return made.select(*(out.get(c, F.col(f"_{c}")).alias(c) for c in df.columns))
