"""Bars: roll-ups of ticks, cleaning, validation, returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame) -> DataFrame:
    """OHLCV a symbol and day; ``ts`` orders a day's ticks, ``seq`` breaks ties."""
    order = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.col("ts").cast("date").alias("d")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )


def clean_bars(bars: DataFrame, jump: float = 0.20) -> DataFrame:
    """Fill up to three missing prices forward and then one backward, drop bars without a close, clip negatives,
    swap high and low where they are crossed, and flag closes that moved by more than ``jump``."""
    w = Window.partitionBy("symbol").orderBy("d")
    cols = ["open", "high", "low", "close"]
    for c in cols:
        bars = bars.withColumn(c, F.coalesce(c, F.last(c, True).over(w.rowsBetween(-3, -1))))
    for c in cols:
        bars = bars.withColumn(f"_{c}", F.coalesce(c, F.first(c).over(w.rowsBetween(1, 1))))
    bars = bars.select("symbol", "d", *(F.when(F.col(f"_{c}").isNotNull(), F.greatest(F.lit(0.0), F.col(f"_{c}"))).alias(c) for c in cols), F.greatest(F.lit(0.0), F.coalesce("volume", F.lit(0.0))).alias("volume")).where("close is not null")
    bars = bars.withColumn("hi", F.greatest("high", "low")).withColumn("lo", F.least("high", "low")).drop("high", "low").withColumnsRenamed({"hi": "high", "lo": "low"})
    move = F.abs(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
    return bars.withColumn("corporate_action", F.coalesce(move > jump, F.lit(False)))


def bar_violations(bars: DataFrame) -> DataFrame:
    """Which rules a bar breaks: positive prices, non-negative volume, high and low around open and close, days in order."""
    w = Window.partitionBy("symbol").orderBy("seq")
    return bars.select(
        "symbol", "d",
        (F.least("open", "high", "low", "close") <= 0).alias("bad_price"),
        (F.col("volume") < 0).alias("bad_volume"),
        (F.col("high") < F.greatest("open", "close")).alias("bad_high"),
        (F.col("low") > F.least("open", "close")).alias("bad_low"),
        F.coalesce(F.col("d") < F.lag("d").over(w), F.lit(False)).alias("bad_order"),
    )


def complete_returns(returns: DataFrame, share: float = 0.9) -> DataFrame:
    """Symbols that have returns on at least ``share`` of all days, then only the days that all of these have."""
    n_days = returns.agg(F.floor(F.countDistinct("d") * share).alias("need"))
    rich = returns.groupBy("symbol").agg(F.count("ret").alias("n")).join(F.broadcast(n_days), F.col("n") >= F.col("need"), "left_semi").select("symbol")
    kept = returns.join(rich, "symbol", "left_semi").where("ret is not null")
    n = kept.agg(F.countDistinct("symbol").alias("need"))
    full = kept.groupBy("d").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("need"), "left_semi").select("d")
    return kept.join(full, "d", "left_semi").select("symbol", "d", "ret")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None, fill: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key, the new row winning; of several new rows the last in ``order``.
    Columns in ``fill`` keep the old value where the new one is null. One shuffle, no table lock."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    place = F.struct("_side", *(order or []))
    rest = [c for c in old.columns if c not in keys]
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), place)) if c in (fill or []) else F.max_by(c, place) for c in rest]
    return both.groupBy(*keys).agg(*(v.alias(c) for v, c in zip(values, rest))).select(*old.columns)


def longest_per_key(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row a key: the one of the longest text, the first in ``order`` on ties; blank keys are dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(F.length(F.coalesce(text, F.lit("")))), order)
    return rows.where(F.trim(key) != "").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def trading_hours(ts, zone: str = "Asia/Kolkata"):
    """Whether an instant (UTC) falls on a weekday between 09:15 and 15:30 of ``zone``, both included."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return minute.between(555, 930) & F.dayofweek(local).between(2, 6)


def in_zone(ts: Column, zone: str, of: str | None = None) -> Column:
    """Local times of ``zone``: a time without a zone is taken as local already, one of the zone ``of`` is converted. Null stays null."""
    return ts if of is None else F.convert_timezone(F.lit(of), F.lit(zone), ts)
