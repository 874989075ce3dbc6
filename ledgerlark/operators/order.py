"""Ranks and quantiles of keys with any number of rows, from one distributed sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import in_order


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``idx``: rows of a key numbered from 0 by ``order``, and ``rows``: how many there are. The sort is a distributed one, and only counts by key and partition meet, so a key may have any number of rows."""
    x = in_order(df, key, *order).withColumn("_part", F.shiftright("seq", 33))
    parts = x.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy("_k")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rows", F.sum("_n").over(of))
    x = x.join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return x.withColumn("idx", F.col("seq") - F.col("_first") + F.col("_before")).drop("seq", "_part", "_k", "_p", "_first", "_n", "_before")


def quantiles(df: DataFrame, key: str, value: str, at: Sequence[float], into: str = "q") -> DataFrame:
    """``key`` and ``into``: the exact interpolated quantiles of each key at the shares ``at``. No key's values are held together; nulls are left out."""
    x = numbered(df.where(F.col(value).isNotNull()).select(key, value), key, value)
    out = []
    for p in at:
        place = (F.col("rows") - 1) * F.lit(float(p))
        low = F.max(F.when(F.col("idx") == F.floor(place), F.col(value)))
        high = F.max(F.when(F.col("idx") == F.ceil(place), F.col(value)))
        part = F.max(place - F.floor(place))
        out.append(low.cast("double") + (high - low) * part)
    return x.groupBy(key).agg(F.array(*out).alias(into))
