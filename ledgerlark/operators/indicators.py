"""Technical indicators over ordered series. Each function adds columns; frames are rows of one symbol by day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.order import numbered
from ledgerlark.session import with_package


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def trailing(n: int) -> Window:
    return by_symbol().rowsBetween(-(n - 1), 0)


def sma(c: str, n: int) -> Column:
    """Mean of the last ``n`` rows, of fewer at the start."""
    return F.avg(c).over(trailing(n))


def full(value: Column, n: int, c: str = "close") -> Column:
    """``value`` where the window has ``n`` rows, else null."""
    return F.when(F.count(c).over(trailing(n)) == n, value)


def previous(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())




def with_rsi_simple(df: DataFrame, c: str = "close", n: int = 14) -> DataFrame:
    df = df.withColumn("_move", F.col(c) - previous(c))
    gain = F.avg(F.greatest(F.col("_move"), F.lit(0.0))).over(trailing(n))
    loss = F.avg(F.greatest(-F.col("_move"), F.lit(0.0))).over(trailing(n))
    return df.withColumn("rsi", 100 - 100 / (1 + gain / (loss + 1e-10))).drop("_move")


def with_bollinger(df: DataFrame, n: int = 20, k: float = 2.0, sample: bool = False) -> DataFrame:
    """Bands of ``k`` deviations (of the population, or of the sample with null as 0) about the mean of ``n`` rows."""
    sd = F.coalesce(F.stddev_samp("close").over(trailing(n)), F.lit(0.0)) if sample else F.stddev_pop("close").over(trailing(n))
    df = df.withColumn("bb_mid", sma("close", n)).withColumn("_sd", sd)
    df = df.withColumn("bb_upper", F.col("bb_mid") + k * F.col("_sd")).withColumn("bb_lower", F.col("bb_mid") - k * F.col("_sd")).drop("_sd")
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumn("bb_width", width / F.nullif(F.col("bb_mid"), F.lit(0.0))).withColumn("bb_position", (F.col("close") - F.col("bb_lower")) / F.nullif(width, F.lit(0.0)))


def stochastic(n: int = 14, high: str = "high", low: str = "low") -> Column:
    """Place of the close in the range of ``n`` rows, 0 to 100."""
    lo, hi = F.min(low).over(trailing(n)), F.max(high).over(trailing(n))
    return 100 * (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0))


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range; the first row's range is high less low."""
    p = previous("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))
    return df.withColumn("tr", tr).withColumn("atr", sma("tr", n)).drop("tr")


def with_obv(df: DataFrame) -> DataFrame:
    """On-balance volume: running sum of volume signed by the move."""
    df = df.withColumn("_signed", F.coalesce(F.signum(F.col("close") - previous("close")), F.lit(0.0)) * F.col("volume"))
    return df.withColumn("obv", F.sum("_signed").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_signed")


def finite(c: str | Column) -> Column:
    """Null, NaN and infinities as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def price_features(df: DataFrame) -> DataFrame:
    """Returns over 1, 5, 10, 20 rows, distance from means, realised volatility, range and its z-score, gap."""
    df = df.withColumn("ret_1", F.col("close") / previous("close") - 1)
    for n in (5, 10, 20):
        df = df.withColumn(f"ret_{n}", F.col("close") / previous("close", n) - 1)
    for n in (5, 20):
        df = df.withColumn(f"from_sma_{n}", full(F.col("close") / sma("close", n) - 1, n)).withColumn(f"vol_{n}", full(F.stddev_samp("ret_1").over(trailing(n)), n, "ret_1"))
    df = df.withColumn("range", (F.col("high") - F.col("low")) / F.col("close"))
    z = (F.col("range") - F.avg("range").over(trailing(20))) / F.nullif(F.stddev_samp("range").over(trailing(20)), F.lit(0.0))
    df = df.withColumn("range_z", full(z, 20)).withColumn("gap", F.col("open") / previous("close") - 1)
    names = ["ret_1", "ret_5", "ret_10", "ret_20", "from_sma_5", "from_sma_20", "vol_5", "vol_20", "range", "range_z", "gap"]
    return df.select("symbol", "d", *(finite(c).alias(c) for c in names))


def volume_features(df: DataFrame) -> DataFrame:
    """Volume changes, ratio to its mean, z-score, and divergence from the price."""
    change = F.col("volume") / F.nullif(previous("volume"), F.lit(0.0)) - 1
    ratio = F.col("volume") / F.nullif(sma("volume", 20), F.lit(0.0))
    z = (F.col("volume") - sma("volume", 20)) / F.nullif(F.stddev_samp("volume").over(trailing(20)), F.lit(0.0))
    df = df.withColumn("vol_change", change).withColumn("vol_ratio", ratio).withColumn("vol_z", full(z, 20, "volume"))
    divergence = F.signum(F.col("close") - previous("close")) * F.signum(F.col("volume") - previous("volume"))
    df = df.withColumn("divergence", F.when(divergence < 0, 1.0).otherwise(0.0))
    return df.select("symbol", "d", *(finite(c).alias(c) for c in ("vol_change", "vol_ratio", "vol_z", "divergence")))


def _ewm(x: np.ndarray, alpha: float, start: float | None = None) -> np.ndarray:
    out = np.empty(len(x))
    level = x[0] if start is None else start
    for i, v in enumerate(x):
        level = level + alpha * (v - level) if i or start is not None else level
        out[i] = level
    return out


def _wilder(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), 50.0)
    move = np.diff(x)
    up, down = np.maximum(move, 0), np.maximum(-move, 0)
    if len(move) >= n:
        g, s = up[:n].mean(), down[:n].mean()
        for i in range(n, len(x)):
            if i > n:
                g, s = (g * (n - 1) + up[i - 1]) / n, (s * (n - 1) + down[i - 1]) / n
            out[i] = 100.0 if s == 0 else 100 - 100 / (1 + g / s)
    return out


def recursive_indicators(df: DataFrame) -> DataFrame:
    """Series that feed on themselves, one symbol's history a group: EMA 20 seeded by the first price, MACD 12/26/9,
    Wilder's RSI 14 and volatility by exponential weights (0.94). A group is one symbol's bars."""
    with_package(df.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("d")
        x = f["close"].to_numpy(float)
        fast, slow = _ewm(x, 2 / 13), _ewm(x, 2 / 27)
        macd = fast - slow
        signal = _ewm(macd, 2 / 10)
        r = np.zeros(len(x))
        r[1:] = np.diff(x) / x[:-1]
        var = _ewm(r**2, 0.06)
        return pd.DataFrame({"symbol": f["symbol"], "d": f["d"], "ema_20": _ewm(x, 2 / 21), "macd": macd, "signal": signal, "histogram": macd - signal, "rsi_wilder": _wilder(x, 14), "ewma_vol": np.sqrt(var * 252)})

    kinds = "symbol string, d date, ema_20 double, macd double, signal double, histogram double, rsi_wilder double, ewma_vol double"
    return df.select("symbol", "d", "close").groupBy("symbol").applyInPandas(run, kinds)


def ema_last(df: DataFrame, n: int) -> DataFrame:
    """Last EMA of each symbol seeded by its first close: a fold over the ordered closes."""
    a = 2.0 / (n + 1)
    series = df.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "close"))), lambda x: x["close"]).alias("x"))
    return series.select("symbol", F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.element_at("x", 1), lambda e, v: e + a * (v - e)).alias("ema"))


def linear_forecast(df: DataFrame, steps: int = 5, last: int = 20) -> DataFrame:
    """The line through the last ``last`` closes, carried on ``steps`` rows, and whether it moves by over 2 %."""
    w = Window.partitionBy("symbol").orderBy(F.desc("d"))
    x = df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last).withColumn("t", (last - F.col("back")).cast("double"))
    fit = x.groupBy("symbol").agg(F.regr_slope("close", "t").alias("slope"), F.regr_intercept("close", "t").alias("level"), F.max_by("close", "t").alias("close"))
    out = fit.select("symbol", "close", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "slope", "level")
    out = out.withColumn("forecast", F.col("level") + F.col("slope") * (last - 1 + F.col("step")))
    change = F.col("slope") * steps / F.col("close")
    return out.select("symbol", "step", "forecast", F.when(change > 0.02, "up").when(change < -0.02, "down").otherwise("flat").alias("trend"))


def trailing_positive_streak(df: DataFrame, value: str) -> DataFrame:
    """Total, mean, positive rows and the length of the last run of positive rows of each symbol."""
    last_bad = F.max(F.when(F.col(value) <= 0, F.col("d")))
    bad = df.groupBy("symbol").agg(last_bad.alias("bad"))
    return df.join(bad, "symbol").groupBy("symbol").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("positive_days"), F.count_if(F.col("bad").isNull() | (F.col("d") > F.col("bad"))).alias("streak")
    )


def last_ema_weight(i: Column, n: Column, period: int) -> Column:
    """Weight of the ``i``-th of ``n`` values in the last EMA that is seeded by the mean of the first ``period``: the EMA is then a plain sum."""
    a = 2.0 / (period + 1)
    return F.when(i < period, F.pow(F.lit(1 - a), F.greatest(n - period, F.lit(0))) / period).otherwise(a * F.pow(F.lit(1 - a), n - 1 - i))


def macd_weights(width: int = 26, fast: int = 12, slow: int = 26) -> list[float]:
    """Weights of a window's values in the difference of two EMAs that are seeded anew in each window."""

    def weights(p: int) -> list[float]:
        a = 2.0 / (p + 1)
        return [(1 - a) ** max(width - p, 0) / p if i < p else a * (1 - a) ** (width - 1 - i) for i in range(width)]

    return [f - s for f, s in zip(weights(fast), weights(slow))]


def macd_reseeded(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Last MACD of each symbol (``symbol``, ``d``, ``close``), its signal over MACDs of windows of ``slow`` days that are each seeded anew, and what they say.

    Every EMA is a weighted sum, so that a symbol's series is summed and not folded. Up to ``slow`` days there is no window, and the signal is the line.
    """
    by = Window.partitionBy("symbol").orderBy("d")
    x = df.select("symbol", "close", (F.row_number().over(by) - 1).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"), F.collect_list("close").over(by.rowsBetween(1 - slow, 0)).alias("last"))
    c = F.array(*map(F.lit, macd_weights(slow, fast, slow)))
    dot = F.aggregate(F.zip_with("last", c, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    line = F.sum(F.col("close") * (last_ema_weight(F.col("i"), F.col("n"), fast) - last_ema_weight(F.col("i"), F.col("n"), slow)))
    later = F.sum(F.when(F.col("i") >= slow, dot * last_ema_weight(F.col("i") - slow, F.col("n") - slow, signal)))
    g = x.groupBy("symbol").agg(line.alias("macd_line"), later.alias("signal_line"))
    g = g.withColumn("signal_line", F.coalesce("signal_line", "macd_line")).withColumn("histogram", F.col("macd_line") - F.col("signal_line"))
    return g.withColumn("signal", F.when(F.col("histogram") > 0, "bullish").otherwise("bearish"))


def ema_from_mean(df: DataFrame, period: int, key: str = "symbol", order: str = "d", value: str = "close") -> DataFrame:
    """``key`` and ``ema``: the last exponential mean of each key, begun from the mean of its first ``period`` values.

    The fold is a weighted sum: a value k rows before the last weighs m (1 - m)^k, m = 2 / (period + 1), and the start what is left. So a key's rows are numbered by
    one distributed sort and summed, and no key is folded in one task. The first sum is divided by ``period`` also where there are fewer values. Nulls are left out.
    """
    x = numbered(df.where(F.col(value).isNotNull()).select(key, order, value), key, order)
    m = 2 / (period + 1)
    rest = F.col("rows") - 1 - F.col("idx")
    start = F.when(F.col("idx") < period, F.col(value) / period * F.pow(F.lit(1 - m), F.greatest(F.lit(0), F.col("rows") - period)))
    return x.groupBy(key).agg(F.sum(F.coalesce(start, F.col(value) * m * F.pow(F.lit(1 - m), rest))).alias("ema"))
