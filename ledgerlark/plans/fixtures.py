"""Domain tables (ticks, bars, returns, weights, holdings, ...) as plans over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.operators.bars import daily_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (market segment), ts, seq, price, volume: one tick an order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))


TICKS = "ticks as (select c_mktsegment as symbol, o_orderdate as ts, o_orderkey as seq, o_totalprice as price, 1.0::double as volume from orders join customer on o_custkey = c_custkey)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the market segments."""
    return daily_bars(ticks(spark, sf_dir))


BARS = TICKS + """, bars as (select symbol, cast(ts as date) as d, arg_min(price, (ts, seq)) as open, max(price) as high, min(price) as low,
 arg_max(price, (ts, seq)) as "close", sum(volume) as volume from ticks group by 1, 2)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (brand), d, px (value over quantity), volume: a wide universe of daily prices."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("d"))
    return x.agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("px"), F.sum("l_quantity").alias("volume"))


PRICES = """prices as (select p_brand as symbol, cast(l_shipdate as date) as d, round(sum(l_extendedprice) / sum(l_quantity), 6) as px, sum(l_quantity) as volume
 from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, d, ret: simple returns of :func:`prices`, held within 5 % (the prices are of ever other parts)."""
    w = Window.partitionBy("symbol").orderBy("d")
    r = F.col("px") / F.lag("px").over(w) - 1
    return prices(spark, sf_dir).select("symbol", "d", F.round(F.greatest(F.lit(-0.05), F.least(F.lit(0.05), r)), 9).alias("ret"), r.isNull().alias("first")).where("not first").drop("first")


RETURNS = PRICES + """, returns as (select symbol, d, round(greatest(-0.05, least(0.05, r)), 9) as ret
 from (select symbol, d, px / lag(px) over (partition by symbol order by d) - 1 as r from prices) where r is not null)"""


def _held_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with user_id, symbol and their place in the files (``at``), dealt by customer into eight tasks for each that reads lines, which are not merged: tasks grow in number, not in size, and what follows by customer needs no other shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    x = lines.withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))
    x = x.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.withColumnsRenamed({"o_custkey": "user_id", "p_brand": "symbol"}).repartition(8 * max(1, lines.rdd.getNumPartitions()), "user_id")


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, symbol, quantity, avg_cost, current_value, buy_date: a customer's lines by brand. Money is summed in decimals, so no order of rows moves a sum past the half that a later rounding sees."""
    exact = lambda c: F.sum(c.cast("decimal(24,8)")).cast("double")
    return _held_lines(spark, sf_dir).groupBy("user_id", "symbol").agg(
        F.round(F.sum("l_quantity"), 6).alias("quantity"),
        F.round(exact(F.col("l_extendedprice")) / F.sum("l_quantity"), 6).alias("avg_cost"),
        F.round(exact(F.col("l_quantity") * F.col("p_retailprice")), 6).alias("current_value"),
        F.min("o_orderdate").cast("date").alias("buy_date"),
    )


def holdings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`holdings`, but summed and rounded in doubles as the SQL does, each line added after those before it in the files: where a mean lies at the half of its last digit, the sum's own error decides."""
    w = Window.partitionBy("user_id", "symbol").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounded = lambda c: F.round(c * 1e6) / 1e6
    x = _held_lines(spark, sf_dir).select(
        "user_id",
        "symbol",
        F.sum("l_quantity").over(so_far).alias("quantity"),
        F.sum("l_extendedprice").over(so_far).alias("cost"),
        F.sum(F.col("l_quantity") * F.col("p_retailprice")).over(so_far).alias("value"),
        F.min("o_orderdate").over(so_far).cast("date").alias("buy_date"),
        F.lead(F.lit(True), 1, False).over(w).alias("more"),
    )
    x = x.where("not more")
    return x.select("user_id", "symbol", rounded(F.col("quantity")).alias("quantity"), rounded(F.try_divide("cost", "quantity")).alias("avg_cost"), rounded(F.col("value")).alias("current_value"), "buy_date")


HOLDINGS = """holdings as (select o_custkey as user_id, p_brand as symbol, round(sum(l_quantity), 6) as quantity, round(sum(l_extendedprice) / sum(l_quantity), 6) as avg_cost,
 round(sum(l_quantity * p_retailprice), 6) as current_value, cast(min(o_orderdate) as date) as buy_date
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio (market segment), symbol (brand), weight: shares of value, rounded."""
    h = holdings(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    v = h.groupBy(F.col("c_mktsegment").alias("portfolio"), "symbol").agg(F.sum("current_value").alias("v"))
    return v.select("portfolio", "symbol", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("portfolio")), 9).alias("weight"))


WEIGHTS = HOLDINGS + """, weights as (select c_mktsegment as portfolio, symbol, round(sum(current_value) / sum(sum(current_value)) over (partition by c_mktsegment), 9) as weight
 from holdings join customer on user_id = c_custkey group by 1, 2)"""


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (brand), sector: the brand's most frequent part type, ties by name."""
    n = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"), F.col("p_type").alias("sector")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy(F.desc("n"), "sector")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("symbol", "sector")


SECTORS = "sectors as (select p_brand as symbol, p_type as sector from part group by 1, 2 qualify row_number() over (partition by p_brand order by count(*) desc, p_type) = 1)"


def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio, d, ret: weights times returns, over the symbols that trade on the day, renormalised."""
    from ledgerlark.operators.backtest import weighted_returns

    return weighted_returns(returns(spark, sf_dir), weights(spark, sf_dir)).select("portfolio", "d", F.round("ret", 9).alias("ret"))


PORTFOLIO_RETURNS = RETURNS + ", " + WEIGHTS + """, pret as (select portfolio, d, round(sum(weight * ret) / sum(weight), 9) as ret from returns join weights using (symbol) group by 1, 2)"""
