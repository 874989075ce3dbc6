"""Event-time roll-ups as Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_rollup(events: DataFrame, delay: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and total of ``value`` by hour and ``key`` of a streaming frame; an hour is given out once the watermark, ``delay`` behind the latest event, has passed it."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return stamped.groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("hour"), key, "n", "total")


def daily_bars_stream(ticks: DataFrame, delay: str = "3 days") -> DataFrame:
    """OHLCV by symbol and day of a streaming frame (symbol, ts, seq, price, volume). Ticks up to ``delay`` late still count; a day is given out once the watermark has passed it."""
    stamped = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    order = F.struct("ts", "seq")
    bars = stamped.groupBy(F.window("ts", "1 day").alias("w"), "symbol").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("date").alias("d"), "open", "high", "low", "close", "volume")


def first_of_key(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row of each key within the watermark, so that an event delivered again is not counted again; a sink that merges by key makes the whole idempotent."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str = "user_id", gap: str = "24 hours", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without an event: first and last event, number of turns."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_at", F.col(ts)).withWatermark(ts, delay)
    s = stamped.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("turns"), F.max("_at").alias("last_active"))
    return s.select(key, F.col("w.start").alias("started"), "last_active", "turns")


def request_counts(stream: DataFrame, key: str = "user_id", width: str = "60 seconds", slide: str = "10 seconds", limit: int = 100, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Requests of a key in each sliding window, and whether they are over the limit."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return stamped.groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))


def _folder(spark) -> str:
    """A new folder under the shared one; without a setting, a temporary one for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def latest_of_key(stream: DataFrame, key: str, order: list[str], others: list[str]) -> DataFrame:
    """The latest state of each key, by ``order``, after all that the source of a streaming frame has now.

    The state store holds a row a key; each micro-batch writes only the keys that it changed, into a folder of its number, so a batch that is
    run again writes the same. A reader takes a key's row of the greatest batch. Null keys are one key; ties in ``order`` go by ``others``.
    """
    spark = stream.sparkSession
    folder = _folder(spark)
    state = stream.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("s"), F.count("*").alias("updates")).select(key, "s.*", "updates")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").schema(state.schema.add("batch", "long")).parquet(f"{folder}/out")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*order, *others, "updates"), "batch").alias("s"))
    return last.select(key, "s.*")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Run a streaming frame over all that its source has now, into Parquet in the shared folder; the result is that table."""
    spark = stream.sparkSession
    folder = _folder(spark)
    job = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
