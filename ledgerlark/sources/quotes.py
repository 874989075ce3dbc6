"""Quotes fetched by symbol: a Python data source with retries, whose failures are rows."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlark.session import with_package

SCHEMA = "symbol string, d date, open double, high double, low double, close double, volume double, tries int, error string"
_BARS = ["d", "open", "high", "low", "close", "volume"]


def fetch(path: str, symbol: str, start: str | None, end: str | None) -> pa.Table:
    """The bars of a symbol from the folder ``symbol=...`` of a partitioned Parquet table, in any store that pyarrow reads."""
    import datetime

    import pyarrow.dataset as ds
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    t = ds.dataset(f"{root}/symbol={symbol}", filesystem=store, format="parquet")
    when = None
    for bound, keep in ((start, lambda x: ds.field("d") >= x), (end, lambda x: ds.field("d") < x)):
        if bound:
            more = keep(pa.scalar(datetime.date.fromisoformat(bound)))
            when = more if when is None else when & more
    found = t.to_table(columns=_BARS, filter=when)
    if not len(found):
        raise ValueError(f"No data for symbol {symbol}")
    return found


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.options["symbols"].split(",") if s]

    def read(self, partition: _Symbol) -> Iterator[pa.RecordBatch]:
        o, symbol = self.options, partition.symbol
        most, wait = int(o.get("tries", 3)), float(o.get("wait", 1))
        for k in range(most):
            try:
                t = fetch(o["path"], symbol, o.get("start"), o.get("end"))
                break
            except Exception as e:  # any failure is tried again, then told
                error = f"{type(e).__name__}: {e}" if not isinstance(e, (ValueError, FileNotFoundError)) else f"No data for symbol {symbol}"
                if k + 1 < most:
                    time.sleep(wait * 2**k)
        else:
            t, k = pa.table({"d": pa.array([None], pa.date32()), **{c: pa.array([None], pa.float64()) for c in _BARS[1:]}}), most - 1
        failed = t.column("close").null_count == len(t)
        columns = [pa.array([symbol] * len(t)), t.column("d").cast(pa.date32()), *(t.column(c).cast(pa.float64()) for c in _BARS[1:])]
        extra = [pa.array([k + 1] * len(t), pa.int32()), pa.array([error if failed else None] * len(t), pa.string())]
        yield from pa.table([*columns, *extra], ["symbol", *_BARS, "tries", "error"]).to_batches(max_chunksize=10_000)


class Quotes(DataSource):
    """``spark.read.format("quotes")``: options path, symbols (with commas between), start, end (excluded), tries, wait (seconds before the second try, then double)."""

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetch_bars(spark: SparkSession, path: str, symbols: list[str], start: str | None = None, end: str | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Bars of many symbols, each fetched by a task of its own, so as many at once as the cluster has cores.

    A symbol that fails, or has no data, ``tries`` times (waiting ``wait`` seconds, then twice as long, ...) gives one row with ``error`` and no bar, and
    does not fail the others. ``tries`` tells how many it took.
    """
    with_package(spark).dataSource.register(Quotes)
    r = spark.read.format("quotes").option("path", path).option("symbols", ",".join(symbols)).option("tries", tries).option("wait", wait)
    for name, value in (("start", start), ("end", end)):
        r = r.option(name, value) if value else r
    return r.load()
