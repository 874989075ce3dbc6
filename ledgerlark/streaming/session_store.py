"""Session keys with a time to live, as arbitrary state of a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerlark.session import with_package

#: Keys that no operation changes.
IMMUTABLE = ("user_id", "session_id")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class SessionKeys(StatefulProcessor):
    """The keys of one user: a map of key to value and time of expiry, and the time of the last operation."""

    def __init__(self, session_ttl_ms: int):
        self.session_ttl = session_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "k string", "v string, expires long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A user's operations of a micro-batch run on a copy of the state; what changed is written once, after the last."""
        f = pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")
        had = {k[0]: v for k, v in self.keys.iterator()}
        was = last = self.last.get()[0] if self.last.exists() else None
        keys, timers, out = dict(had), set(), []
        for seq, now, op, k, v, ttl in zip(f["seq"].tolist(), f["ms"].tolist(), f["op"], f["k"], f["v"], f["ttl"].tolist()):
            if last is not None and now - last >= self.session_ttl:
                keys.clear()
            last = now if last is None else max(now, last)
            if op == "clear":
                keys.clear()
            elif op == "get":
                found, expires = keys.get(k, (None, None))
                out.append((key[0], seq, now, "get", k, found if expires is None or now < expires else None))
            elif k in IMMUTABLE:
                continue
            elif op == "delete":
                keys.pop(k, None)
            elif op == "set":
                expires = None if pd.isna(ttl) else now + int(ttl * 1000)
                keys[k] = (v, expires)
                if expires is not None:
                    timers.add(expires)
        if last != was:
            self.last.update((last,))
        for k in had.keys() - keys.keys():
            self.keys.removeKey((k,))
        for k, value in keys.items():
            if k not in had or tuple(had[k]) != value:
                self.keys.updateValue((k,), value)
        # A timer only clears its key's place, and a key set anew or gone by now has none to clear, so timers of the values that stay are enough.
        for expires in timers & {e for _, e in keys.values()}:
            self.handle.registerTimer(expires)
        yield pd.DataFrame(out, columns=["user_id", "seq", "ms", "op", "k", "v"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], v[0]) for k, v in self.keys.iterator() if v[1] is not None and v[1] <= now]
        for k, _ in gone:
            self.keys.removeKey((k,))
        yield pd.DataFrame([(key[0], None, now, "expired", k, v) for k, v in gone], columns=["user_id", "seq", "ms", "op", "k", "v"])

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> SparkSession:
    """State of this kind lives in RocksDB; the setting holds for queries that start from now on."""
    spark.conf.set(_PROVIDER, _ROCKS)
    return spark


def session_keys(ops: DataFrame, session_ttl: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """Answers of a store of session keys to a stream of operations.

    ``ops`` has user_id (long), seq (long), ts (timestamp), op (set, get, delete, clear), k, v (strings), ttl (seconds; null: until the session ends).
    Operations of a user are taken by time, then seq, within a micro-batch. A key is gone once its time to live has
    passed, by the times of the operations, whether or not the timer has fired, and all keys of a user are gone ``session_ttl`` seconds after
    the last operation. ``user_id`` and ``session_id`` cannot be set. A timer removes each expired key
    from the state once the watermark, ``delay`` behind the latest operation, has passed its time, so the state does not grow with keys of the past.

    Gives a row for each get (``v`` null if there is no such key), and one ``expired`` for each key that a timer removed. State, timers and
    output commit together, so a query that is started again from its checkpoint gives no row twice and misses none.
    """
    with_package(with_state_store(ops.sparkSession))
    x = ops.selectExpr("user_id", "seq", "cast(ts as timestamp) as ts", "unix_millis(cast(ts as timestamp)) as ms", "op", "k", "v", "cast(ttl as double) as ttl").withWatermark("ts", delay)
    kind = "user_id long, seq long, ms long, op string, k string, v string"
    return x.groupBy("user_id").transformWithStateInPandas(SessionKeys(session_ttl * 1000), kind, "append", "EventTime")
