"""A micro-batch of a user's operations reads and writes the state once, not for each operation."""

import pandas as pd

from ledgerlark.streaming.session_store import SessionKeys


calls = []


class _State:
    def __init__(self):
        self.held = {}

    def exists(self):
        calls.append("exists")
        return bool(self.held)

    def get(self):
        calls.append("get")
        return self.held["at"]

    def update(self, value):
        calls.append("update")
        self.held["at"] = value

    def iterator(self):
        calls.append("iterator")
        return iter(list(self.held.items()))

    def containsKey(self, k):
        calls.append("containsKey")
        return k in self.held

    def getValue(self, k):
        calls.append("getValue")
        return self.held[k]

    def updateValue(self, k, value):
        calls.append("updateValue")
        self.held[k] = value

    def removeKey(self, k):
        calls.append("removeKey")
        self.held.pop(k, None)

    def clear(self):
        calls.append("clear")
        self.held.clear()


class _Handle:
    def getMapState(self, *_):
        return _State()

    getValueState = getMapState

    def registerTimer(self, _):
        calls.append("registerTimer")


def test_state_is_read_and_written_once_a_batch():
    p = SessionKeys(10_000)
    p.init(_Handle())
    ops = [(1, i, i * 10, "get" if i % 2 else "set", f"k{i % 4 // 2}", f"v{i}", 1.0 if i % 3 == 0 else None) for i in range(400)]
    f = pd.DataFrame(ops, columns=["user_id", "seq", "ms", "op", "k", "v", "ttl"])
    got = pd.concat(p.handleInputRows((1,), iter([f]), None))
    assert got["v"].tolist() == [f"v{i - 1}" for i in range(400) if i % 2]
    assert len(calls) < 20
