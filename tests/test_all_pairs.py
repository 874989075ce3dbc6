"""Correlations are of every pair of symbols, checked by numpy."""

import numpy as np

from ledgerlark import catalog
from ledgerlark.plans import fixtures as X

D = "/root/testdata/sf0.01"


def test_every_pair(spark):
    wide = X.returns(spark, D).toPandas().astype({"ret": float}).pivot(index="d", columns="symbol", values="ret")
    want = {}
    for i, a in enumerate(names := sorted(wide.columns)):
        for b in names[i + 1 :]:
            both = wide[[a, b]].dropna().to_numpy()
            if len(both) >= 30:
                want[a, b] = len(both), np.corrcoef(both.T)[0, 1]
    got = {(r.a, r.b): (r.days, r["corr"]) for r in catalog.QUERIES["f15_correlation_pairs_all"](spark, D).collect()}
    assert len(got) == 300 and got.keys() == want.keys()
    assert all(got[k][0] == n and abs(got[k][1] - c) < 1e-5 for k, (n, c) in want.items())


def test_rolling_correlations_reach_every_symbol(spark):
    got = catalog.QUERIES["w28_rolling_correlations_all"](spark, D).collect()
    assert len({s for r in got for s in (r.a, r.b)}) == 25
    assert {tuple(r) for r in catalog.QUERIES["w28_rolling_correlations"](spark, D).collect()} == {tuple(r) for r in got}
