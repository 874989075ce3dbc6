"""Strategies are ranked on all six metrics."""

import numpy as np

from ledgerlark import catalog
from ledgerlark.plans import fixtures as X

D = "/root/testdata/sf0.01"


def test_six_metrics(spark):
    want = {}
    for name, f in X.portfolio_returns(spark, D).toPandas().groupby("portfolio"):
        r = f.sort_values("d").ret.astype(float).to_numpy()
        equity = np.cumprod(1 + r)
        fall = (equity / np.maximum.accumulate(equity) - 1).min()
        a, vol, down = r.mean() * 252, r.std(ddof=1) * 252**0.5, r[r < 0].std(ddof=1) * 252**0.5
        want[name] = {"sharpe": a / vol, "annual_return": a, "volatility": -vol, "max_drawdown": fall, "sortino": a / down, "calmar": a / -fall}
    got = {(r.portfolio, r.metric): r["rank"] for r in catalog.QUERIES["o06_strategy_ranking_all"](spark, D).collect()}
    assert got == {(p, m): 1 + sum(x[m] > v for x in want.values()) for p, of in want.items() for m, v in of.items()}
    assert len(got) == 6 * len(want)
