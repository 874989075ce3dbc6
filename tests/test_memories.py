"""Consolidation against a loop over all pairs in order; ranks by covers against every stretch; volatility windows and tests."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import fulltext, memories, volatility
from ledgerlark.operators.models import fit_garch, garch_filter
from ledgerlark.plans.knowledge import memory_rows

D = "/root/testdata/sf0.001"


def loop(f: pd.DataFrame, threshold: float = 0.85) -> dict:
    out = {}
    f = f.sort_values(["importance_score", "id"], ascending=[False, True])
    rows = [(i, np.asarray(v, float)) for i, v in zip(f["id"], f["embedding"]) if v is not None]
    for a, (i, x) in enumerate(rows):
        if i in out:
            continue
        out[i] = i
        for j, y in rows[a + 1 :]:
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if j not in out and n > 0 and x @ y / n >= threshold:
                out[j] = i
    return out


@pytest.mark.parametrize("block", [16, 2048])
def test_covers_equal_the_loop(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(u), i, v.tolist(), float(w)) for i, (u, v, w) in enumerate(zip(np.minimum(rng.geometric(0.6, 300), 4), rng.normal(size=(300, 5)), rng.integers(0, 20, 300) / 20))]
    df = spark.createDataFrame(rows, "user_id int, id int, embedding array<double>, importance_score double")
    got = {r.id: r.kept_id for r in memories.covers(df.withColumn("block", F.lit("clash")).withColumn("seq", F.lit("clash")), block=block).collect()}
    want = {}
    for _, f in df.toPandas().groupby("user_id"):
        want |= loop(f)
    assert got == want and sum(i != k for i, k in want.items()) > 50


def test_covers_of_documents(spark):
    rows = memory_rows(spark, D)
    got, want = {r.id: r.kept_id for r in memories.covers(rows, block=64).collect()}, {}
    for _, f in rows.toPandas().groupby("user_id"):
        want |= loop(f)
    assert got == want and sum(i != k for i, k in want.items()) > 1


def test_covers_are_not_components(spark):
    # b is like a and c is like b, but c is not like a: c stays
    angle = lambda t: [math.cos(t), math.sin(t)]
    rows = [(1, "a", angle(0.0), 0.9), (1, "b", angle(0.5), 0.8), (1, "c", angle(1.0), 0.7), (1, "z", [0.0, 0.0], 0.6), (1, "n", None, 1.0), (None, "d", angle(0.0), None), (None, "e", angle(0.1), 0.1)]
    df = spark.createDataFrame(rows, "user_id int, id string, embedding array<double>, importance_score double")
    for block in (1, 2, 64):
        assert {r.id: r.kept_id for r in memories.covers(df, block=block).collect()} == {"a": "a", "b": "a", "c": "c", "z": "z", "d": "e", "e": "e"}
    assert memories.covers(df.limit(0)).count() == 0


def test_consolidated(spark):
    one = [1.0, 0.0]
    rows = [(1, "a", one, 0.9, 1, ["x"], {"k": "a", "own": "a"}), (1, "b", one, 0.8, 2, ["y"], {"k": "b"}), (1, "c", one, 0.7, 4, ["z"], {"k": "c"}), (1, "d", [0.0, 1.0], 0.1, 8, None, None), (1, "n", None, 0.1, 9, ["q"], {})]
    df = spark.createDataFrame(rows, "user_id int, id string, embedding array<double>, importance_score double, access_count int, tags array<string>, metadata map<string,string>")
    got = {r.id: (r.access_count, r.tags, r.metadata, r.removed) for r in memories.consolidated(df, memories.covers(df)).collect()}
    assert got == {"a": (7, ["x", "z"], {"own": "a", "k": "c"}, 2), "d": (8, [], None, 0), "n": (9, ["q"], {}, 0)}


def test_copies_share_the_fate_of_the_first(spark):
    # 600 copies of 30 vectors and as many zero vectors: in blocks of 16 it is the first ones that are dealt, and zero vectors stay alone
    rng = np.random.default_rng(7)
    kinds = rng.normal(size=(30, 4)).tolist()
    rows = [(1 if i % 3 else None, i, kinds[i % 30] if i % 7 else [0.0] * 4, float(i * 37 % 11)) for i in range(630)]
    df = spark.createDataFrame(rows, "user_id int, id int, embedding array<double>, importance_score double")
    got = {r.id: (r.kept_id, round(r.similarity, 6)) for r in memories.covers(df, block=16).collect()}
    want = {}
    for _, f in df.toPandas().groupby("user_id", dropna=False):
        want |= loop(f)
    assert {i: k for i, (k, _) in got.items()} == want
    assert {got[i][1] for i in got if rows[i][2] == rows[got[i][0]][2]} == {1.0}


def test_greedy_cover_across_its_blocks():
    x = np.random.default_rng(3).normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = memories.greedy_cover(x, 0.8, 16), memories.greedy_cover(x, 0.8, 1000)
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1]) and len(set(a[0])) < 500


def test_cover_density_equals_every_stretch(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 25))) for _ in range(60)] + [None, "", "A b!C"]
    asked = [(1, "a b"), (2, "c"), (3, "a b c d"), (4, "zz a"), (5, ""), (6, None), (7, "b b a")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = fulltext.positions(df, "id", "text", ["h"])
    got = {(r.q, r.id): (r.score, r.covers) for r in fulltext.cover_density(spark.createDataFrame(asked, "q int, t string"), index, "q", "t", "id", 1000, ["h"]).collect()}
    want = {}
    for q, t in asked:
        terms = set((t or "").split())
        for i, text in enumerate(texts):
            w = [x for x in (text or "").lower().replace("!", " ").split()]
            holds = lambda a, b: terms <= set(w[a:b])  # noqa: E731,B023
            spans = [(a, b) for a, b in itertools.combinations(range(len(w) + 1), 2) if terms and holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
            if spans:
                score = sum(0.1 / (1 + sum(x not in terms for x in w[a:b])) for a, b in spans)
                want[q, i] = (pytest.approx(score, abs=1e-6), len(spans))
    assert got == want and len(want) > 50


def test_rows_are_numbered_and_dealt(spark):
    df = spark.createDataFrame([(k, i) for k in "abc" for i in range(0, 90, 3)] + [(None, 5)], "k string, d int").repartition(7)
    x = volatility.numbered(df, "k", "d")
    assert {(r.k, r.d): r.idx for r in x.collect()} == {**{(k, i): i // 3 for k in "abc" for i in range(0, 90, 3)}, (None, 5): 0}
    got = {(r.block, r.idx) for r in volatility.haloed(x.where("k = 'a'"), 10, 2, 3).collect()}
    assert got == {(b, i) for b in range(4) for i in range(30) if 10 * b - 2 <= i < 10 * b + 13}


def test_rolling_garch_equals_each_window_alone(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(size=150) * np.repeat(rng.uniform(0.5, 2, 15), 10) / 100
    rows = [("a", i, float(x)) for i, x in enumerate(r)] + [("b", i, 0.0) for i in range(70)] + [("c", i, float(x)) for i, x in enumerate(r[:59])] + [("a", 1000, None)]
    got = volatility.rolling_garch(spark.createDataFrame(rows, "symbol string, d int, ret double"), window=60, step=7, together=3).collect()
    assert sorted((x.symbol, x.window) for x in got) == [("a", k) for k in range(13)]
    for x in got:
        w = r[7 * x.window : 7 * x.window + 60]
        assert (x.omega, x.alpha, x.beta) == pytest.approx(fit_garch(w), rel=1e-9) and x.window_end == 7 * x.window + 59
        e = w - w.mean()
        v = garch_filter(e, x.omega, x.alpha, x.beta)[:-1]
        assert x.loglikelihood == pytest.approx(-0.5 * (np.log(2 * np.pi * v) + e * e / v).sum())


def test_chi_square():
    # tabled values at 5 %, 1 %, 0.1 % and 50 %
    for k, x, p in [(1, 3.841458821, 0.05), (1, 6.634896601, 0.01), (5, 11.07049769, 0.05), (10, 18.30703805, 0.05), (10, 29.58829845, 0.001), (20, 31.41043284, 0.05), (20, 37.56623479, 0.01), (3, 2.365973884, 0.5), (100, 99.33412923, 0.5)]:
        assert volatility.chi2_sf(x, k) == pytest.approx(p, abs=1e-9)
    assert volatility.chi2_sf(0, 3) == 1 and volatility.chi2_sf(900, 2) == pytest.approx(math.exp(-450))


@pytest.mark.parametrize("block", [25, 4096])
def test_diagnostics_equal_a_dense_computation(spark, block):
    rng = np.random.default_rng(9)
    series = {"a": rng.normal(size=120) * np.linspace(1, 3, 120), "b": rng.normal(size=33), "c": np.ones(30), "d": rng.normal(size=4)}
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)] + [("a", 500, None)]
    got = {r.portfolio: r for r in volatility.diagnostics(spark.createDataFrame(rows, "portfolio string, d int, z double"), block=block).collect()}
    for k in ("a", "b"):
        z, r = series[k], got[k]
        n, m, a = len(z), min(20, len(z) // 5), min(10, len(z) // 5)
        for x, stat, p in ((z, r.lb_stat, r.lb_pvalue), (z * z, r.lb_sq_stat, r.lb_sq_pvalue)):
            e = x - x.mean()
            want = n * (n + 2) * sum((e[j:] @ e[:-j] / (e @ e)) ** 2 / (n - j) for j in range(1, m + 1))
            assert stat == pytest.approx(want) and p == pytest.approx(volatility.chi2_sf(want, m))
        q = z * z
        y, x = q[a:], np.column_stack([np.ones(n - a), *(q[a - j : n - j] for j in range(1, a + 1))])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert r.lm_stat == pytest.approx((n - a) * (1 - e @ e / ((y - y.mean()) ** 2).sum()), rel=1e-6)
        s = pd.Series(z)
        assert (r.mean, r.std, r.skewness, r.kurtosis) == pytest.approx((s.mean(), s.std(), s.skew(), s.kurt()))
    assert got["c"].lb_stat is None and got["d"].lags == 0 and got["d"].lm_stat is None


def test_index_of_asked_terms_only(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c d"), (3, None)], "id int, t string")
    only = spark.createDataFrame([("a",), ("c",), ("a",)], "term string")
    assert sorted((r.term, r.id, r.positions) for r in fulltext.positions(docs, "id", "t", (), only).collect()) == [("a", 1, [1, 4]), ("c", 1, [3]), ("c", 2, [1])]
