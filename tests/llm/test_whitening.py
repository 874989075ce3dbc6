"""Whitening against a dense computation, and its edges."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import whitening
from ledgerlark.llm.queries import op11_whitening

D = "/root/testdata/sf0.01"


def dense(v, k=8):
    x = np.floor(1024 * np.stack(v).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [sum(int(e) ** 2 for e in row) for row in n * x - s], c @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_equals_a_dense_computation(spark):
    e = pd.read_parquet(f"{D}/embeddings.parquet").sort_values("vec_id")
    n, deviation, white, share = dense(e.embedding)
    got = op11_whitening(spark, D).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * n and set(got.n) == {n} and got.component.tolist() == list(range(1, 9)) * n
    assert got.deviation.tolist() == np.repeat(deviation, 8).tolist() == [int(x) for x in got.deviation_exact]
    w = got.whitened.to_numpy().reshape(n, 8)
    sign = np.sign((w * white).sum(0))
    np.testing.assert_allclose(w, white * sign, atol=1e-9)
    np.testing.assert_allclose(got.explained.to_numpy().reshape(n, 8)[0], share, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    np.testing.assert_allclose(w.T @ w / n, np.eye(8), atol=1e-9)


def test_rows_left_out(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist(), "x") for i in range(30)]
    bad = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [1.0, float("nan"), 2.0], "x"), (103, [float("inf"), 0.0, 0.0], "x"), (104, [], "x"), (105, [1.0, 2.0], "x")]
    df = spark.createDataFrame(good + bad + [(None, [0.0, 1.0, 2.0], "x"), good[0]], "vec_id long, embedding array<double>, n string").withColumn("component", F.lit("clash"))
    got = whitening.whiten(df).toPandas()
    n, deviation, white, _ = dense([v for _, v, _ in good] + [[0.0, 1.0, 2.0], good[0][1]], 3)
    assert len(got) == 32 * 3 and set(got.n) == {32} and got.vec_id.isna().sum() == 3 and (got.vec_id == 0).sum() == 6
    assert sorted(got.deviation[got.component == 1]) == sorted(map(Decimal, deviation))
    np.testing.assert_allclose(np.sort(np.abs(got.whitened[got.component == 2])), np.sort(np.abs(white[:, 1])), atol=1e-9)


def test_no_components(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and out.columns[0] == "vec_id"
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], kind)).toPandas()
    assert flat.component.tolist() == [1, 1] and sorted(flat.whitened) == pytest.approx([-1, 1])


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e300, 1.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = [[int(1024e12) + 100_000, 100_000], [-int(1024e12) + 100_000, 101_024], [2**62 + 100_000, 101_024]]
    assert model.sums == [sum(r[k] for r in x) for k in range(2)]
    got = {r.vec_id: r.deviation for r in whitening.apply(df, model).collect()}
    want = {i + 1: sum((3 * r[k] - model.sums[k]) ** 2 for k in range(2)) for i, r in enumerate(x)}
    assert got == {i: Decimal(w) if w < 10**38 else None for i, w in want.items()}
    big = np.array([[2**49 + 5, -3, 2**33], [-(2**49), 2**25 - 1, -(2**25)]])
    assert whitening.squares(big) == [sum(int(v) ** 2 for v in row) for row in big]
