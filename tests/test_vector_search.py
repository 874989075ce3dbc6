"""The search asks for every row whose id is divisible by 100, in any number of blocks."""

import numpy as np
import pandas as pd

from ledgerlark import catalog
from ledgerlark.operators.retrieval import cosine_search

D = "/root/testdata/sf0.01"


def _brute(ids, v, asked, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in asked:
        s = np.round(u @ u[list(ids).index(q)], 9)
        yield from ((q, i) for _, i in sorted((-c, i) for i, c in zip(ids, s) if i != q)[:k])


def test_every_query_of_the_rule(spark):
    e = pd.read_parquet(f"{D}/embeddings.parquet")
    asked = [i for i in e.vec_id if i % 100 == 0]
    got = catalog.QUERIES["o01_vector_search"](spark, D).collect()
    assert {r.query_id for r in got} == set(asked) and len(asked) > 1
    assert {(r.query_id, r.vec_id) for r in got} == set(_brute(e.vec_id, np.stack(e.embedding).astype(float), asked, 10))


def test_blocks_do_not_change_the_rows(spark):
    e = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(40, [0.0] * 3), (41, None)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, cosine_search(e.where("vec_id % 10 = 0"), e, "vec_id", "embedding", 4, b).collect())) for b in (1000, 3))
    assert one == many and len(one) == 16
