from __future__ import annotations

import numpy as np
import pytest

from repseq.llm import ann as A


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = x @ x[i]
        order = np.lexsort((np.array(ids), -s))
        out[q] = [ids[j] for j in order if ids[j] != q][:k]
    return out


def test_anisotropic_loss_goes_down():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    books = A.Codebooks(8, threshold=0.6)

    def loss(b, code):
        s, unit = b._split(x), b._split(x) / np.linalg.norm(x, axis=1)[:, None, None]
        off = s - b.centres[np.arange(b.parts), code]
        along = (off * unit).sum((1, 2))
        return (off**2).sum() + (b.eta - 1) * (along**2).sum()

    start, fitted = A.Codebooks(8, threshold=0.6).fit(x, rounds=0), books.fit(x)
    assert books.eta > 1 and loss(fitted, fitted.encode(x)) < loss(start, start.encode(x, sweeps=0))
    near, code = fitted.scan(x[:5], fitted.encode(x)), fitted.encode(x)
    decoded = fitted.centres[np.arange(fitted.parts), code].reshape(len(x), -1)
    assert near == pytest.approx(x[:5] @ decoded.T, abs=1e-4)


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype("float32").astype(float)
    x[100:160] = x[100]  # copies: ties go to the smaller id
    ids = list(range(0, 2100, 3))
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score double")
    out = A.search(df, df.where("vec_id % 20 = 0"), k=20, rows=200, block=10).toPandas().sort_values(["query_id", "rank"])
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = out.groupby("query_id")["vec_id"].apply(list).to_dict()
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95
    assert got[300] == want[300]  # one of the copies
    at = {i: n for n, i in enumerate(ids)}
    assert all(abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12 for r in out.itertuples())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 1.0, 1.0]), (9, [2.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = A.search(df, df, k=20).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0] == [(9, 2.0), (1, 1.0), (1, 1.0)] and set(got) == {0, 1, 9} and got[1] == [(9, 2.0), (0, 1.0)]
    assert A.search(df.limit(0), df.limit(0)).count() == 0 and A.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_recall(spark, small):
    out = A.op10_ann(spark, small).toPandas()
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = out.groupby("query_id")["vec_id"].apply(list).to_dict()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
