from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from repseq.llm import mixing as M


def test_rake_meets_margins():
    cells = np.array([[i, j] for i in range(3) for j in range(4)])
    tokens = np.arange(1.0, 13)
    goal = [{0: 0.5, 1: 0.3, 2: 0.2}, {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}]
    w = M.rake(cells, tokens, goal)
    for m in (0, 1):
        assert np.bincount(cells[:, m], w) / w.sum() == pytest.approx(list(goal[m].values()))
    # Raking keeps the odds ratios of the cells.
    a, b = w.reshape(3, 4), tokens.reshape(3, 4)
    assert a[0, 0] * a[1, 1] / (a[0, 1] * a[1, 0]) == pytest.approx(b[0, 0] * b[1, 1] / (b[0, 1] * b[1, 0]))


def _docs(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "ab"[i % 5 % 2], i % 11 * 10, 1) for i in range(600)] + [(700, "s0", "a", None, 1), (None, "s1", "b", 5, 1), (3, "s0", "a", 50, 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long, weight int")


@pytest.mark.parametrize("small", [100_000, 0])
@pytest.mark.parametrize("budget", [None, 0.5])
def test_mix(spark, monkeypatch, small, budget):
    monkeypatch.setattr(M, "SMALL", small)
    df = _docs(spark)
    out = M.mix(df, {"source": 0.5, "lang": {"a": 0.7, "b": 0.3}}, budget=budget).toPandas()
    assert len(out) == df.count() and out["probability"].between(0, 1).all()
    share = out.groupby("lang")["weight"].sum() / out["weight"].sum()
    assert share["a"] == pytest.approx(0.7, abs=1e-6)
    n = df.groupBy("source").agg(F.sum("n_tokens").alias("n")).toPandas().set_index("source")["n"] ** 0.5
    got = out.groupby("source", dropna=False)["weight"].sum()
    assert (got / got.sum()).sort_index().tolist() == pytest.approx((n / n.sum()).sort_index().tolist(), abs=1e-6)
    if budget:
        assert (out["n_tokens"].fillna(0) * out["probability"]).sum() == pytest.approx(budget * out["n_tokens"].sum(), rel=1e-6)
    else:
        assert out["probability"].max() == pytest.approx(1)
    assert 0 < out["sampled"].mean() < 1


def test_one_rule_for_any_number_of_cells(spark, monkeypatch):
    """On margins that settle slowly, both ways stop by the same rule and give the same weights and probabilities."""
    monkeypatch.setattr(M, "TOLERANCE", 1e-4)
    rows = [(0, "a", "x", 1000), (1, "a", "y", 3), (2, "b", "x", 2), (3, "b", "y", 1000), (4, "c", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    targets = {"source": {"a": 0.3, "b": 0.6, "c": 0.1}, "lang": {"x": 0.7, "y": 0.3}}
    monkeypatch.setattr(M, "ROUNDS", 12)
    monkeypatch.setattr(M.rake, "__defaults__", (12, 1e-4))
    monkeypatch.setattr(M._rake_frames, "__defaults__", (12, 1e-4))
    got = []
    for small in (100_000, 0):
        monkeypatch.setattr(M, "SMALL", small)
        got.append(M.mix(df, targets, budget=0.4).orderBy("doc_id").toPandas())
    assert got[0]["weight"].tolist() == pytest.approx(got[1]["weight"].tolist(), rel=1e-9)
    assert got[0]["probability"].tolist() == pytest.approx(got[1]["probability"].tolist(), rel=1e-9)
    assert got[0]["sampled"].tolist() == got[1]["sampled"].tolist()


def test_query_against_plain_raking(spark, small):
    """Weights, probabilities and draws of the whole query against dictionaries and loops."""
    import re
    import zlib

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    n = {r.doc_id: len(word.findall(r.text or "")) for r in docs}
    topic = {r.doc_id: "t%d" % (zlib.crc32((word.search(r.text or "") or [""])[0].lower().encode()) % 8) for r in docs}
    cell = {r.doc_id: (r.source, r.lang, topic[r.doc_id]) for r in docs}
    tokens: dict = {}
    for i, c in cell.items():
        tokens[c] = tokens.get(c, 0) + n[i]
    weight, whole = {c: float(x) for c, x in tokens.items()}, sum(tokens.values())
    for _ in range(500):
        worst = 0.0
        for m in range(3):
            have, now = {}, {}
            for c in tokens:
                have[c[m]] = have.get(c[m], 0) + tokens[c]
                now[c[m]] = now.get(c[m], 0) + weight[c]
            total = sum(x**0.7 for x in have.values() if x)
            goal = {v: whole * x**0.7 / total if x else 0.0 for v, x in have.items()}
            worst = max(worst, *(abs(now[v] - goal[v]) for v in goal))
            weight = {c: w * goal[c[m]] / now[c[m]] if now[c[m]] else 0.0 for c, w in weight.items()}
        if worst <= 1e-10 * whole:
            break
    factor = {c: weight[c] / tokens[c] if tokens[c] else 0.0 for c in tokens}
    top = max(factor.values())
    draw = {r.doc_id: (r.h % 2**64 >> 11) / 2**53 for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    for r in M.op4_mixing(spark, small).collect():
        f = factor[cell[r.doc_id]]
        assert (r.n_tokens, r.topic) == (n[r.doc_id], topic[r.doc_id])
        assert r.weight == pytest.approx(n[r.doc_id] * f, rel=1e-6) and r.probability == pytest.approx(min(1, f / top), rel=1e-6)
        assert r.sampled == (draw[r.doc_id] < r.probability)


def test_edges(spark):
    df = _docs(spark)
    none = M.mix(df, {"lang": {"nowhere": 1.0}})
    assert none.where("sampled OR probability > 0").count() == 0
    assert M.mix(df.limit(0), {"source": 0.5}).count() == 0
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "two words " * 50_000, "en", "s", 9), (3, "two words", "en", "s", 9)], "doc_id long, text string, lang string, source string, _n_tokens int")
    kept = M.mixing_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() <= 4
    assert M.mixing_stage(spark, docs.limit(0), "").count() == 0
    lone = spark.createDataFrame([(None, "s", "a", 1, i) for i in range(200)], "doc_id long, source string, lang string, n_tokens long, other int")
    drawn = M.mix(lone, {"source": 1.0}, budget=0.5).where("sampled").count()
    assert 50 < drawn < 150


def test_query_is_a_function_of_the_rows(spark, small):
    a = M.op4_mixing(spark, small).toPandas().sort_values("doc_id")
    assert a["doc_id"].is_unique and 0.1 < a["sampled"].mean() < 0.95
    tokens = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert a["n_tokens"].tolist() == [tokens[i] for i in a["doc_id"]]
    total = a.groupby("lang")["n_tokens"].sum() ** 0.7
    assert (a.groupby("lang")["weight"].sum() / a["weight"].sum()).tolist() == pytest.approx((total / total.sum()).tolist(), abs=1e-6)
