from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from repseq.llm import toxicity as T


def test_probabilities_sum_to_one():
    """The ratio's two probabilities are proper: over an alphabet, each class sums to 1 after any history."""
    counts = {g: (3, 1) for w in ("abab", "ba", "bbb") for g in T.grams(w)} | {"^x": (0, 4)}
    shared = T.Shared(set(counts))
    chars = sorted({g[-1] for g in counts})
    spare = shared.kinds[""] + 1
    for h in ("^", "^a", "ab", ""):
        total = sum(shared.prob(h, c) for c in chars)
        assert total <= 1 + 1e-9 and total > 1 - (spare + 2) / (shared.total[""] + spare)


def test_rare_spellings_are_neutral():
    model = T.Model({g: (1000, 100) for w in ("aaaa", "bbbb") for g in T.grams(w)} | {g: (0, 50) for g in T.grams("zork")})
    assert model.word("zork") > 3 > abs(model.word("aaaa"))
    # Where neither class has seen a character, only what each has seen after "^" counts; further on, nothing does.
    assert model.word("qqqq") == pytest.approx(model.unseen["^"])
    total, n, top, few = model.score("zork aaaa")
    assert n == 2 and top == model.word("zork") and total == pytest.approx(model.word("zork") + model.word("aaaa")) and few == pytest.approx(total / 2)
    assert model.score("") == (0.0, 0, 0.0, 0.0)


def test_no_gram_is_left_out(spark):
    """The fitted grams are those of all labelled texts, long words too; a corpus beyond the bound is refused."""
    rows = [(i, f"zork {'mean' * 40} words" if i % 4 == 0 else f"kind words number{i}", int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    want = {g for _, t, _ in rows for w in t.split() for g in T.grams(w)}
    assert set(T.train(df).model.ratio) == want
    with pytest.raises(ValueError, match="grams"):
        T.train(df, most=30)


def test_ratios_are_those_of_kneser_ney():
    """The ratio of a gram from its definition: discounted class counts over a backoff shared by both classes."""
    counts = {"^a": (4, 1), "^ab": (3, 1), "^aba": (2, 0), "abab": (1, 1), "bab$": (1, 1), "^b": (0, 2), "^ba": (0, 2), "^ba$": (0, 2), "aba$": (2, 0)}
    model = T.Model(counts)
    types = {n: {g[-n:] for g in counts if len(g) >= n} for n in (1, 2, 3)}

    def ways(g):  # in how many ways the next longer grams extend g to the left
        longer = {x[-len(g) - 1 :] for x in counts if len(x) > len(g)} if len(g) == 3 else {x[-len(g) - 1 :] for x in counts if len(x) > len(g)}
        return len({x for x in longer if x.endswith(g)})

    def shared(h, c):
        if not h:
            total, kinds = sum(ways(x) for x in types[1]), len([x for x in types[1] if ways(x)])
            return (ways(c) + 1) / (total + kinds + 1)
        after = {x: ways(x) for n in (2, 3) for x in types[n] if len(x) == len(h) + 1 and x[:-1] == h and ways(x)}
        lower = shared(h[1:], c)
        if not after:
            return lower
        return (max(after.get(h + c, 0) - T.DISCOUNT, 0) + T.DISCOUNT * len(after) * lower) / sum(after.values())

    for g, pair in counts.items():
        h = g[:-1]
        p = []
        for k in (0, 1):
            seen = {x: v[k] for x, v in counts.items() if x[:-1] == h and v[k]}
            lower = shared(g[1:-1], g[-1])
            p.append((max(pair[k] - T.DISCOUNT, 0) + T.DISCOUNT * len(seen) * lower) / sum(seen.values()) if seen else lower)
        assert model.ratio[g] == pytest.approx(math.log(p[1] / p[0])), g


def test_edges(spark):
    rows = [(i, "you zork fool" if i % 4 == 0 else f"what a fine day number {i}", int(i % 4 == 0)) for i in range(400)]
    rows += [(900, None, 0), (901, "zork", None), (902, "", 1), (903, "x" * 100_000, 0), (None, "fine", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = T.train(df)
    asked = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "zork fool", "x"), (3, "zork fool", "x"), (4, "a fine day", "x"), (None, "day " * 100_000, "x")], "doc_id long, text string, toxicity string")
    got = {r.doc_id: r.toxicity for r in T.score(asked, scorer).collect()}
    assert got[3] > 0.9 > 0.1 > got[4] and got[1] == got[2] and all(0 <= x <= 1 and math.isfinite(x) for x in got.values())
    assert T.score(asked.limit(0), scorer).count() == 0
    for part, least, most in ((df.limit(0), 0, 0.01), (df.where("toxic = 1"), 0.99, 1), (df.where("toxic = 0"), 0, 0.01)):
        x = T.score(asked, T.train(part)).first().toxicity
        assert least <= x <= most


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = T.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = out[out["held_out"]]
    high, low = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    assert sum((h > low).mean() for h in high) / len(high) > 0.97
    assert held[held["predicted"] == 1]["toxic"].mean() > 0.8
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.6


def test_labels_by_bitmap_and_by_id_agree(spark, monkeypatch):
    ids = [-40_000, -32_768, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 10**12, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(7, "another")], "doc_id long, text string")
    labels = [(i, n % 2) for n, i in enumerate(ids)] + [(0, 0), (0, 1), (8, None), (99, 1), (1, 2), (65_536, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    most, found = {}, []
    for n, toxic in labels.collect():
        if n is not None and toxic is not None:
            most[n] = max(toxic, most.get(n, toxic))
    for limit in (8_192, 0):
        monkeypatch.setattr(T, "MOST_BITMAPS", limit)
        found.append(sorted(map(tuple, T.labelled(docs, labels, F.lit(True)).collect())))
    assert found[0] == found[1] == sorted((i, t, most[i]) for i, t in map(tuple, docs.collect()) if most.get(i) in (0, 1))
    assert T.labelled(docs, labels.limit(0), F.lit(True)).count() == 0
