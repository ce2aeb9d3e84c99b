from __future__ import annotations

import math

import numpy as np
import pytest

from repseq.llm import langid as L


def every(word: str, prob: dict[str, float], known: dict | None = None) -> float:
    """Sum over all segmentations; a character without a piece counts as unknown."""
    if not word:
        return 1.0
    known = {} if known is None else known
    if word not in known:
        total = sum(prob[word[:n]] * every(word[n:], prob, known) for n in range(1, min(len(word), 24) + 1) if word[:n] in prob)
        known[word] = total + (0 if word[0] in prob else L.UNKNOWN * every(word[1:], prob, known))
    return known[word]


PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abab"]


@pytest.mark.parametrize("short", [32, 0])
def test_forward_sums_all_segmentations(monkeypatch, short):
    """Both ways to sum: many short words at once, and one long word in blocks."""
    monkeypatch.setattr(L, "SHORT", short)
    lattice = L.Lattice(PIECES)
    prob = np.random.default_rng(0).dirichlet(np.ones(len(PIECES)), 2).T
    words = ["a", "b", "ab", "abab", "ababababba", "axb", "zz", "baab", "abba" * 8]
    got = np.exp(lattice.forward(words, prob))
    for k in range(2):
        table = dict(zip(PIECES, prob[:, k], strict=True))
        assert got[:, k] == pytest.approx([every("▁" + w, table) for w in words], rel=1e-9)


def test_long_words_are_summed_whole(monkeypatch):
    """A word of 20,000 letters, with blocks and chunks of any size, has the sum of the plain recursion in logarithms."""
    lattice = L.Lattice(PIECES)
    prob = np.random.default_rng(1).dirichlet(np.ones(len(PIECES)), 2).T
    word = "abbax" * 4000
    table = [dict(zip(PIECES, prob[:, k], strict=True)) for k in (0, 1)]
    want = []
    for t in table:
        s, low = "▁" + word, [0.0]
        for j in range(1, len(s) + 1):
            terms = [low[i] + math.log(t[s[i:j]]) for i in range(max(0, j - 4), j) if s[i:j] in t] + ([low[j - 1] + math.log(L.UNKNOWN)] if s[j - 1] not in t else [])
            top = max(terms)
            low.append(top + math.log(sum(math.exp(x - top) for x in terms)))
        want.append(low[-1])
    for floats in (2_000_000, 300):
        monkeypatch.setattr(L, "_FLOATS", floats)
        assert lattice.forward([word], prob)[0] == pytest.approx(want, rel=1e-9)


def test_expected_counts(monkeypatch):
    """Of short and long words alike: each piece's count in every segmentation, weighed by the segmentation's share."""
    lattice = L.Lattice(PIECES)
    prob = np.random.default_rng(2).dirichlet(np.ones(len(PIECES)), 2).T
    words, counts = ["ab", "abab", "bax"], np.array([[9.0, 1], [5, 0], [0, 8]])

    def cuts(s):
        if not s:
            yield []
        for n in range(1, len(s) + 1):
            if s[:n] in PIECES or (n == 1):
                yield from ([s[:n], *rest] for rest in cuts(s[n:]))

    want = np.zeros_like(prob)
    for w, c in zip(words, counts, strict=True):
        for k in range(2):
            each = [(x, math.prod(prob[PIECES.index(p), k] if p in PIECES else L.UNKNOWN for p in x)) for x in cuts("▁" + w)]
            for x, p in each:
                for piece in x:
                    if piece in PIECES:
                        want[PIECES.index(piece), k] += c[k] * p / sum(q for _, q in each)
    for short, floats in ((32, 2_000_000), (0, 2_000_000), (0, 40)):
        monkeypatch.setattr(L, "SHORT", short)
        monkeypatch.setattr(L, "_FLOATS", floats)
        assert lattice.expect(words, counts, prob) == pytest.approx(want, rel=1e-9)


def test_sample_is_bounded_and_follows_the_rows(spark):
    df = spark.range(4000).selectExpr("IF(id % 3 = 0, 'b', 'a') AS l", "xxhash64(id) AS h")
    df = df.union(spark.range(3000).selectExpr("'a' AS l", "xxhash64(1L) AS h"))
    got = L.sample_rows(df, "l", "h", 50).toPandas()
    assert got.groupby("l").size().to_dict() == {"a": 50, "b": 50} and not got.duplicated().any()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, L.sample_rows(df.repartition(7), "l", "h", 50).toPandas().to_numpy()))


def _train(spark):
    rows = [(i, t, x) for i in range(40) for t, x in (("the water and the house", "en"), ("das Wasser und der Garten", "de"))]
    df = spark.createDataFrame([(2 * i + (x == "de"), t, x) for i, t, x in rows] + [(900, None, "en"), (901, "hallo Welt", None), (None, "the Wasserhouse", "en")], "doc_id long, text string, lang string")
    return df, L.train(df)


def test_edges(spark):
    df, model = _train(spark)
    asked = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the house", "x"), (4, "the house", "x"), (5, "der Garten " * 20_000, "x"), (None, "WATER" * 3000, None), (7, "水", "x"), (8, "² ½ Ⅷ ①", "x")]
    asked = spark.createDataFrame(asked, "doc_id long, text string, language string")
    got = {r.doc_id: r.language for r in L.identify(asked, model).collect()}
    assert [got[i].lang for i in (1, 2, 3, 4, 5, 8)] == ["und", "und", "und", "en", "de", "und"]
    assert got[1].score == 0 and all(0 <= x.score <= 1 for x in got.values()) and got[7].lang in ("de", "en") and got[None].lang in ("de", "en")
    assert L.identify(asked.limit(0), model).count() == 0
    nothing = L.train(df.limit(0))
    assert {r.language.lang for r in L.identify(asked, nothing).collect()} == {"und"}
    assert L.train(spark.createDataFrame([(1, "12 34", "en")], df.schema)).languages == []


def test_scores_are_sums_over_segmentations(spark):
    """The operator's language and posterior, against a plain recursion over the fitted model's pieces."""
    _, model = _train(spark)
    pieces = L.letter_pieces(model.path)
    tables = [dict(zip(pieces, model.prob[:, k], strict=True)) for k in range(2)]
    texts = ["the garden", "das water", "der Garten und das Haus", "Überwasserhausgartenundwasserhausgartengarten x", "Żółw 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.identify(df, model).collect():
        words = __import__("re").findall(r"[^\W\d_]+", texts[r.doc_id].lower())
        ll = [sum(math.log(every("▁" + w, t)) for w in words) for t in tables]
        best = max(range(2), key=lambda k: ll[k])
        assert r.language.lang == model.languages[best]
        assert r.language.score == pytest.approx(1 / sum(math.exp(x - ll[best]) for x in ll), rel=1e-6)
        assert r.language.fit == pytest.approx(ll[best] / sum(map(len, words)) - model.floor[best], rel=1e-6)


def test_stage(spark, small):
    """Foreign letters go, clean documents stay, columns and repeated rows too; empty tables and unlabelled ones are fine."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 300").withColumn("language", L.F.col("doc_id"))
    extra = spark.createDataFrame([(10_000_000 + i, t, None, None, 0, 0) for i, t in enumerate(["xq zvk wqpt hjkl mnbvx qwz " * 30, None, "", "1 2 3"])], docs.schema)
    kept = L.langid_stage(spark, docs.union(docs.limit(3)).union(extra), small)
    assert kept.columns == docs.columns
    assert kept.where("doc_id >= 10000000").count() == 0 and kept.count() == docs.count() + 3
    assert L.langid_stage(spark, docs.limit(0), small).count() == 0
    assert L.langid_stage(spark, docs.withColumn("lang", L.F.lit(None).cast("string")), small).count() == 0


def test_held_out_accuracy(spark, small):
    out = L.op2_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) and (held["lang_pred"] == held["lang"]).mean() > 0.97
