"""Toxicity by two class-conditional Kneser-Ney models of spelling that share their backoff."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.llm._common import fold, rows, table
from repseq.session import cut_lineage

#: Runs of letters and digits, of any length.
TOKEN = re.compile(r"[^\W_]+")
ORDER, DISCOUNT = 4, 0.75
#: Grams that fit a model in memory. None are ever left out: a corpus with more is refused, so no result depends on its size.
MOST_GRAMS = 5_000_000
#: Ranges of 32,768 ids whose labels are broadcast as bitmaps; with more of them labels are joined by id, with the same result.
MOST_BITMAPS = 8_192
#: Expected rows that the calibration is fitted on, and the parts of the rows that it keeps apart.
SAMPLE, PARTS = 8_000, 4
#: How many of a text's words with the largest ratios the calibration sees besides the whole text's ratio.
TOP = 3
_FLUSH, _CACHE, _SHORT = 150_000, 300_000, 64


def grams(word: str, order: int = ORDER) -> list[str]:
    """For each character of the marked word, that character with up to ``order`` - 1 before it."""
    s = f"^{word}$"
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


class Shared:
    """Kneser-Ney backoff that both classes share: of each shorter gram, in how many ways a longer one extends it."""

    def __init__(self, all_grams: set[str], order: int = ORDER):
        self.ways: dict[str, int] = defaultdict(int)
        level = all_grams
        for n in range(order - 1, 0, -1):
            left: dict[str, set[str]] = defaultdict(set)
            for g in level:
                if len(g) > n:
                    left[g[-n:]].add(g[: len(g) - n])
            for g, s in left.items():
                self.ways[g] += len(s)
            level = {g[-n:] for g in level}
        self.total: dict[str, int] = defaultdict(int)
        self.kinds: dict[str, int] = defaultdict(int)
        for g, n in self.ways.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.known: dict[str, float] = {}

    def prob(self, history: str, char: str) -> float:
        if not history:
            return (self.ways.get(char, 0) + 1) / (self.total.get("", 0) + self.kinds.get("", 0) + 1)
        key = history + char
        if key not in self.known:
            lower, total = self.prob(history[1:], char), self.total.get(history, 0)
            self.known[key] = (max(self.ways.get(key, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[history] * lower) / total if total else lower
        return self.known[key]


class Model:
    """Log-likelihood ratios (toxic against ordinary) of grams, from gram counts ``{gram: (ordinary, toxic)}``.

    In class k a character x has after the history h the probability
    ``(max(c_k(hx) - D, 0) + D * kinds_k(h) * P(x | shorter h)) / c_k(h)``, where P is shared by both classes. So where
    neither class has seen hx, the ratio depends on h alone, and where neither has seen h it is one: rare spellings
    count only as far as the classes differ in what they have seen.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], order: int = ORDER):
        self.order = order
        shared = Shared(set(counts), order)
        after = [defaultdict(int), defaultdict(int)]
        kinds = [defaultdict(int), defaultdict(int)]
        for g, pair in counts.items():
            for k in (0, 1):
                if pair[k]:
                    after[k][g[:-1]] += pair[k]
                    kinds[k][g[:-1]] += 1
        self.unseen: dict[str, float] = {}
        for h in after[0].keys() | after[1].keys():
            w = [DISCOUNT * kinds[k][h] / after[k][h] if h in after[k] else 1.0 for k in (0, 1)]
            self.unseen[h] = math.log(w[1] / w[0])
        self.ratio: dict[str, float] = {}
        for g, pair in counts.items():
            h, lower = g[:-1], shared.prob(g[1:-1], g[-1])
            p = [(max(pair[k] - DISCOUNT, 0) + DISCOUNT * kinds[k][h] * lower) / after[k][h] if h in after[k] else lower for k in (0, 1)]
            self.ratio[g] = math.log(p[1] / p[0])
        self.words: dict[str, float] = {}

    def __getstate__(self):
        return self.order, self.unseen, self.ratio

    def __setstate__(self, state):
        self.order, self.unseen, self.ratio = state
        self.words = {}

    def word(self, w: str) -> float:
        if len(self.words) > _CACHE:
            self.words.clear()
        ratio, unseen = self.ratio, self.unseen
        x = sum(ratio[g] if g in ratio else unseen.get(g[:-1], 0.0) for g in grams(w, self.order))
        if len(w) <= _SHORT:
            self.words[w] = x
        return x

    def score(self, text: str) -> tuple[float, int, float, float]:
        """The text's log-likelihood ratio, its number of tokens, the largest ratio of a word and the mean of the ``TOP`` largest."""
        tokens, known = TOKEN.findall(text.lower()), self.words
        if not tokens:
            return 0.0, 0, 0.0, 0.0
        each = [known[w] if w in known else self.word(w) for w in tokens]
        top = nlargest(TOP, each)
        return sum(each), len(tokens), top[0], sum(top) / len(top)


def features(raw: np.ndarray) -> np.ndarray:
    """Length-normalised ratios, the length, and the ratios of the words that stand out; ``raw`` as by Model.score."""
    n = raw[:, 1] + 1.0
    return np.column_stack([raw[:, 0] / n, raw[:, 0] / np.sqrt(n), np.log(n), raw[:, 2], raw[:, 3], np.ones(len(n))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on standardised features, for the features as they are."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[-1] = math.log(rate / (1 - rate))
    base, keep = w.copy(), np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * (w - base))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


class Scorer:
    def __init__(self, model: Model, weights: np.ndarray):
        self.model, self.weights = model, weights

    def __call__(self, texts) -> list[float]:
        raw = np.array([self.model.score(t or "") for t in texts], float).reshape(-1, 4)
        return (1 / (1 + np.exp(-np.clip(features(raw) @ self.weights, -30, 30)))).tolist()


_COUNTS = [f"c{i}" for i in range(2 * PARTS)]


def _gram_counts(batches):
    """Partial gram counts of a partition: columns 2 * part + class."""
    words, letters, total = Counter(), 0, defaultdict(lambda: [0] * (2 * PARTS))

    def spell():
        for (w, c), n in words.items():
            for g in grams(w):
                total[g][c] += n
        words.clear()

    for b in batches:
        for text, c in rows(b, "t", "c"):
            words.update((w, c) for w in TOKEN.findall(text.lower()))
            letters += len(text)
            if len(words) > _FLUSH or letters > 64 * _FLUSH:
                spell()
                letters = 0
    spell()
    out = list(total.items())
    for i in range(0, len(out), 50_000):
        part = out[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in part]), *(pa.array([n[c] for _, n in part]) for c in range(2 * PARTS))], ["g", *_COUNTS])


def train(df: DataFrame, *, text: str = "text", toxic: str = "toxic", key: str = "doc_id", sample: int = SAMPLE, most: int = MOST_GRAMS) -> Scorer:
    """Fits the two models on every labelled row (label 1 toxic, 0 ordinary; others teach nothing), then a calibration.

    Gram counts cover all rows and are kept for ``PARTS`` parts of them (by a hash of ``key``). For the calibration each
    part of a sample of ``sample`` rows is scored by a model of the other parts, so no row is judged by counts it is in;
    the final model uses all parts. Without rows of both classes every score is the share of toxic rows (0 without rows).
    """
    df = df.where(F.col(toxic).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(toxic).cast("int").alias("y"), F.xxhash64(F.lit(5), F.col(key)).alias("h"))
    df = df.withColumn("part", F.pmod(F.shiftrightunsigned("h", 32), F.lit(PARTS)).cast("int"))
    cells = df.select("t", (2 * F.col("part") + F.col("y")).alias("c"))
    found = cells.mapInArrow(_gram_counts, ", ".join(["g string", *(f"{c} long" for c in _COUNTS)]))
    found = found.groupBy("g").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    found = cut_lineage(found)
    if found.count() > most:
        raise ValueError(f"the corpus has more than {most} grams; raise `most` with the driver's and the workers' memory")
    t = found.toArrow()
    names, count = t["g"].to_pylist(), np.column_stack([t[c].to_numpy() for c in _COUNTS]).reshape(-1, PARTS, 2)

    def fitted(parts: list[int]) -> Model:
        return Model({g: (x, y) for g, (x, y) in zip(names, count[:, parts].sum(axis=1).tolist(), strict=True) if x or y})

    model = fitted(list(range(PARTS)))
    seen = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    if len(seen) < 2:
        weights = np.zeros(6)
        weights[-1] = 30.0 if seen.get(1) else -30.0
        return Scorer(model, weights)
    share = min(1.0, sample / sum(seen.values()))
    others = [fitted([q for q in range(PARTS) if q != p]) for p in range(PARTS)]
    shared = df.sparkSession.sparkContext.broadcast(others)

    @F.pandas_udf("struct<s: double, n: double, top: double, few: double>")
    def judged(texts: pd.Series, part: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value[p].score(t) for t, p in zip(texts, part, strict=True)], columns=["s", "n", "top", "few"], dtype="float64")

    chosen = df.where(F.pmod(F.xxhash64(F.lit(6), "h"), F.lit(1_000_000)) < share * 1_000_000)
    p = chosen.select("y", judged("t", "part").alias("j")).select("y", "j.*").toPandas()
    return Scorer(model, fit_logistic(features(p[["s", "n", "top", "few"]].to_numpy(float)), p["y"].to_numpy(float)))


def score(df: DataFrame, scorer: Scorer, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the double column ``out`` (0 to 1, higher: likelier toxic); only the text is looked at, NULL counts as empty.

    Rows are not moved. A column named like ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value(texts), dtype="float64")

    return df.drop(out).withColumn(out, judge(F.col(text)))


def labelled(docs: DataFrame, labels: DataFrame, where: Column) -> DataFrame:
    """The rows of ``docs`` that ``where`` picks, with their label 0 or 1; of several labels of one document the largest holds.

    Labels of integer ids become two bitmaps for each 32,768 ids. Up to ``MOST_BITMAPS`` such ranges are broadcast (8 KB
    each, 64 MB at most, counted first), and no text is moved. More ranges, or ids of another type, are joined by id.
    Rows with a NULL id have no label.
    """
    docs = docs.select("doc_id", "text").where(where)
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    whole = ("tinyint", "smallint", "int", "bigint")
    if any(d.schema["doc_id"].dataType.simpleString() not in whole for d in (docs, labels)):
        return docs.join(one, "doc_id")
    bucket, place = F.bitmap_bucket_number(F.col("doc_id").cast("long")), F.bitmap_bit_position(F.col("doc_id").cast("long"))
    ranges = one.groupBy(bucket.alias("bucket")).agg(*(F.bitmap_construct_agg(F.when(F.col("toxic") == k, place)).alias(f"is{k}") for k in (0, 1)))
    ranges = cut_lineage(ranges)
    if ranges.count() > MOST_BITMAPS:
        return docs.join(one, "doc_id")

    def has(bits: str) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), F.col("place") % 8).cast("int")) != 0

    found = docs.withColumns({"bucket": bucket, "place": place}).join(F.broadcast(ranges), "bucket")
    return found.withColumn("toxic", F.when(has("is1"), 1).when(has("is0"), 0)).where("toxic IS NOT NULL").select("doc_id", "text", "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of three folds of four."""
    docs = table(spark, sf_dir, "documents")
    scorer = train(labelled(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2))
    found = score(docs.select("doc_id", "text"), scorer, out="score")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
