"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.llm._common import spare, table
from repseq.session import cut_lineage

#: Up to so many cells the fitting runs on the driver (and the factors are broadcast); beyond, on DataFrames.
SMALL = 100_000
Target = float | Mapping[str | None, float]


def _name(value: Column) -> Column:
    """A text that tells NULL from any value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _shares(total: dict[str, float], target: Target) -> dict[str, float]:
    """Target shares of the values that have tokens: a given share, or the observed one to a power."""
    have = {v: n for v, n in total.items() if n > 0}
    if isinstance(target, Mapping):
        named = {"" if v is None else f"={v}": float(x) for v, x in target.items()}
        want = {v: max(0.0, named.get(v, 0.0)) for v in have}
    else:
        want = {v: n**target for v, n in have.items()}
    whole = sum(want.values())
    return {v: x / whole for v, x in want.items()} if whole else {}


#: A margin of so many values at most is broadcast to the cells.
VALUES = 100_000
#: Fitting ends when no margin is off by more than this share of the whole, or after so many rounds; the same for any number of cells.
TOLERANCE, ROUNDS = 1e-10, 500


def rake(cells: np.ndarray, tokens: np.ndarray, targets: Sequence[dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells (rows of value numbers, one column a margin) whose margins are ``targets`` times all tokens.

    Each round scales the weights to every margin in turn; cells without tokens stay 0. It ends when no margin is off by
    more than ``tolerance`` of the whole, or after ``rounds`` (margins that contradict each other cannot be met all).
    """
    weight, whole = tokens.astype(float).copy(), float(tokens.sum())
    goal = [np.array([t.get(i, 0.0) for i in range(int(cells[:, m].max()) + 1)]) * whole for m, t in enumerate(targets)]
    for _ in range(rounds):
        worst = 0.0
        for m, g in enumerate(goal):
            now = np.bincount(cells[:, m], weight, len(g))
            worst = max(worst, float(np.abs(now - g).max()))
            weight *= np.divide(g, now, out=np.zeros_like(g), where=now > 0)[cells[:, m]]
        if worst <= tolerance * whole:
            break
    return weight


def _rake_frames(cells: DataFrame, margins: list[str], shares: list[DataFrame], whole: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same fitting, with the same rule to end, where the cells are many.

    Each margin's values keep one factor; a margin's sums are aggregated over the cells, with the other margins' factors joined.
    """
    values = {m: cut_lineage(cells.select(m).distinct().join(s.select(m, "share"), m, "left").select(m, (F.coalesce("share", F.lit(0.0)) * whole).alias("goal"), F.lit(1.0).alias("a"))) for m, s in zip(margins, shares, strict=True)}
    few = {m: v.count() <= VALUES for m, v in values.items()}

    def weighed(skip: str | None = None) -> DataFrame:
        """The cells with their tokens times the factors of the margins but ``skip``."""
        work = cells.withColumn("w", F.col("tokens").cast("double"))
        for m in margins:
            if m != skip:
                one = values[m].select(m, F.col("a").alias("one"))
                work = work.join(F.broadcast(one) if few[m] else one, m).withColumn("w", F.col("w") * F.col("one")).drop("one")
        return work

    for _ in range(rounds):
        worst = 0.0
        for m in margins:
            rest = weighed(skip=m).groupBy(m).agg(F.sum("w").alias("rest"))
            now = cut_lineage(values[m].join(rest, m).select(m, "goal", (F.col("a") * F.col("rest")).alias("now"), F.when(F.col("a") * F.col("rest") > 0, F.col("goal") / F.col("rest")).otherwise(0.0).alias("a")))
            worst = max(worst, now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
            values[m] = now.select(m, "goal", "a")
        if worst <= tolerance * whole:
            break
    return weighed().withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)).select(*margins, "factor")


def _scale(kept: Callable[[float], float], want: float | None, top: float, least: float) -> float:
    """The multiplier c with which min(1, c * factor) keeps ``want`` tokens; without one, the largest that needs no cut at 1.

    ``kept`` gives the tokens that a multiplier keeps, ``top`` and ``least`` are the largest and the least positive factor.
    """
    if want is None or not top:
        return 1 / top if top else 0.0
    low, high = 0.0, 1 / least
    while high - low > 1e-12 * high:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if kept(mid) < want else (low, mid)
    return high


def mix(
    df: DataFrame, targets: Mapping[str, Target], *, tokens: str = "n_tokens", key: str = "doc_id", budget: float | None = None, seed: int = 42, weight: str = "weight", probability: str = "probability", sampled: str = "sampled"
) -> DataFrame:
    """Adds each row's ``weight`` (its raked tokens), ``probability`` and ``sampled`` (whether the draw keeps it).

    ``targets`` maps columns to what their values' token shares shall be: shares by value, or a power of the observed
    shares (1 keeps them, 0 makes values equal). Iterative proportional fitting finds one factor per cell of those columns
    whose weighted tokens meet all margins; rows are drawn with a probability proportional to their cell's factor,
    decided by a seeded hash of ``key``: so expected token shares are the targets, and a row's fate depends on no other
    row's place. Without ``budget`` the likeliest cell is kept whole; with one, ``budget`` of all tokens is kept, and
    probabilities are cut at 1 (the margins are then met as far as whole documents allow).

    NULL is a value of its own; values that a target does not name get share 0; NULL token counts are 0. Rows with equal
    keys share a draw; a row with a NULL key draws by its other columns. An empty table stays empty. Columns named like a result are replaced.

    Two passes and no shuffle of rows: token sums per cell are aggregated, and factors come back by a join with the
    cells, broadcast only if they are ``SMALL`` at most.
    """
    df = df.drop(weight, probability, sampled)
    margins = spare(df, *(f"_m{i}" for i in range(len(targets))))
    (factor_name,) = spare(df, "_factor")
    n = F.coalesce(F.col(tokens), F.lit(0))
    marked = df.withColumns({m: _name(F.col(c)) for m, c in zip(margins, targets, strict=True)})
    cells = cut_lineage(marked.groupBy(*margins).agg(F.sum(n).cast("double").alias("tokens")))
    if cells.count() <= SMALL:
        t = cells.toPandas()
        have, number, shares = t["tokens"].to_numpy(float), [], []
        for m, target in zip(margins, targets.values(), strict=True):
            values = sorted(set(t[m]))
            place = {v: i for i, v in enumerate(values)}
            number.append(t[m].map(place).to_numpy(int))
            want = _shares(t.groupby(m)["tokens"].sum().to_dict(), target)
            shares.append({place[v]: x for v, x in want.items()})
        w = rake(np.column_stack(number), have, shares) if len(t) else have
        factor = np.divide(w, have, out=np.zeros_like(have), where=have > 0)
        t["factor"] = factor
        goal = None if budget is None else budget * have.sum()
        c = _scale(lambda x: (have * np.minimum(1, x * factor)).sum(), goal, factor.max(initial=0.0), factor[factor > 0].min(initial=np.inf))
        factors = F.broadcast(df.sparkSession.createDataFrame(t[[*margins, "factor"]], ", ".join([*(f"{m} string" for m in margins), "factor double"])))
    else:
        shares = []
        for m, target in zip(margins, targets.values(), strict=True):
            s = cells.groupBy(m).agg(F.sum("tokens").alias("n")).where("n > 0")
            if isinstance(target, Mapping):
                given = [("" if v is None else f"={v}", max(0.0, float(x))) for v, x in target.items()]
                s = s.join(df.sparkSession.createDataFrame(given, f"{m} string, x double"), m)
            else:
                s = s.withColumn("x", F.pow("n", F.lit(float(target))))
            shares.append(cut_lineage(s.withColumn("share", F.col("x") / s.agg(F.sum("x")).first()[0])))
        whole = cells.agg(F.sum("tokens")).first()[0] or 0.0
        factors = cut_lineage(_rake_frames(cells, margins, shares, whole))
        both = cut_lineage(factors.join(cells, margins))
        top, least = factors.agg(F.max("factor"), F.min(F.when(F.col("factor") > 0, F.col("factor")))).first()
        kept = lambda x: both.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * x))).first()[0]
        c = _scale(kept, None if budget is None else budget * whole, top or 0.0, least or np.inf)
    out = marked.join(factors.withColumnRenamed("factor", factor_name), margins, "left")
    factor = F.coalesce(F.col(factor_name), F.lit(0.0))
    rest = [F.col(x) for x in df.columns if x != key and df.schema[x].dataType.typeName() not in ("map", "variant")]
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(seed), F.col(key))).otherwise(F.xxhash64(F.lit(seed), *rest))
    draw = F.shiftrightunsigned(hashed, 11) / float(1 << 53)
    out = out.withColumns({weight: n * factor, probability: F.least(F.lit(1.0), factor * c)})
    return out.withColumn(sampled, draw < F.col(probability)).drop(*margins, factor_name)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def first_word_topic(text: str = "text", topics: int = 8) -> Column:
    """A stand-in topic for tables without one: a hash class of the text's first word."""
    word = F.lower(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", 0))
    return F.concat(F.lit("t"), (F.crc32(word) % topics).cast("string"))


#: Token shares: what each source, language and topic has, to the power 0.7, so that small ones gain.
TARGETS: dict[str, Target] = {"source": 0.7, "lang": 0.7, "topic": 0.7}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, sampling probability and draw of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", n_words().alias("n_tokens"), first_word_topic().alias("topic"))
    return mix(docs, TARGETS).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, budget: float = 0.9) -> DataFrame:
    """Pipeline stage: the documents that the draw keeps, nine tenths of the tokens, with their columns unchanged.

    NULL source or language is a value of its own; NULL and empty texts have no tokens and share the topic of the empty
    word; rows with equal ids share a draw; no rows give no rows; columns named like a result are not touched.
    """
    count, topic, weight, chance, drawn = spare(docs, "n_tokens", "topic", "weight", "probability", "sampled")
    marked = docs.withColumns({count: n_words(), topic: first_word_topic()})
    targets = {"source": TARGETS["source"], "lang": TARGETS["lang"], topic: TARGETS["topic"]}
    found = mix(marked, targets, tokens=count, budget=budget, weight=weight, probability=chance, sampled=drawn)
    return found.where(F.col(drawn)).select(*docs.columns)
