"""Clonal diversity: coverage, unseen species, Hill numbers, bootstrapped abundance and diversity, and tests."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.operators.clones import count_clones
from repseq.operators.usage import _list, _over
from repseq.session import cut_lineage

#: Parts that a group's clones are dealt into for resampling, so that no task holds a whole group.
PARTS = 32


# Closed forms ----------------------------------------------------------------------------------------------------------
def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by 8."""
    y, shift = x + 8, F.lit(1.0)
    for i in range(8):
        shift = shift * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1)


def _exact(x: Column) -> Column:
    """Numbers up to 1, or sums of them, as decimals: their sums do not depend on the order of rows, as sums of doubles do."""
    return x.cast("decimal(38,28)")


def _when(x: str, count: int) -> Column:
    return F.sum(F.when(F.col(x) == count, F.lit(1.0)).otherwise(0.0))


def _chao1(n: Column, f1: Column, f2: Column) -> Column:
    with_pairs = 1 - (f1 / n) * ((n - 1) * f1 / ((n - 1) * f1 + 2 * f2))
    without = 1 - (f1 / n) * ((n - 1) * (f1 - 1) / ((n - 1) * (f1 - 1) + 2))
    return F.when((f2 > 0), with_pairs).otherwise(F.when(f1 == 0, 1.0).otherwise(without))


def _unseen(n: Column, f1: Column, f2: Column) -> Column:
    return F.when(f2 > 0, F.ceil((n - 1) * f1 * f1 / (2 * n * f2))).otherwise(F.ceil((n - 1) * f1 * (f1 - 1) / (2 * n))).cast("long")


def coverage(counts: DataFrame, x: str, groups: str | Sequence[str] = (), *, r: int = 1) -> DataFrame:
    """``(groups, coverage)``: the share of the population that the sample covers, of order ``r``.

    Orders above 1 need clones with ``r`` and with ``r + 1`` counts and raise an error without.
    """
    groups, seen = _list(groups), counts.where(F.col(x) >= 1)
    if r == 1:
        base = seen.groupBy(*groups).agg(F.sum(x).cast("double").alias("n"), _when(x, 1).alias("f1"), _when(x, 2).alias("f2"))
        return base.select(*groups, _chao1(F.col("n"), F.col("f1"), F.col("f2")).alias("coverage"))
    power = F.sum(F.when(F.col(x) >= r, F.pow(F.col(x).cast("double"), F.lit(float(r)))))
    base = seen.groupBy(*groups).agg(F.sum(x).cast("double").alias("n"), _when(x, r).alias("fr"), _when(x, r + 1).alias("fs"), power.alias("power"))
    fr, rest = F.col("fr"), (F.col("n") - r) * F.col("fr")
    value = 1 - (math.factorial(r) * fr / F.col("power")) * F.pow(rest / (rest + (r + 1) * F.col("fs")), F.lit(float(r)))
    bad = F.raise_error(F.lit(f"Cannot calculate coverage of order {r}: no clones with count {r} or {r + 1}.")).cast("double")
    return base.select(*groups, F.when((fr == 0) | (F.col("fs") == 0), bad).otherwise(value).alias("coverage"))


def unseen_count(counts: DataFrame, x: str, groups: str | Sequence[str] = ()) -> DataFrame:
    """``(groups, unseen)``: the Chao1 estimate of how many clones the sample missed."""
    groups = _list(groups)
    base = counts.where(F.col(x) >= 1).groupBy(*groups).agg(F.sum(x).cast("double").alias("n"), _when(x, 1).alias("f1"), _when(x, 2).alias("f2"))
    return base.select(*groups, _unseen(F.col("n"), F.col("f1"), F.col("f2")).alias("unseen"))


def adjusted_abundance(counts: DataFrame, clone: str, x: str, groups: str | Sequence[str] = ()) -> DataFrame:
    """``(groups, clone, p)``: relative abundances of the seen clones, lowered by what the unseen ones take."""
    groups, seen = _list(groups), counts.where(F.col(x) >= 1)
    c, w = F.col(x).cast("double"), _over(groups)
    n, f1, f2 = F.sum(c).over(w), _when(x, 1).over(w), _when(x, 2).over(w)
    base = seen.select(*groups, clone, c.alias("x"), n.alias("n"), f1.alias("f1"), f2.alias("f2"))
    weight = F.sum(_exact(F.col("x") / F.col("n") * F.exp(-F.col("x")))).over(w).cast("double")  # 0 only without clones of one count
    base = base.withColumn("_lambda", F.coalesce(F.try_divide(1 - _chao1(F.col("n"), F.col("f1"), F.col("f2")), weight), F.lit(0.0)))
    return base.select(*groups, clone, (F.col("x") / F.col("n") * (1 - F.col("_lambda") * F.exp(-F.col("x")))).alias("p"))


def unseen_abundance(counts: DataFrame, x: str, groups: str | Sequence[str] = (), *, clone: str = "clone_id") -> DataFrame:
    """``(groups, clone, p)``: the unseen clones ``U1`` to ``Uk``, which share what the coverage leaves equally."""
    groups = _list(groups)
    base = counts.where(F.col(x) >= 1).groupBy(*groups).agg(F.sum(x).cast("double").alias("n"), _when(x, 1).alias("f1"), _when(x, 2).alias("f2"))
    n, f1, f2 = F.col("n"), F.col("f1"), F.col("f2")
    base = base.select(*groups, _unseen(n, f1, f2).alias("k"), _chao1(n, f1, f2).alias("c")).where("k > 0")
    rows = base.select(*groups, F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("i"), ((1 - F.col("c")) / F.col("k")).alias("p"))
    return rows.select(*groups, F.concat(F.lit("U"), F.col("i").cast("string")).alias(clone), "p")


def complete_abundance(counts: DataFrame, clone: str, x: str, groups: str | Sequence[str] = ()) -> DataFrame:
    """``(groups, clone, p)`` of seen and unseen clones; sums to 1 in each group."""
    seen = adjusted_abundance(counts, clone, x, groups).withColumn(clone, F.col(clone).cast("string"))
    return seen.unionByName(unseen_abundance(counts, x, groups, clone=clone))


def _order(q: float) -> float:
    return 0.9999 if q == 1 else float(q)


def diversity(abundance: DataFrame, p: str, q: Sequence[float], groups: str | Sequence[str] = ()) -> DataFrame:
    """``(groups, q, d)``: Hill numbers of abundances (counts or shares); order 1 is taken at 0.9999. One pass for all orders.

    Works on the table of distinct abundances and on their ratios to the largest, which cancels, so that sums are exact and
    the same rows in any order give the same numbers.
    """
    groups, some = _list(groups), abundance.where(F.col(p) > 0)
    table = some.groupBy(*groups, F.col(p).cast("double").alias("_v")).agg(F.count("*").cast("double").alias("_n"))
    table = table.withColumn("_v", F.col("_v") / F.max("_v").over(_over(groups)))

    def total(order: float) -> Column:
        each = F.col("_n") * F.pow(F.col("_v"), F.lit(order))
        return F.sum(_exact(each)).cast("double") if order >= 0 else F.sum(each)

    sums = table.groupBy(*groups).agg(total(1.0).alias("_s"), *(total(_order(x)).alias(f"_q{i}") for i, x in enumerate(q)))
    each = [F.struct(F.lit(float(x)).alias("q"), F.pow(F.col(f"_q{i}") / F.pow(F.col("_s"), F.lit(_order(x))), F.lit(1 / (1 - _order(x)))).alias("d")) for i, x in enumerate(q)]
    return sums.select(*groups, F.inline(F.array(*each)))


def rarefied_coverage(counts: DataFrame, x: str, m: int, groups: str | Sequence[str] = ()) -> DataFrame:
    """``(groups, coverage)`` that a sample of ``m`` of the sequences would have; raises where ``m`` is more than all."""
    groups, seen = _list(groups), counts.where(F.col(x) >= 1)
    base = seen.select(*groups, F.col(x).cast("double").alias("x"), F.sum(F.col(x).cast("double")).over(_over(groups)).alias("n"), _when(x, 1).over(_over(groups)).alias("f1"), _when(x, 2).over(_over(groups)).alias("f2"))
    n, y = F.col("n"), F.col("x")
    term = y / n * F.exp(ln_gamma(n - y + 1) - ln_gamma(n - m - y + 1) - ln_gamma(n) + ln_gamma(n - m))
    lost = base.groupBy(*groups).agg(F.first("n").alias("n"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.sum(F.when((n - y >= m) & (n > m), term).otherwise(0.0)).alias("lost"))
    bad = F.raise_error(F.lit("m must be at most the number of sequences.")).cast("double")
    value = F.when(n < m, bad).when(n == m, _chao1(n, F.col("f1"), F.col("f2"))).otherwise(1 - F.col("lost"))
    return lost.select(*groups, value.alias("coverage"))


def rarefied_diversity(counts: DataFrame, x: str, q: Sequence[float], m: int, groups: str | Sequence[str] = ()) -> DataFrame:
    """``(groups, q, d)``: Hill numbers expected in a sample of ``m`` sequences, from clones of at most ``m``.

    Works on the table of abundances (how many clones have x sequences), not on the clones.
    """
    groups, seen = _list(groups), counts.where(F.col(x) >= 1)
    table = seen.groupBy(*groups, F.col(x).cast("long").alias("x")).agg(F.count("*").alias("f"))
    table = table.withColumn("n", F.sum(F.col("x") * F.col("f")).over(_over(groups))).where(F.col("x") <= m)
    rows = table.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x"))))
    n, i, k = (F.col(c).cast("double") for c in ("n", "x", "k"))
    bad = F.raise_error(F.lit("m must be at most the number of sequences.")).cast("double")
    possible = (n - i) >= (m - k)
    ways = F.when(n < m, bad).when(possible, F.exp(ln_choose(i, k) + ln_choose(F.when(possible, n - i).otherwise(n), m - k) - ln_choose(n, F.lit(float(m)))) * F.col("f")).otherwise(0.0)
    expected = rows.groupBy(*groups, "k").agg(F.sum(ways).alias("fk"))
    sums = expected.groupBy(*groups).agg(*(F.sum(F.pow(F.col("k") / float(m), F.lit(_order(v))) * F.col("fk")).alias(f"_q{j}") for j, v in enumerate(q)))
    each = [F.struct(F.lit(float(v)).alias("q"), F.pow(F.col(f"_q{j}"), F.lit(1 / (1 - _order(v)))).alias("d")) for j, v in enumerate(q)]
    return sums.select(*groups, F.inline(F.array(*each)))


# Resampling ------------------------------------------------------------------------------------------------------------
@dataclass
class AbundanceCurve:
    """Bootstrapped clonal abundance: ``abundance`` (group, clone, p, p_sd, lower, upper, rank), ``bootstrap`` (group, clone, boot)."""

    abundance: DataFrame
    bootstrap: DataFrame
    group: str
    clone: str
    nboot: int
    ci: float


@dataclass
class DiversityCurve:
    """``diversity`` (group, q, d, d_sd, d_lower, d_upper, e, e_lower, e_upper), ``tests`` (test, q, delta_mean, delta_sd, pvalue) or None, ``iterations`` (group, iter, q, d)."""

    diversity: DataFrame
    tests: DataFrame | None
    iterations: DataFrame
    group: str
    ci: float


def _seed(seed: int, *names: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(names).encode(), seed)


def bootstrap_abundance(complete: DataFrame, sizes: DataFrame, group: str, clone: str, *, nboot: int = 200, seed: int = 42, parts: int = PARTS) -> DataFrame:
    """``(group, clone, boot)``: ``nboot`` multinomial draws of ``sizes (group, nsam)`` sequences, as shares of them.

    A group's draws are dealt in two exact steps: first how many sequences fall into each of ``parts`` parts of its clones,
    then, given those totals, which clones of the part they are. So a group of any size is drawn by many tasks.
    Draws depend on ``seed``, the group and the part only.
    """
    kind = complete.schema[group].dataType.simpleString()
    dealt = complete.withColumn("_part", F.pmod(F.xxhash64(clone), F.lit(parts)).cast("int"))
    shares = dealt.groupBy(group, "_part").agg(F.sum(_exact(F.col("p"))).cast("double").alias("p")).join(sizes, group)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        p = pdf["p"].to_numpy(float)
        rng = np.random.default_rng(_seed(seed, "parts", pdf[group].iloc[0]))
        drawn = rng.multinomial(int(pdf["nsam"].iloc[0]), p / p.sum(), size=nboot)
        return pd.DataFrame({group: pdf[group], "_part": pdf["_part"], "_drawn": list(drawn.T), "nsam": pdf["nsam"]})

    drawn = shares.groupBy(group).applyInPandas(totals, f"{group} {kind}, _part int, _drawn array<long>, nsam long")

    def clones(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({group: [], clone: [], "boot": []})
        left = left.sort_values(clone)
        p = left["p"].to_numpy(float)
        rng = np.random.default_rng(_seed(seed, "clones", *key))
        got = rng.multinomial(np.asarray(right["_drawn"].iloc[0], np.int64), p / p.sum())
        return pd.DataFrame({group: left[group], clone: left[clone], "boot": list(got.T / float(right["nsam"].iloc[0]))})

    keep = dealt.select(group, clone, "p", "_part")
    return keep.groupBy(group, "_part").cogroup(drawn.groupBy(group, "_part")).applyInPandas(clones, f"{group} {kind}, {clone} string, boot array<double>")


def estimate_abundance(
    data: DataFrame, *, clone: str = "clone_id", copy: str | None = None, group: str | None = None, min_n: int = 30, max_n: int | None = None, uniform: bool = True, ci: float = 0.95, nboot: int = 200, cell_id: str | None = "cell_id", seed: int = 42
) -> AbundanceCurve:
    """Bootstrapped relative abundance of each clone, of the seen and the inferred unseen ones.

    Groups with fewer than ``min_n`` sequences are left out with a warning; with ``uniform`` all groups are resampled to the
    size of the smallest (``max_n`` at most). Without ``group`` there is one group, ``All``, in the column ``group``.
    """
    if group is None:
        data, group = data.withColumn("group", F.lit("All")), "group"
    counts = count_clones(data.where(F.col(group).isNotNull()), group, copy=copy, clone=clone, cell_id=cell_id)
    x = "copy_count" if copy else "seq_count"
    counts = counts.select(group, F.col(clone).cast("string").alias(clone), F.col(x).cast("long").alias("x"))
    totals = counts.groupBy(group).agg(F.sum("x").alias("n"))
    small = [r[0] for r in totals.where(F.col("n") < min_n).select(group).collect()]
    if small:
        warnings.warn(f"groups with fewer than {min_n} sequences are left out: {', '.join(map(str, small))}", stacklevel=2)
    totals = totals.where(F.col("n") >= min_n)
    size = F.min("n").over(W.partitionBy(F.lit(0))) if uniform else F.col("n")
    sizes = totals.select(group, (F.least(size, F.lit(max_n)) if max_n is not None else size).cast("long").alias("nsam"))
    kept = counts.join(sizes.select(group), group, "left_semi")
    boot = bootstrap_abundance(complete_abundance(kept, clone, "x", group), sizes, group, clone, nboot=nboot, seed=seed)
    boot = cut_lineage(boot)  # both results read it, and a lost executor must not draw anew
    return abundance_curve(boot, group, clone, nboot=nboot, ci=ci)


def abundance_curve(boot: DataFrame, group: str, clone: str, *, nboot: int, ci: float = 0.95) -> AbundanceCurve:
    """Mean, standard deviation, interval and rank of each clone over the realisations ``boot (group, clone, boot)``.

    Ranks come from clones counted by their share, so no task orders a whole group's clones.
    """
    z = NormalDist().inv_cdf(ci + (1 - ci) / 2)
    mean = F.aggregate("boot", F.lit(0.0), lambda a, b: a + b) / nboot
    base = boot.select(group, clone, "boot", mean.alias("p"))
    spread = F.sqrt(F.aggregate("boot", F.lit(0.0), lambda a, b: a + (b - F.col("p")) * (b - F.col("p"))) / max(1, nboot - 1))
    base = base.select(group, clone, "p", spread.alias("p_sd")).withColumns({"lower": F.greatest(F.lit(0.0), F.col("p") - z * F.col("p_sd")), "upper": F.col("p") + z * F.col("p_sd")})
    steps = base.groupBy(group, "p").agg(F.count("*").alias("_n"))
    w = W.partitionBy(group).orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    ranked = base.join(steps, [group, "p"]).withColumn("rank", (F.col("_before") + F.row_number().over(W.partitionBy(group, "p").orderBy(clone))).cast("int"))
    return AbundanceCurve(ranked.select(group, clone, "p", "p_sd", "lower", "upper", "rank"), boot, group, clone, nboot, ci)


def _grid(min_q: float, max_q: float, step_q: float) -> list[float]:
    q = [round(min_q + i * step_q, 10) for i in range(int(math.floor((max_q - min_q) / step_q + 1e-9)) + 1)]
    return q if 0 in q else [0.0, *q]


def alpha_iterations(bootstrap: DataFrame, group: str, q: Sequence[float]) -> DataFrame:
    """``(group, iter, q, d)``: the Hill numbers of each bootstrap realisation."""
    rows = bootstrap.select(group, F.posexplode("boot").alias("iter", "p"))
    return diversity(rows, "p", q, [group, "iter"])


def diversity_tests(iterations: DataFrame, group: str) -> DataFrame:
    """``(test, q, delta_mean, delta_sd, pvalue)`` for every two groups: two-sided, from the realisations' differences."""
    a = iterations.select(F.col(group).cast("string").alias("a"), "iter", "q", F.col("d").alias("da"))
    b = iterations.select(F.col(group).cast("string").alias("b"), "iter", "q", F.col("d").alias("db"))
    pair = a.join(b, ["iter", "q"]).where("a < b")  # groups are few, and pairs meet within a realisation
    sums = pair.groupBy("a", "b", "q").agg(F.avg(F.col("da") - F.col("db")).alias("mean"), F.stddev_samp(F.col("da") - F.col("db")).alias("delta_sd"), F.avg(F.when(F.col("da") <= F.col("db"), 1.0).otherwise(0.0)).alias("low"), F.avg(F.when(F.col("da") >= F.col("db"), 1.0).otherwise(0.0)).alias("high"))
    p0 = F.when(F.col("mean") >= 0, F.col("low")).otherwise(F.col("high"))
    return sums.select(F.concat("a", F.lit(" != "), "b").alias("test"), "q", F.abs("mean").alias("delta_mean"), "delta_sd", F.when(p0 <= 0.5, 2 * p0).otherwise(2 * (1 - p0)).alias("pvalue"))


def alpha_diversity(data: DataFrame | AbundanceCurve, *, min_q: float = 0, max_q: float = 4, step_q: float = 0.1, ci: float = 0.95, **abundance) -> DiversityCurve:
    """Hill numbers over orders ``min_q`` to ``max_q`` with confidence intervals, evenness, and tests between groups."""
    curve = data if isinstance(data, AbundanceCurve) else estimate_abundance(data, ci=ci, **abundance)
    g, q = curve.group, _grid(min_q, max_q, step_q)
    iterations = cut_lineage(alpha_iterations(curve.bootstrap, g, q))
    z = NormalDist().inv_cdf(ci + (1 - ci) / 2)
    base = iterations.groupBy(g, "q").agg(F.avg("d").alias("d"), F.stddev_samp("d").alias("d_sd"))
    base = base.withColumns({"d_lower": F.greatest(F.lit(0.0), F.col("d") - z * F.col("d_sd")), "d_upper": F.col("d") + z * F.col("d_sd")})
    rich = F.max(F.when(F.col("q") == 0, F.col("d"))).over(W.partitionBy(g))
    base = base.withColumns({"e": F.col("d") / rich, "e_lower": F.col("d_lower") / rich, "e_upper": F.col("d_upper") / rich})
    several = iterations.select(g).distinct().limit(2).count() > 1
    return DiversityCurve(base, diversity_tests(iterations, g) if several else None, iterations, g, ci)


def beta_diversity(curve: AbundanceCurve, comparisons: dict[str, Sequence[str]], *, min_q: float = 0, max_q: float = 4, step_q: float = 0.1, ci: float = 0.95) -> DataFrame:
    """``(comparison, q, d, d_sd, d_lower, d_upper, e)``: gamma over alpha diversity of the groups that each comparison names.

    Gamma is the diversity of the groups' summed abundances, alpha the mean of the groups' diversities.
    """
    g, q, out = curve.group, _grid(min_q, max_q, step_q), None
    for name, members in comparisons.items():
        some = curve.bootstrap.where(F.col(g).isin(*members)).select(g, curve.clone, F.posexplode("boot").alias("iter", "p"))
        alpha = diversity(some, "p", q, [g, "iter"]).groupBy("iter", "q").agg(F.avg("d").alias("alpha"))
        gamma = diversity(some.groupBy(curve.clone, "iter").agg(F.sum("p").alias("p")), "p", q, "iter").withColumnRenamed("d", "gamma")
        one = alpha.join(gamma, ["iter", "q"]).select(F.lit(name).alias("comparison"), "iter", "q", (F.col("gamma") / F.col("alpha")).alias("d"))
        out = one if out is None else out.unionByName(one)
    z = NormalDist().inv_cdf(ci + (1 - ci) / 2)
    base = out.groupBy("comparison", "q").agg(F.avg("d").alias("d"), F.stddev_samp("d").alias("d_sd"))
    base = base.withColumns({"d_lower": F.greatest(F.lit(0.0), F.col("d") - z * F.col("d_sd")), "d_upper": F.col("d") + z * F.col("d_sd")})
    return base.withColumn("e", F.col("d") / F.max(F.when(F.col("q") == 0, F.col("d"))).over(W.partitionBy("comparison")))


def rarefy_diversity(data: DataFrame, group: str, clone: str = "CLONE", **how) -> DiversityCurve:
    """Deprecated name of ``alpha_diversity``, with 2000 realisations by default."""
    warnings.warn("rarefy_diversity is deprecated; use alpha_diversity", DeprecationWarning, stacklevel=2)
    return alpha_diversity(data, group=group, clone=clone, **({"nboot": 2000} | how))


def test_diversity(data: DataFrame, q: float, group: str, clone: str = "CLONE", **how) -> DiversityCurve:
    """Deprecated: ``alpha_diversity`` at one order."""
    warnings.warn("test_diversity is deprecated; use alpha_diversity", DeprecationWarning, stacklevel=2)
    return alpha_diversity(data, group=group, clone=clone, min_q=q, max_q=q, step_q=1, **({"nboot": 2000} | how))


test_diversity.__test__ = False


def stouffer_meta(p: Sequence[float], w: Sequence[float] | None = None) -> tuple[float, float]:
    """Stouffer's Z and p-value of several p-values with weights."""
    w = [1.0] * len(p) if w is None else list(w)
    if len(w) != len(p):
        raise ValueError("p and w must have the same length")
    normal, total = NormalDist(), sum(w)
    w = [x / total for x in w]
    z = sum(a * normal.inv_cdf(1 - b) for a, b in zip(w, p, strict=True)) / math.sqrt(sum(a * a for a in w))
    return z, 1 - normal.cdf(z)


# Frames behind the plots ------------------------------------------------------------------------------------------------
def diversity_at(curve: DiversityCurve, q: float) -> DataFrame:
    """``(group, d, lower, upper)`` at one order: mean and one standard deviation to each side."""
    return curve.diversity.where(F.abs(F.col("q") - q) < 1e-9).select(curve.group, "d", (F.col("d") - F.col("d_sd")).alias("lower"), (F.col("d") + F.col("d_sd")).alias("upper"))
