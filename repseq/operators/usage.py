"""Gene usage: tables of V(D)J allele, gene or family counts and frequencies."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.functions.calls import get_allele, get_family, get_gene

_MODES = {"gene": get_gene, "allele": get_allele, "family": get_family, "asis": lambda c, **_: F.col(c)}


def _list(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _over(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def _best(df: DataFrame, keys: list[str], count: str, gene: str) -> DataFrame:
    """One row per ``keys``: the gene with the largest count, the smallest name on ties."""
    return df.groupBy(*keys).agg(F.min(F.struct((-F.col(count)).alias("_n"), F.col(gene).alias("_g"))).alias("_best")).select(*keys, F.col("_best._g").alias(gene))


def count_genes(
    data: DataFrame,
    gene: str,
    groups: str | Sequence[str] | None = None,
    *,
    copy: str | None = None,
    clone: str | None = None,
    fill: bool = False,
    first: bool = True,
    collapse: bool = True,
    mode: str = "gene",
    cell_id: str | None = "cell_id",
    locus: str = "locus",
    remove_na: bool = True,
) -> DataFrame:
    """Counts and frequencies of each gene by ``groups`` and locus; with ``clone`` each clone counts once, by its most frequent gene.

    Frequencies are shares of the (groups, locus) total. A ``cell_id`` column switches to single-cell counting: each cell
    counts once per gene and the denominator is the group's cells (``cell_id=None`` counts rows). A clone with several
    most frequent genes takes the smallest name. ``fill`` completes groups and genes with zeros. NULL genes are dropped
    unless ``remove_na=False``; then they form their own NULL locus where no locus column exists.
    """
    groups = _list(groups)
    single = cell_id is not None and cell_id in data.columns
    if single and copy:
        raise ValueError("copy numbers cannot be counted for single cells")
    if remove_na:
        data = data.where(F.col(gene).isNotNull())
    if clone and copy:
        warnings.warn("the clone column is ignored where copy numbers are counted", stacklevel=2)
        clone = None
    df = data.withColumn("gene", _MODES[mode](gene, **({} if mode == "asis" else {"first": first, "collapse": collapse})))
    own_locus = F.col(locus) if locus in data.columns else F.substring("gene", 1, 3)
    df = df.withColumn("locus", own_locus)

    if single and clone:
        out = _clones_of_cells(df.where(F.col(clone).isNotNull()), groups, clone)
    elif single:
        cells = df.select(*groups, "gene", cell_id).distinct()
        total = cells.select(*groups, cell_id).distinct().groupBy(*groups).agg(F.count("*").alias("cell_count"))
        out = _share(cells.groupBy(*groups, "gene").agg(F.count("*").alias("seq_count")), total, groups)
    elif clone:
        kept = df.where(F.col(clone).isNotNull()).groupBy(*groups, "locus", clone, "gene").agg(F.count("*").alias("_n"))
        best = _best(kept, [*groups, "locus", clone], "_n", "gene")
        out = best.groupBy(*groups, "locus", "gene").agg(F.count("*").alias("clone_count"))
        total = F.sum("clone_count").over(_over([*groups, "locus"]))
        out = out.withColumn("locus_clone_count", total).withColumn("clone_freq", F.col("clone_count") / total)
    else:
        sums = {"seq_count": F.count("*")} | ({"copy_count": F.sum(copy)} if copy else {})
        out = df.groupBy(*groups, "locus", "gene").agg(*(c.alias(n) for n, c in sums.items()))
        w = _over([*groups, "locus"])
        out = out.withColumn("locus_count", F.sum("seq_count").over(w))
        if copy:
            out = out.withColumn("locus_copy_count", F.sum("copy_count").over(w))
        out = out.withColumn("seq_freq", F.col("seq_count") / F.col("locus_count"))
        if copy:
            out = out.withColumn("copy_freq", F.col("copy_count") / F.col("locus_copy_count"))
    return _complete(out, groups) if fill else out


def _share(counts: DataFrame, total: DataFrame, groups: list[str]) -> DataFrame:
    if groups:
        cond: Column = F.lit(True)
        for g in groups:
            cond = cond & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
        out = counts.alias("a").join(total.alias("b"), cond).select("a.*", "b.cell_count")
    else:
        out = counts.crossJoin(total)  # one row
    return out.withColumn("seq_freq", F.col("seq_count") / F.col("cell_count"))


def _clones_of_cells(df: DataFrame, groups: list[str], clone: str) -> DataFrame:
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    kept = df.dropDuplicates(plain).groupBy(*groups, clone, "gene").agg(F.count("*").alias("_n"))
    best = _best(kept, [*groups, clone], "_n", "gene")
    out = best.groupBy(*groups, "gene").agg(F.count("*").alias("clone_count"))
    return out.withColumn("clone_freq", F.col("clone_count") / F.sum("clone_count").over(_over(groups)))


def _complete(out: DataFrame, groups: list[str]) -> DataFrame:
    """All combinations of the observed values of each group column and of the gene, missing ones with zeros."""
    domain = out.select("gene").distinct()
    for g in groups:
        domain = domain.crossJoin(out.select(g).distinct())  # distinct group values and gene names only
    keys = [*groups, "gene"]
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"o.{k}"))
    zeros = [c for c in out.columns if c.endswith(("_count", "_freq")) and not c.startswith("locus_")]
    rest = [c for c in out.columns if c not in keys and c not in zeros and c != "locus"]
    joined = domain.alias("d").join(out.alias("o"), cond, "left")
    cols = [F.col(f"d.{k}") for k in groups] + [F.substring("d.gene", 1, 3).alias("locus"), F.col("d.gene")]
    cols += [F.col(f"o.{c}") if c in rest else F.coalesce(F.col(f"o.{c}"), F.lit(0)).alias(c) for c in out.columns if c in zeros or c in rest]
    return joined.select(*cols)
