"""V(D)J grouping: single linkage of rearrangements over the V-J(-length) combinations they may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.functions.calls import get_gene, is_heavy
from repseq.operators.components import connected_components
from repseq.session import cut_lineage


def _keys(v: Column, j: Column, length: Column | None) -> Column:
    """All combinations of one row's possible genes."""
    tail = F.concat(F.lit("@"), length.cast("string")) if length is not None else F.lit("")
    return F.flatten(F.transform(F.split(v, ","), lambda a: F.transform(F.split(j, ","), lambda b: F.concat(a, F.lit("@"), b, tail))))


def _labels(combos: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """``(combo, vj_group)``: combos that share a key, directly or over others, get one group; so do all ``pooled`` ones."""
    keyed = cut_lineage(combos.select("combo", F.array_sort("keys").alias("keys")).distinct())
    edges = keyed.select(F.col("keys")[0].alias("src"), F.explode("keys").alias("dst"))
    if pooled is not None:
        ends = pooled.select(F.array_sort("keys")[0].alias("dst")).distinct()
        edges = edges.union(ends.crossJoin(F.broadcast(ends.agg(F.min("dst").alias("src")))).select("src", "dst"))
    found = connected_components(edges.distinct())
    named = keyed.select("combo", F.col("keys")[0].alias("node")).join(found, "node")
    groups = named.select("component").distinct()
    rank = F.row_number().over(W.orderBy("component"))  # one row per group of combinations
    groups = groups.withColumn("vj_group", F.concat(F.lit("G"), rank.cast("string")))
    return named.join(groups, "component").select("combo", "vj_group")


def group_genes(
    data: DataFrame, *, v_call: str = "v_call", j_call: str = "j_call", junc_len: str | None = None, locus: str = "locus", cell_id: str | None = None, first: bool = False, mixed_bulk: str = "pooled", out: str = "vj_group"
) -> DataFrame:
    """Adds ``vj_group``: rows whose ambiguous calls share a V and J gene (and junction length) fall into one group.

    Without ``cell_id`` every row is grouped by its own calls, and rows without a call are dropped. With it, cells are
    grouped by their heavy chain and all their rows inherit the group; cells without a usable heavy chain get NULL; several
    heavy chains in a cell raise. Rows without a cell form one pseudo-cell, so their heavy chains end in one group
    (``mixed_bulk="pooled"``), or are grouped one by one (``"independent"``); light ones get NULL either way.

    ``first`` uses the first call only. Groups are numbered by their smallest combination, in byte order. The graph holds
    distinct combinations of genes, not rows.
    """
    length = F.col(junc_len) if junc_len else None
    v, j = get_gene(v_call, first=first), get_gene(j_call, first=first)
    usable = v.isNotNull() & (v != "") & j.isNotNull() & (j != "")
    if length is not None:
        usable = usable & length.isNotNull()
    if cell_id is None:
        rows = data.where(usable).withColumn("_keys", _keys(v, j, length)).withColumn("_combo", F.array_join("_keys", "|"))
        names = _labels(rows.select(F.col("_combo").alias("combo"), F.col("_keys").alias("keys")))
        return rows.join(names.withColumnsRenamed({"combo": "_combo", "vj_group": out}), "_combo").drop("_combo", "_keys")

    heavy = data.where(is_heavy(locus))
    in_cell = heavy.where(F.col(cell_id).isNotNull())
    doubled = in_cell.groupBy(cell_id).count().where("count > 1").limit(1).collect()
    if doubled:
        raise ValueError(f"cell {doubled[0][0]} has several heavy chains")
    keyed = heavy.where(usable).withColumn("_keys", _keys(v, j, length)).withColumn("_combo", F.array_join("_keys", "|"))
    loose = keyed.where(F.col(cell_id).isNull())
    combos = keyed.select(F.col("_combo").alias("combo"), F.col("_keys").alias("keys"))
    pooled = loose.select(F.col("_keys").alias("keys")).distinct() if mixed_bulk == "pooled" else None
    names = cut_lineage(_labels(combos, pooled).withColumnsRenamed({"combo": "_combo", "vj_group": out}))
    cells = keyed.where(F.col(cell_id).isNotNull()).select(cell_id, "_combo").join(names, "_combo").drop("_combo")
    celled = data.where(F.col(cell_id).isNotNull()).join(cells, cell_id, "left").select(*data.columns, out)
    rest = data.where(F.col(cell_id).isNull())
    if mixed_bulk == "pooled":
        group = loose.select("_combo").distinct().join(names, "_combo").agg(F.min(out).alias(out))  # they all have one
        pooled_rows = rest.crossJoin(F.broadcast(group.withColumnRenamed(out, "_group")))
        return celled.unionByName(pooled_rows.withColumn(out, F.when(is_heavy(locus), F.col("_group"))).drop("_group"))
    own = rest.withColumn("_combo", F.when(is_heavy(locus) & usable, F.array_join(_keys(v, j, length), "|")))
    return celled.unionByName(own.join(names, "_combo", "left").select(*data.columns, out))
