"""Lineage-tree topology: subtree statistics, path lengths, MRCA, edge tables, and permutation tests.

A forest is two tables: ``nodes (tree_id, name, <annotations>)`` and ``edges (tree_id, parent, child, weight)``. A tree (one
clone's lineage) is walked in one task, linearly; forests of any size are many trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.session import cut_lineage, tasks

ROOT = "Germline"
#: Labels that a task draws for one tree, about; more are dealt by rounds, to ``BLOCKS`` tasks at most.
DRAWN, BLOCKS = 1_000_000, 16


def _trees(nodes: DataFrame, edges: DataFrame, walk, schema: str) -> DataFrame:
    """``walk(tree_id, names, children, extra)`` per tree; its rows follow ``tree_id`` in ``schema``."""
    kind = nodes.schema["tree_id"].dataType.simpleString()

    def one(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        children: dict[str, list[tuple[str, float]]] = {x: [] for x in n["name"]}
        for p, c, w in zip(e["parent"], e["child"], e["weight"], strict=True):
            if p in children and c in children:
                children[p].append((c, float(w)))
        rows = walk(children, n)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["tree_id", *(c.split()[0] for c in schema.split(", "))])

    # New names for the keys, as both tables may come from one.
    ends = edges.select(F.col("tree_id").alias("tree_id"), "parent", "child", F.col("weight").cast("double").alias("weight"))
    return nodes.groupBy("tree_id").cogroup(ends.groupBy("tree_id")).applyInPandas(one, f"tree_id {kind}, {schema}")


def _order(children: dict) -> list[str]:
    """Names so that each comes before its descendants (iterative, so depth is no limit)."""
    below = {c for kids in children.values() for c, _ in kids}
    stack, out = [n for n in children if n not in below], []
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c, _ in children[n]]
    return out


def summarize_subtrees(nodes: DataFrame, edges: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Per node: ``fields, parent, outdegree, size, depth, pathlength`` and each number's share of the tree's sum or maximum."""

    def walk(children, n):
        order = _order(children)
        parent = {c: p for p, kids in children.items() for c, _ in kids}
        size, depth, length = {}, {}, {}
        for x in reversed(order):
            kids = children[x]
            size[x] = 1 + sum(size[c] for c, _ in kids)
            depth[x] = 1 + max((depth[c] for c, _ in kids), default=0)
            length[x] = max((length[c] + w for c, w in kids), default=0.0)
        return [(x, parent.get(x), len(children[x]), size[x], depth[x], length[x]) for x in order]

    out = _trees(nodes.select("tree_id", "name"), edges, walk, "name string, parent string, outdegree long, size long, depth long, pathlength double")
    w = W.partitionBy("tree_id")
    share = lambda c, total: F.try_divide(F.col(c).cast("double"), total.over(w).cast("double"))
    out = out.withColumns({
        "outdegree_norm": share("outdegree", F.sum("outdegree")),
        **{f"{c}_norm": share(c, F.max(c)) for c in ("size", "depth", "pathlength")},
    })
    if fields:
        out = out.join(nodes.select("tree_id", "name", *fields), ["tree_id", "name"])
    return out.select("tree_id", "name", *fields, *(c for c in out.columns if c not in ("tree_id", "name", *fields)))


def _excluded(field: str | None, exclude: Sequence) -> Column:
    if field is None:
        return F.lit(False)
    some = [x for x in exclude if x is not None]
    out = F.col(field).isin(*some) if some else F.lit(False)
    return F.coalesce(out, F.lit(False)) | (F.col(field).isNull() if None in exclude else F.lit(False))


def path_lengths(nodes: DataFrame, edges: DataFrame, root: str = ROOT, field: str | None = None, exclude: Sequence = ()) -> DataFrame:
    """``(tree_id, name, steps, distance)`` from the root: steps count nodes on the path that are not excluded, the node itself
    included and the root not. Nodes that the root does not reach have 0 of both."""

    def walk(children, n):
        skip = dict(zip(n["name"], n["_skip"], strict=True))
        found = {x: (0, 0.0) for x in children}
        stack = [root] if root in children else []
        while stack:
            x = stack.pop()
            s, d = found[x]
            for c, w in children[x]:
                found[c] = (s + (not (skip[c] or c == root)), d + w)
                stack.append(c)
        return [(x, *v) for x, v in found.items()]

    return _trees(nodes.select("tree_id", "name", _excluded(field, exclude).alias("_skip")), edges, walk, "name string, steps long, distance double")


def mrca(nodes: DataFrame, edges: DataFrame, *, path: str = "distance", root: str = ROOT, field: str | None = None, exclude: Sequence = ()) -> DataFrame:
    """The nodes nearest to the root by ``distance`` or ``steps``, without the root and excluded nodes; all of them on ties."""
    if path not in ("distance", "steps"):
        raise ValueError("path must be distance or steps")
    far = path_lengths(nodes, edges, root, field, exclude)
    some = nodes.where((F.col("name") != root) & ~_excluded(field, exclude)).join(far, ["tree_id", "name"])
    return some.withColumn("_least", F.min(path).over(W.partitionBy("tree_id"))).where(F.col(path) == F.col("_least")).drop("_least")


def _edge_pairs(nodes: DataFrame, edges: DataFrame, field: str, indirect: bool, exclude: Sequence) -> DataFrame:
    """``(tree_id, parent, child)`` of kept nodes: direct edges, or those to the nearest kept descendants."""
    marked = nodes.select("tree_id", "name", _excluded(field, exclude).alias("_skip"))
    if not indirect:
        keep = marked.where("NOT _skip").drop("_skip")
        out = edges.select("tree_id", "parent", "child").join(keep.withColumnRenamed("name", "parent"), ["tree_id", "parent"], "left_semi")
        return out.join(keep.withColumnRenamed("name", "child"), ["tree_id", "child"], "left_semi").select("tree_id", "parent", "child")

    def walk(children, n):
        skip, above, out = dict(zip(n["name"], n["_skip"], strict=True)), {}, []
        for x in _order(children):  # the nearest kept node above each node
            here = x if not skip[x] else above.get(x)
            for c, _ in children[x]:
                above[c] = here
                if here is not None and not skip[c]:
                    out.append((here, c))
        return out

    return _trees(marked, edges, walk, "parent string, child string")


def table_edges(nodes: DataFrame, edges: DataFrame, field: str, *, indirect: bool = False, exclude: Sequence = ()) -> DataFrame:
    """``(tree_id, parent, child, count)``: edges between annotations. ``indirect`` looks through excluded nodes."""
    return _label(_edge_pairs(nodes, edges, field, indirect, exclude), nodes, field).groupBy("tree_id", "parent", "child").agg(F.count("*").alias("count"))


def _label(pairs: DataFrame, nodes: DataFrame, field: str, keys: Sequence[str] = ("tree_id",)) -> DataFrame:
    for end in ("parent", "child"):
        names = nodes.select(*keys, F.col("name").alias(end), F.col(field).alias(f"_{end}"))
        pairs = pairs.join(names, [*keys, end]).drop(end)
    return pairs.withColumnsRenamed({"_parent": "parent", "_child": "child"})


def permute_labels(nodes: DataFrame, field: str, *, exclude: Sequence = (ROOT, None), seed: int = 42, nperm: int = 1) -> DataFrame:
    """``(iter, tree_id, name, field)``: in each of ``nperm`` rounds, the labels of a tree's nodes that are not excluded, shuffled.

    The order of a round follows from a hash of seed, round, tree and name, so it does not depend on partitions. Excluded
    nodes are not returned; a tree with one other node keeps its label.
    """
    kept = nodes.where(~_excluded(field, exclude)).select("tree_id", "name", field)
    rounds = kept.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(nperm))))
    w = W.partitionBy("iter", "tree_id")
    rounds = rounds.withColumns({"_fixed": F.row_number().over(w.orderBy("name")), "_drawn": F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("iter").cast("string"), F.col("tree_id").cast("string"), "name")), "name"))})
    a = rounds.select("iter", "tree_id", "name", F.col("_fixed").alias("_at"))
    b = rounds.select("iter", "tree_id", F.col("_drawn").alias("_at"), field)
    return a.join(b, ["iter", "tree_id", "_at"]).select("iter", "tree_id", "name", field)


def _drawn(head: bytes, names: list[bytes]) -> np.ndarray:
    """Places of ``names`` (sorted) by the MD5 digest of ``head`` and name, ties in their order."""
    keys = np.frombuffer(b"".join([md5(head + x, usedforsecurity=False).digest() for x in names]), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.argsort(keys[:, 0], kind="stable")
    high = keys[order, 0]
    return np.lexsort((keys[:, 1], keys[:, 0])) if (high[1:] == high[:-1]).any() else order


def _permuted(nodes: DataFrame, places: DataFrame, field: str, tally, out: Sequence[str], exclude: Sequence, seed: int, nperm: int) -> DataFrame:
    """``(iter, *out, count)``: what ``tally`` counts in each of ``permute_labels``'s rounds, for each tree.

    ``places`` has ``tree_id`` and names of nodes that are not excluded. ``tally`` gets a tree's codes of labels (-1: NULL)
    in a round, one array for each column of names, and returns arrays of codes, one for each of ``out``, and counts. A task
    draws a tree's labels round by round, so the rounds' labels are never rows; a large tree's rounds are dealt to several tasks.
    """
    ends = [c for c in places.columns if c != "tree_id"]
    blocks = F.least(F.ceil(F.count("*").over(W.partitionBy("tree_id")) * nperm / DRAWN), F.lit(BLOCKS)).cast("int")
    kept = nodes.where(~_excluded(field, exclude) & F.col("tree_id").isNotNull()).select("tree_id", F.col("tree_id").cast("string").alias("tree"), F.col("name").cast("string").alias("name"), F.col(field).alias("label"), blocks.alias("blocks"))
    kept = kept.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sizes = kept.select("tree_id", "block").distinct()
    wanted = places.select("tree_id", *(F.col(c).cast("string").alias(c) for c in ends)).join(sizes, "tree_id")
    wanted = wanted.select(F.col("tree_id").alias("tree_id"), F.col("block").alias("block"), *ends)  # new names for the keys
    kind = nodes.schema[field].dataType.simpleString()

    def one(n: pa.Table, p: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(len(out) + 2)]
        n = n.take(pc.sort_indices(n, sort_keys=[("name", "ascending")], null_placement="at_start"))  # by bytes, as Spark sorts
        labels = n["label"].combine_chunks()
        if len(n) and len(p):
            first: dict[str, int] = {}
            code = np.array([-1 if x is None else first.setdefault(repr(x), i) for i, x in enumerate(labels.to_pylist())], np.int64)
            names = n["name"].to_pylist()
            at = {x: i for i, x in enumerate(names)}
            spots = [np.array([at[x] for x in p[c].to_pylist()], np.int64) for c in ends]
            ids, tree, blocks = [b"" if x is None else b"|" + x.encode() for x in names], n["tree"][0].as_py(), n["blocks"][0].as_py()
            for i in range(n["block"][0].as_py() + 1, nperm + 1, blocks):
                drawn = code[_drawn(f"{seed}|{i}|{tree}".encode(), ids)]
                got = tally(*(drawn[x] for x in spots))
                for x, more in zip(found, [np.full(len(got[0]), i), *got], strict=True):
                    x.append(more)
        rounds, *codes, counts = (np.concatenate(x) for x in found)
        values = [labels.take(pa.array(np.maximum(c, 0), mask=c < 0)) for c in codes]
        return pa.table([pa.array(rounds, pa.int32()), *values, pa.array(counts, pa.int64())], names=["iter", *out, "count"])

    # The work is far larger than the input, so the number of tasks is given.
    left, right = (x.repartition(tasks(nodes.sparkSession), "tree_id", "block").groupBy("tree_id", "block") for x in (kept, wanted))
    counted = left.cogroup(right).applyInArrow(one, f"iter int, {', '.join(f'{c} {kind}' for c in out)}, count long")
    return counted.groupBy("iter", *out).agg(F.sum("count").alias("count"))


def _test(observed: DataFrame, permuted: DataFrame, keys: Sequence[str], fill_zero: bool, nperm: int) -> DataFrame:
    """Expected count and p-value of each observed count, over the rounds in which it occurs (or all)."""
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}"))
    # Spark takes the rounds' counts for as small as the tables that they were drawn from, and would send them to all.
    joined = observed.alias("o").join(permuted.hint("merge").alias("p"), cond, "left").groupBy(*(F.col(f"o.{k}").alias(k) for k in keys), F.col("o.count").alias("count"))
    n = F.lit(float(nperm)) if fill_zero else F.count("p.count")
    return joined.agg((F.sum("p.count") / n).alias("expected"), (F.sum(F.when(F.col("p.count") > F.col("o.count"), 1).otherwise(0)) / n).alias("pvalue"))


def mrca_test(nodes: DataFrame, edges: DataFrame, field: str, *, root: str = ROOT, exclude: Sequence = (ROOT, None), nperm: int = 200, seed: int = 42, fill_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(tests, permutations)`` of MRCA annotations: ``annotation, count, expected, pvalue`` and ``iter, annotation, count``.

    Trees whose nearest nodes carry several annotations do not count. Shuffling moves labels, not nodes, so paths are
    measured once.
    """
    near = mrca(nodes, edges, root=root, field=field, exclude=exclude).select("tree_id", "name", F.col(field).alias("annotation"))
    near = cut_lineage(near)  # observed and permuted counts read it
    single = near.groupBy("tree_id").agg(F.min("annotation").alias("annotation"), F.max("annotation").alias("_other"))
    observed = single.where("annotation = _other").groupBy("annotation").agg(F.count("*").alias("count"))

    def tally(codes):
        some = np.unique(codes[codes >= 0])
        return (some, np.ones(1, np.int64)) if len(some) == 1 else (np.empty(0, np.int64),) * 2

    permuted = _permuted(nodes, near.select("tree_id", "name"), field, tally, ["annotation"], exclude, seed, nperm)
    return _test(observed, permuted, ["annotation"], fill_zero, nperm), permuted


def edge_test(nodes: DataFrame, edges: DataFrame, field: str, *, indirect: bool = False, exclude: Sequence = (ROOT, None), nperm: int = 200, seed: int = 42, fill_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(tests, permutations)`` of annotation pairs: ``parent, child, count, expected, pvalue`` and ``iter, parent, child, count``."""
    pairs = cut_lineage(_edge_pairs(nodes, edges, field, indirect, exclude))  # observed and permuted counts read it
    observed = _label(pairs, nodes, field).groupBy("parent", "child").agg(F.count("*").alias("count"))

    def tally(parent, child):
        span = max(parent.max(), child.max()) + 2
        both, count = np.unique((parent + 1) * span + child + 1, return_counts=True)
        return both // span - 1, both % span - 1, count

    permuted = _permuted(nodes, pairs, field, tally, ["parent", "child"], exclude, seed, nperm)
    return _test(observed, permuted, ["parent", "child"], fill_zero, nperm), permuted


# Frames behind the plots ------------------------------------------------------------------------------------------------
def permutation_histogram(permutations: DataFrame, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """``(keys, bin, low, rounds)``: how often each annotation had how many counts, in bins of equal width."""
    permutations = cut_lineage(permutations)  # read twice, and small
    span = permutations.agg(F.min("count").alias("_min"), F.max("count").alias("_max"))
    x = permutations.crossJoin(F.broadcast(span))  # one row
    width = F.greatest((F.col("_max") - F.col("_min")) / bins, F.lit(1e-9))
    x = x.withColumn("bin", F.least(F.floor((F.col("count") - F.col("_min")) / width), F.lit(bins - 1)).cast("int")).withColumn("low", F.col("_min") + F.col("bin") * width)
    return x.groupBy(*keys, "bin", "low").agg(F.count("*").alias("rounds"))


def permutation_ecdf(permutations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, count, share)``: the share of rounds with at most that count."""
    n = permutations.groupBy(*keys, "count").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    return n.withColumn("share", F.sum("_n").over(w.orderBy("count")) / F.sum("_n").over(w)).drop("_n")
