"""Trees as text: Newick, tables of codon-model trees, and conversion between phylogenies and lineage graphs."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters of a run, in the order in which they are reported.
PARAMETERS = (
    "id nseq nsite lhood tree_length omega_fwr_mle omega_fwr_lci omega_fwr_uci omega_cdr_mle omega_cdr_lci omega_cdr_uci kappa_mle kappa_lci kappa_uci wrc_2_mle wrc_2_lci wrc_2_uci "
    "gyw_0_mle gyw_0_lci gyw_0_uci wa_1_mle wa_1_lci wa_1_uci tw_0_mle tw_0_lci tw_0_uci syc_2_mle syc_2_lci syc_2_uci grs_0_mle grs_0_lci grs_0_uci"
).split()
_TOKEN = re.compile(r"\s*(?:([(),;])|'((?:[^']|'')*)'|([^\s(),:;'\[]+)|:\s*([-+\d.eE]+)|\[[^\]]*\])")


@dataclass
class Node:
    name: str
    length: float
    children: list[Node]

    def tips(self) -> list[Node]:
        return [x for x in walk(self) if not x.children]


def walk(root: Node) -> list[Node]:
    """All nodes, each before its descendants."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(x.children)
    return out


def parse_newick(text: str) -> Node:
    """The tree of a Newick text; missing lengths are 0, missing names empty."""
    root = Node("", 0.0, [])
    here, path = root, []
    for m in _TOKEN.finditer(text):
        mark, quoted, name, length = m.groups()
        if mark == "(":
            path.append(here)
            here.children.append(Node("", 0.0, []))
            here = here.children[-1]
        elif mark == ",":
            path[-1].children.append(Node("", 0.0, []))
            here = path[-1].children[-1]
        elif mark == ")":
            here = path.pop()
        elif mark == ";":
            break
        elif length is not None:
            here.length = float(length)
        elif quoted is not None or name is not None:
            here.name = name if name is not None else quoted.replace("''", "'")
    if path:
        raise ValueError("the tree text ends inside a parenthesis")
    return root


def to_newick(root: Node) -> str:
    def one(x: Node, top: bool) -> str:
        inside = f"({','.join(one(c, False) for c in x.children)})" if x.children else ""
        return inside + x.name + ("" if top else f":{x.length:g}")

    return one(root, True) + ";"


def reroot_germline(root: Node, germline: str) -> Node:
    """Moves the germline tip to a branch of length 0 at the root; a root with several other branches raises."""
    tip = next(t for t in root.tips() if t.name == germline)
    parent = {id(c): x for x in walk(root) for c in x.children}
    if id(tip) in parent and parent[id(tip)] is not root:
        old, chain = parent[id(tip)], []
        while True:  # turn the path to the old root around
            chain.append(old)
            if id(old) not in parent:
                break
            old = parent[id(old)]
        chain[0].children.remove(tip)
        for a, b in zip(chain, chain[1:], strict=False):
            b.children.remove(a)
            a.children.append(b)
        lengths = [x.length for x in chain]
        for x, n in zip(chain[1:], lengths, strict=False):
            x.length = n
        last, top = chain[-1], chain[0]
        if len(chain) > 1 and len(last.children) == 1:
            chain[-2].children.remove(last)
            only = last.children[0]
            only.length += last.length
            chain[-2].children.append(only)
        top.length = 0.0
        root = Node("", 0.0, [tip, top])
    others = [c for c in root.children if c is not tip]
    if len(others) != 1:
        raise ValueError("polytomy at the root")
    others[0].length += tip.length
    tip.length = 0.0
    return root


def ladderize(root: Node) -> Node:
    """Children ordered by their number of tips, the larger first; equal ones keep their order."""
    size: dict[int, int] = {}
    for x in reversed(walk(root)):
        size[id(x)] = sum(size[id(c)] for c in x.children) or 1
    for x in walk(root):
        x.children.sort(key=lambda c: -size[id(c)])
    return root


def collapse_short(root: Node, tolerance: float) -> Node:
    """Inner branches shorter than ``tolerance`` vanish; their children move up, with the branch's length added."""
    for x in reversed(walk(root)):
        kids: list[Node] = []
        for c in x.children:
            if c.children and c.length < tolerance:
                for g in c.children:
                    g.length += c.length
                kids += c.children
            else:
                kids.append(c)
        x.children = kids
    return root


def numbered(root: Node) -> list[tuple[int, int, float, str]]:
    """``(parent, child, length, name)`` with tips numbered from 1, then inner nodes; the root's row has parent 0."""
    order = walk(root)
    tips = [x for x in order if not x.children]
    number = {id(x): i for i, x in enumerate(tips, 1)}
    number |= {id(x): i for i, x in enumerate((x for x in order if x.children), len(tips) + 1)}
    above = {id(c): number[id(x)] for x in order for c in x.children}
    return [(above.get(id(x), 0), number[id(x)], x.length, x.name) for x in order]


def graph_edges(root: Node, germline: str | None) -> list[tuple[str, str, float]]:
    """Edges of the lineage graph: the germline becomes the root, in place of the common ancestor or before it."""
    rows = numbered(root)
    name = {c: n or str(c) for _, c, _, n in rows}
    edges = [[p, c, w] for p, c, w, _ in rows if p]
    if germline is not None:
        germ = next(c for c, n in name.items() if n == germline)
        uca = next(p for p, c, _ in edges if c == germ)
        if sum(p == uca for p, _, _ in edges) == 2:
            edges = [[germ if p == uca else p, c, w] for p, c, w in edges if c != germ]
        else:
            edges = [[germ, uca, w] if (p, c) == (uca, germ) else [p, c, w] for p, c, w in edges]
    return [(name[p], name[c], w) for p, c, w in edges]


def graph_to_tree(edges: Sequence[tuple[str, str, float]]) -> Node:
    """A phylogeny from a lineage graph: nodes with one edge are tips, and a germline at the root becomes a tip at length 0
    below a node ``<germline>_UCA``."""
    nodes: dict[str, Node] = {}
    for p, c, w in edges:
        child = nodes.setdefault(c, Node(c, 0.0, []))
        child.length = float(w)
        nodes.setdefault(p, Node(p, 0.0, [])).children.append(child)
    below = {c for _, c, _ in edges}
    root = next(n for k, n in nodes.items() if k not in below)
    if len(root.children) == 1:
        tip, root = Node(root.name, 0.0, []), Node(f"{root.name}_UCA", 0.0, root.children)
        root.children = [*root.children, tip]
    return ladderize(root)


@dataclass
class CodonRun:
    """``params`` (one row per repertoire and clone), the ``command``, and ``edges (tree_id, parent, child, weight)`` of the trees."""

    params: DataFrame
    command: str
    edges: DataFrame


def read_codon_trees(spark: SparkSession, path: str, *, id: str | None = None, format: str = "graph", collapse: bool = False, branches: str = "mutations") -> CodonRun:
    """Reads a table of codon-model trees: its first row has the repertoire's parameters and the command, the others a tree each.

    ``format="graph"`` roots each tree at its germline tip ``<clone>_GERM``; ``"phylo"`` keeps numbered nodes, with names
    in ``name`` and parents by number. ``branches="mutations"`` scales lengths by the sites, to one decimal. ``collapse``
    drops branches below 0.1 mutations (0.0001 of distance). Trees are parsed on the executors.
    """
    if format not in ("graph", "phylo") or branches not in ("mutations", "distance"):
        raise ValueError("format must be graph or phylo, branches mutations or distance")
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    params = df.drop("TREE").toDF(*(c.lower() for c in df.columns if c != "TREE"))
    params = params.withColumns({c: F.when(~F.col(c).isin("", "NA"), F.col(c)) for c in params.columns})
    command = df.where(F.col("CLONE") == "REPERTOIRE").select("TREE").first()
    command = command[0] if command else df.select("TREE").first()[0]
    trees = df.where(F.col("TREE").startswith("(")).select(F.col("CLONE").alias("tree_id"), F.col("NSITE").cast("double").alias("nsite"), "TREE")

    def parse(batches):
        for pdf in batches:
            out = []
            for tree_id, sites, text in pdf.itertuples(index=False):
                root = parse_newick(text)
                germ = [t.name for t in root.tips() if f"{tree_id}_GERM" in t.name]
                if len(germ) != 1:
                    raise ValueError(f"clone {tree_id}: there must be one tip of the form '<clone>_GERM'")
                if len(root.children) > 2:
                    warnings.warn(f"the tree of {germ[0]} is not rooted", stacklevel=1)
                    root = reroot_germline(root, germ[0])
                root = ladderize(root)
                for x in walk(root):
                    if branches == "mutations":
                        x.length = round(x.length * sites, 1)
                    if collapse and x.children:
                        x.name = ""
                if collapse:
                    root = collapse_short(root, 0.1 if branches == "mutations" else 0.0001)
                if format == "graph":
                    out += [(tree_id, p, c, w, None) for p, c, w in graph_edges(root, germ[0])]
                else:
                    out += [(tree_id, str(p), str(c), w, n) for p, c, w, n in numbered(root)]
            yield pd.DataFrame(out, columns=["tree_id", "parent", "child", "weight", "name"])

    edges = trees.mapInPandas(parse, "tree_id string, parent string, child string, weight double, name string")
    if format == "graph":
        edges = edges.drop("name")
    return CodonRun(params.withColumn("id", F.lit(id)) if id is not None else params, command, edges)


def combine_codon_runs(runs: Sequence[CodonRun], format: str = "wide") -> DataFrame:
    """The repertoire parameters of several runs: one row each, or one per parameter (``long``: ``id, variable, value``)."""
    columns = [set(r.params.columns) for r in runs]
    often = {c: sum(c in s for s in columns) for c in set().union(*columns)}
    names = [p for p in PARAMETERS if often.get(p) == max(often.values())]
    if "id" not in names:
        raise ValueError("id is missing: give it to read_codon_trees")
    out = None
    for r in runs:
        one = r.params.where(F.col("clone") == "REPERTOIRE").select(*(n for n in names if n in r.params.columns))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if format == "wide":
        return out
    return out.unpivot(["id"], [n for n in names if n != "id"], "variable", "value")


def graph_to_phylo(edges: DataFrame) -> DataFrame:
    """``(tree_id, parent, child, weight, name)`` of numbered phylogenies, from lineage graphs; the root's row has parent 0."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        root = graph_to_tree(list(zip(pdf["parent"], pdf["child"], pdf["weight"], strict=True)))
        return pd.DataFrame([(key[0], p, c, w, n) for p, c, w, n in numbered(root)], columns=["tree_id", "parent", "child", "weight", "name"])

    kind = edges.schema["tree_id"].dataType.simpleString()
    return edges.groupBy("tree_id").applyInPandas(one, f"tree_id {kind}, parent int, child int, weight double, name string")


def phylo_to_graph(phylo: DataFrame, germline: str | None = "Germline") -> DataFrame:
    """``(tree_id, parent, child, weight)`` of lineage graphs, from numbered phylogenies."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {c: Node(n or "", float(w), []) for c, w, n in zip(pdf["child"], pdf["weight"], pdf["name"], strict=True)}
        for p, c in zip(pdf["parent"], pdf["child"], strict=True):
            if p:
                nodes[p].children.append(nodes[c])
        root = nodes[pdf.loc[pdf["parent"] == 0, "child"].iloc[0]]
        return pd.DataFrame([(key[0], *e) for e in graph_edges(root, germline)], columns=["tree_id", "parent", "child", "weight"])

    kind = phylo.schema["tree_id"].dataType.simpleString()
    return phylo.groupBy("tree_id").applyInPandas(one, f"tree_id {kind}, parent string, child string, weight double")
