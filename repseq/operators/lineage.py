"""Lineages: clones with cleaned sequences, and their trees (by an external PHYLIP program or by parsimony)."""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repseq.functions.calls import get_gene
from repseq.functions.constants import IUPAC_DNA
from repseq.functions.sequence import mask_ends, mask_gaps, pad_ends
from repseq.operators.collapse import collapse_duplicates
from repseq.session import cut_lineage

GERMLINE = "Germline"


@dataclass
class Clones:
    """``clones (clone, germline, v_gene, j_gene, junc_len)`` and their cleaned ``sequences (clone, sequence_id, sequence, ...)``."""

    clones: DataFrame
    sequences: DataFrame
    clone: str


def make_clones(
    data: DataFrame, *, id: str = "sequence_id", seq: str = "sequence_alignment", germ: str = "germline_alignment", v_call: str = "v_call", j_call: str = "j_call", junc_len: str = "junction_length",
    clone: str = "clone_id", mask_char: str = "N", locus: str = "locus", max_mask: int | None = 0, pad_end: bool = False, text_fields: Sequence[str] = (), num_fields: Sequence[str] = (),
    seq_fields: Sequence[str] = (), add_count: bool = True, by: Sequence[str] = (),
) -> Clones:
    """All clones at once: gaps masked, ragged ends masked, ends padded, duplicates collapsed, within each clone.

    Every locus must be IGH. Sequences of a clone must have one length after padding. The clone's germline, genes and
    junction length are those of its row with the smallest id. ``by`` names further columns that a clone is unique within.
    """
    keys = [*by, clone]
    rows = data.where(F.col(clone).isNotNull())
    if not rows.where(F.col(locus).isNull() | (F.col(locus) != "IGH")).isEmpty():
        raise ValueError(f"only heavy chains (IGH) are allowed in the column {locus}")
    work = rows.withColumns({seq: mask_gaps(seq, mask_char=mask_char), "_germline": mask_gaps(germ, mask_char=mask_char)})
    work = mask_ends(work, seq, mask_char=mask_char, max_mask=max_mask, by=keys)
    if pad_end:
        work = pad_ends(work, seq, pad_char=mask_char, by=keys)
        width = F.length("_germline") + (F.lit(3) - F.length("_germline") % 3) % 3
        work = work.withColumn("_germline", F.rpad("_germline", width, F.lit(mask_char)))
    uneven = work.groupBy(*keys).agg(F.min(F.length(seq)).alias("a"), F.max(F.length(seq)).alias("b"), F.min(id).alias("i")).where("a <> b").limit(1).collect()
    if uneven:
        raise ValueError(f"sequences differ in length in the clone with first {id} = {uneven[0]['i']}; consider pad_end=True")
    info = work.groupBy(*keys).agg(F.min_by(F.struct("_germline", v_call, j_call, junc_len), id).alias("r"))
    clones = info.select(*keys, F.col("r._germline").alias("germline"), get_gene(F.col(f"r.{v_call}")).alias("v_gene"), get_gene(F.col(f"r.{j_call}")).alias("j_gene"), F.col(f"r.{junc_len}").alias("junc_len"))
    kept = work.select(*dict.fromkeys([*keys, id, seq, *text_fields, *num_fields, *seq_fields]))
    merged = collapse_duplicates(kept, id=id, seq=seq, text_fields=text_fields, num_fields=num_fields, seq_fields=seq_fields, add_count=add_count, fields=keys)
    return Clones(clones, merged.withColumnsRenamed({id: "sequence_id", seq: "sequence"}), clone)


# Distances and parsimony ------------------------------------------------------------------------------------------------
_BITS = {c: sum(1 << "ACGT".index(b) for b in meant) for c, meant in IUPAC_DNA.items()} | {"-": 15, ".": 15, "?": 15}


def _sets(seq: str) -> np.ndarray:
    return np.array([_BITS.get(c, 15) for c in seq.upper()], np.uint8)


def _distance(a: str, b: str) -> int:
    """Positions whose codes share no base (gaps match anything)."""
    return int(((_sets(a) & _sets(b)) == 0).sum())


def _letters(sets: np.ndarray) -> str:
    names = {sum(1 << "ACGT".index(b) for b in meant): c for c, meant in IUPAC_DNA.items()}
    return "".join(names[int(x)] for x in sets)


def _join(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """A node's set from those of its children, and the steps it takes."""
    both = a & b
    none = both == 0
    return np.where(none, a | b, both), int(none.sum())


class _Tree:
    """A rooted binary tree under the germline, by Fitch parsimony."""

    def __init__(self, germline: np.ndarray):
        self.germline, self.kids, self.sets, self.top = germline, {}, {}, None

    def cost(self) -> int:
        total, state = 0, {}
        for x in self._post():
            if x in self.kids:
                a, b = (state[k] for k in self.kids[x])
                both = a & b
                total += int((both == 0).sum())
                state[x] = np.where(both == 0, a | b, both)
            else:
                state[x] = self.sets[x]
        return total + int(((state[self.top] & self.germline) == 0).sum())

    def _post(self) -> list:
        out, stack = [], [self.top]
        while stack:
            x = stack.pop()
            out.append(x)
            stack += self.kids.get(x, ())
        return out[::-1]

    def add(self, name: str, sets: np.ndarray, inner: str) -> None:
        """Adds a tip on the branch where the tree stays cheapest (the first on ties)."""
        self.sets[name] = sets
        if self.top is None:
            self.top = name
            return
        state, steps, above = {}, {}, {}
        for x in self._post():
            state[x] = self.sets.get(x)
            if x in self.kids:
                a, b = self.kids[x]
                state[x], steps[x] = _join(state[a], state[b])
                above[a], above[b] = (x, b), (x, a)
        best = None
        for x in self._post():
            now, more = _join(state[x], sets)  # only the nodes above the branch change, up to one that stays as it was
            at = x
            while at in above:
                at, other = above[at]
                now, n = _join(now, state[other])
                more += n - steps[at]
                if np.array_equal(now, state[at]):
                    break
            else:
                more += int(((now & self.germline) == 0).sum()) - int(((state[self.top] & self.germline) == 0).sum())
            if best is None or more < best[0]:
                best = (more, x)
        self._insert(best[1], name, inner)

    def _insert(self, x: str, name: str, inner: str) -> None:
        parent = next((p for p, k in self.kids.items() if x in k), None)
        self.kids[inner] = [x, name]
        if parent:
            self.kids[parent] = [inner if k == x else k for k in self.kids[parent]]
        else:
            self.top = inner

    def resolve(self) -> tuple[list[tuple[str, str]], dict[str, str]]:
        """Edges from the germline down, and the sequences of the inner nodes."""
        down = {}
        for x in self._post():
            if x in self.kids:
                a, b = (down[k] for k in self.kids[x])
                down[x] = np.where((a & b) == 0, a | b, a & b)
            else:
                down[x] = self.sets[x]
        edges, stack, seqs = [(GERMLINE, self.top)], [(self.top, self.germline)], {}
        while stack:
            x, above = stack.pop()
            if x in self.kids:
                both = down[x] & above
                pick = np.where(both == 0, down[x], both)
                seqs[x] = _letters(pick)
                for k in self.kids[x]:
                    edges.append((x, k))
                    stack.append((k, pick))
        return edges, seqs


def parsimony(germline: str, sequences: dict[str, str]) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Edges ``(parent, child)`` and the sequences of inferred nodes, by stepwise addition with the germline as outgroup."""
    names = sorted(sequences, key=lambda n: (_distance(germline, sequences[n]), n))
    tree = _Tree(_sets(germline))
    for i, n in enumerate(names):
        tree.add(n, _sets(sequences[n]), f"Inferred{i}")
    return tree.resolve()


def finish_edges(edges: list[tuple[str, str]], germline: str, sequences: dict[str, str]) -> list[tuple[str, str, int]]:
    """Weighted edges below the germline, without inferred nodes that equal a child.

    An edge into the germline is turned. While an inferred parent is at distance 0 of a child, the first such parent is
    replaced by that child.
    """
    known = sequences | {GERMLINE: germline}
    out = [[c, p] if c == GERMLINE else [p, c] for p, c in edges]
    while True:
        weights = [_distance(known[p], known[c]) for p, c in out]
        hit = next((i for i, (p, _) in enumerate(out) if weights[i] == 0 and re.fullmatch(r"Inferred\d+", p)), None)
        if hit is None:
            return [(p, c, w) for (p, c), w in zip(out, weights, strict=True)]
        old, new = out[hit]
        out = [[new if x == old else x for x in e] for i, e in enumerate(out) if i != hit]


# PHYLIP text formats ----------------------------------------------------------------------------------------------------
def phylip_input(germline: str, sequences: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The input file, and the ids behind its nine-character names."""
    taxa = {f"SAM{i}": n for i, n in enumerate(sequences, 1)}
    lines = [f"{len(sequences) + 1:<9} {len(germline)}", f"{GERMLINE:<9} {germline}"]
    lines += [f"{t:<9} {sequences[n]}" for t, n in taxa.items()]
    return "\n".join(lines) + "\n", taxa


def phylip_failed(output: str) -> bool:
    return "-1 trees in all found" in output


def phylip_edges(output: str, taxa: dict[str, str]) -> list[tuple[str, str]]:
    """The edge table of a dnapars or dnaml output file, with sequence ids and ``Inferred`` numbers."""
    lines = output.split("\n")
    start = next(i for i, x in enumerate(lines) if re.search(r"[Bb]etween\s+[Aa]nd\s+[Ll]ength", x))
    name = lambda x: f"Inferred{x}" if x.isdigit() else taxa.get(x, x)
    out = []
    for x in lines[start + 1 :]:
        parts = x.split()
        if len(parts) >= 2 and not set(x.strip()) <= set("- ") and re.fullmatch(r"[-\d.eE+]+", parts[2] if len(parts) > 2 else "0"):
            out.append((name(parts[0]), name(parts[1])))
        elif not parts and out:
            break
    return out


def phylip_inferred(output: str) -> dict[str, str]:
    """Sequences of the inferred nodes of a dnapars or dnaml output file."""
    lines = output.split("\n")
    pars = next((i for i, x in enumerate(lines) if re.search(r"From\s+To\s+Any Steps\?\s+State at upper node", x)), None)
    start = pars if pars is not None else next((i for i, x in enumerate(lines) if re.search(r"node\s+Reconstructed sequence", x)), None)
    if start is None:
        raise ValueError("this is no dnapars or dnaml output")
    out: dict[str, str] = {}
    for x in lines[start + 1 :]:
        parts = x.split()
        if pars is not None:
            at = next((i for i, p in enumerate(parts) if p in ("yes", "no", "maybe")), None)
            node, chunk = (parts[at - 1], parts[at + 1 :]) if at else (parts[0], parts[1:]) if parts else ("", [])
        else:
            node, chunk = (parts[0], parts[1:]) if parts else ("", [])
        if node.isdigit() and chunk:
            out[f"Inferred{node}"] = out.get(f"Inferred{node}", "") + "".join(chunk).upper()
    return out


def run_phylip(program: str, germline: str, sequences: dict[str, str], one_tree: bool = False) -> tuple[list[tuple[str, str]], dict[str, str]] | None:
    """Runs dnapars or dnaml in a folder of its own; None if it finds no tree."""
    text, taxa = phylip_input(germline, sequences)
    options = ["S", "Y", "I", "4", "5", "."] if "dnapars" in Path(program).name else ["I", "5"]
    options += (["V", "1"] if one_tree else []) + ["Y"]
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "infile").write_text(text)
        subprocess.run([program], input="\n".join(options) + "\n", text=True, cwd=folder, capture_output=True, check=True)
        output = Path(folder, "outfile").read_text()
    return None if phylip_failed(output) else (phylip_edges(output, taxa), phylip_inferred(output))


def build_lineages(clones: Clones, *, program: str | None = None, one_tree: bool = False, annotations: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of every clone with two sequences or more: ``tree_id`` is the clone.

    ``nodes (tree_id, name, sequence, annotations)``: the germline and inferred nodes have no annotations. ``edges
    (tree_id, parent, child, weight)``: weights are distances between the sequences. With ``program`` (a dnapars or dnaml
    executable on the executors) PHYLIP builds the trees, else Fitch parsimony does, with the same finish; the two need not
    agree where several trees are equally short. One clone is one task's work.
    """
    c = clones.clone
    rows = clones.sequences.join(clones.clones.select(c, "germline"), c).select(F.col(c).cast("string").alias("tree_id"), "sequence_id", "sequence", "germline")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seqs = dict(sorted(zip(pdf["sequence_id"], pdf["sequence"], strict=True)))
        germline = pdf["germline"].iloc[0]
        names = ["tree_id", "parent", "child", "weight", "sequence", "root"]
        if len(set(seqs.values())) < 2:
            return pd.DataFrame(columns=names)
        found = run_phylip(program, germline, seqs, one_tree) if program else parsimony(germline, seqs)
        if found is None:
            return pd.DataFrame(columns=names)
        known = seqs | found[1]
        return pd.DataFrame([(key[0], p, k, float(w), known[k], germline) for p, k, w in finish_edges(found[0], germline, known)], columns=names)

    built = cut_lineage(rows.groupBy("tree_id").applyInPandas(one, "tree_id string, parent string, child string, weight double, sequence string, root string"))
    edges = built.select("tree_id", "parent", "child", "weight")
    nodes = built.select("tree_id", F.col("child").alias("name"), "sequence").union(built.select("tree_id", F.lit(GERMLINE), "root").distinct())
    if annotations:
        notes = clones.sequences.select(F.col(c).cast("string").alias("tree_id"), F.col("sequence_id").alias("name"), *annotations)
        nodes = nodes.join(notes, ["tree_id", "name"], "left")
    return nodes, edges
