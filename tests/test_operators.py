"""Golden values and properties of the table operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from repseq.operators import checks, diversity, pairwise, topology
from repseq.operators.clones import count_clones
from repseq.operators.collapse import collapse_duplicates
from repseq.operators.components import connected_components
from repseq.operators.grouping import group_genes
from repseq.operators.lineage import build_lineages, finish_edges, make_clones, parsimony, phylip_edges, phylip_inferred, phylip_input
from repseq.operators.usage import count_genes


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(500, 500), (7, 7)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, edges[0], (None, 3)], "src long, dst long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_clone_counts(spark):
    toy = [(1, "A", "1", 10), (2, "A", "1", 20), (3, "A", "2", 30), (4, "B", "1", None), (5, "B", None, 7)]
    df = spark.createDataFrame(toy, "id int, sample string, clone_id string, n int")
    got = rows(count_clones(df, "sample", copy="n"), "sample", "clone_id", "seq_count", "copy_count", F.round("seq_freq", 3))
    assert got == [("A", "1", 2, 30, 0.667), ("A", "2", 1, 30, 0.333), ("B", "1", 1, None, 1.0)]
    assert rows(count_clones(df, remove_na=False), "clone_id", "seq_count") == [("1", 3), ("2", 1), (None, 1)]
    cells = df.withColumn("cell_id", F.when(F.col("id") < 3, "c1"))
    assert rows(count_clones(cells, "sample"), "sample", "clone_id", "seq_count") == [("A", "1", 1), ("A", "2", 1), ("B", "1", 1)]
    with pytest.raises(ValueError):
        count_clones(cells, copy="n")


def test_gene_counts(spark):
    df = spark.createDataFrame([("S1", "IGHV1-1*01", "c1"), ("S1", "IGHV1-1*02,IGHV2-1*01", "c1"), ("S1", "IGKV1-1*01", "c2"), ("S2", None, "c3")], "sample string, v_call string, clone_id string")
    got = rows(count_genes(df, "v_call", "sample"), "sample", "locus", "gene", "seq_count", "seq_freq")
    assert got == [("S1", "IGH", "IGHV1-1", 2, 1.0), ("S1", "IGK", "IGKV1-1", 1, 1.0)]
    kept = rows(count_genes(df, "v_call", "sample", remove_na=False), "sample", "locus", "gene", "seq_freq")
    assert ("S2", None, None, 1.0) in kept
    filled = rows(count_genes(df, "v_call", "sample", remove_na=False, fill=True), "sample", "gene", "seq_count")
    assert len(filled) == 6 and ("S2", "IGHV1-1", 0) in filled
    assert rows(count_genes(df, "v_call", clone="clone_id"), "gene", "clone_count") == [("IGHV1-1", 1), ("IGKV1-1", 1)]


def test_checks(spark):
    df = spark.createDataFrame([("IGHM", None, "IGH", "a"), ("IGHG", None, "IGK", "b")], "c string, none string, locus string, cell_id string")
    assert checks.check_columns(df, ["c"]) is True and "no data" in checks.check_columns(df, ["c", "none"]) and "not found" in checks.check_columns(df, ["x"])
    assert checks.check_columns(df, ["x", "c"], "any") is True
    assert rows(df, checks.translate_strings("c", {"M": ["IGHM", "IGHD"]})) == [("IGHG",), ("M",)]
    with pytest.raises(ValueError, match="light without heavy"):
        checks.validate_single_cells(df)


def test_diversity(spark):
    df = spark.createDataFrame([(x,) for x in (1, 1, 3, 10)], "x int")
    got = {r.q: r.d for r in diversity.diversity(df, "x", [0, 1, 2]).collect()}
    assert [got[q] for q in (0, 1, 2)] == pytest.approx([4, 2.594272, 2.027027], rel=1e-3)
    for x in (0.5, 1.0, 3.7, 250.0, 1e6):
        assert df.select(diversity.ln_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    counts = spark.createDataFrame([(f"c{i}", 1 + i % 5 % 3) for i in range(40)], "clone_id string, x int")
    total = diversity.complete_abundance(counts, "clone_id", "x").agg(F.sum("p")).first()[0]
    assert total == pytest.approx(1) and 0 < diversity.coverage(counts, "x").first()[0] < 1
    n = counts.agg(F.sum("x")).first()[0]
    full = diversity.rarefied_diversity(counts, "x", [0], n).first().d
    assert full == pytest.approx(40) and diversity.rarefied_coverage(counts, "x", n).first()[0] == pytest.approx(diversity.coverage(counts, "x").first()[0])
    with pytest.raises(PySparkException):
        diversity.rarefied_coverage(counts, "x", n + 1).collect()
    with pytest.raises(PySparkException):
        diversity.coverage(counts, "x", r=3).collect()
    assert diversity.stouffer_meta([0.5, 0.5]) == pytest.approx((0, 0.5)) and diversity.stouffer_meta([0.1, 0.05, 0.3])[1] == pytest.approx(0.0234, abs=1e-3)


def test_resampling(spark):
    data = spark.createDataFrame([("A" if i % 3 else "B", f"c{(i * i) % 37}") for i in range(900)] + [("C", "c0")] * 5, "sample string, clone_id string")
    with pytest.warns(UserWarning, match="C"):
        curve = diversity.estimate_abundance(data, group="sample", nboot=80)
    sums = curve.bootstrap.select("sample", F.posexplode("boot")).groupBy("sample", "pos").agg(F.sum("col").alias("s")).collect()
    assert len(sums) == 160 and all(r.s == pytest.approx(1) for r in sums)
    truth = {(r.sample, r.clone_id): r.p for r in diversity.complete_abundance(count_clones(data.where("sample != 'C'"), "sample"), "clone_id", "seq_count", "sample").collect()}
    got = {(r.sample, r.clone_id): r.p for r in curve.abundance.collect()}
    assert set(got) == set(truth) and max(abs(got[k] - truth[k]) for k in got) < 0.02
    alpha = diversity.alpha_diversity(curve, step_q=1)
    by = {(r.sample, r.q): r for r in alpha.diversity.collect()}
    assert by["A", 0.0].d >= by["A", 1.0].d >= by["A", 2.0].d and by["B", 0.0].e == pytest.approx(1)
    assert all(0 <= r.pvalue <= 1 for r in alpha.tests.collect())
    again = diversity.estimate_abundance(data.where("sample != 'C'").repartition(3), group="sample", nboot=80)
    assert {(r.sample, r.clone_id): r.p for r in again.abundance.collect()} == pytest.approx(got)


def test_pairwise(spark):
    seqs = ["ACGTNACGT?", "ACGTAACGTA", "TTTTTTTTTT", "ACGNNACGTA", "ACG"]
    df = spark.createDataFrame([(s, "b") for s in [*seqs, seqs[0]]], "s string, b string")
    fast = rows(pairwise.fast_dist(df, "s", by=["b"]), "seq1", "seq2", "dist")
    assert fast == rows(pairwise.pairwise_dist(df, "s", by=["b"], matrix=pairwise.gap0()), "seq1", "seq2", "dist") and len(fast) == 6
    square = pairwise.nonsquare_dist(df, "s", F.col("s") == seqs[2], matrix=pairwise.gap0())
    assert square.count() == 4 and square.where("seq1 = seq2").first().dist == 0
    with pytest.raises(Exception, match="Only A, C, G, T, N"):
        pairwise.fast_dist(df.union(spark.createDataFrame([("AC-T", "b"), ("ACGT", "b")], "s string, b string")), "s").collect()


COLLAPSE = [("A", "CCCCTGGG", "IgM", "S1", 1), ("B", "CCCCTGGN", "IgG", "S1", 2), ("C", "NAACTGGN", "IgG", "S2", 3), ("D", "NNNCTGNN", "IgA", "S2", 4), ("E", "NAACTGNG", "IgG", "S2", 5)]


def test_collapse(spark):
    df = spark.createDataFrame(COLLAPSE, "sequence_id string, sequence_alignment string, type string, sample string, n int")
    got = rows(collapse_duplicates(df, text_fields=["type", "sample"], num_fields=["n"], add_count=True), "sequence_id", "type", "sample", "n", "collapse_count")
    assert got == [("A", "IgG,IgM", "S1", 3, 2), ("C", "IgG", "S2", 8, 2)]
    dry = rows(collapse_duplicates(df, dry=True), "sequence_id", "collapse_id", "collapse_class", "collapse_pass")
    assert dry == [("A", "1", "duplicated", True), ("B", "1", "duplicated", False), ("C", "2", "duplicated", True), ("D", "1,2", "ambiguous", False), ("E", "2", "duplicated", False)]
    once = collapse_duplicates(df)
    assert rows(collapse_duplicates(once), "sequence_id") == rows(once, "sequence_id")
    chain = spark.createDataFrame([("A", "ANN"), ("B", "NNT"), ("C", "CNT")], "sequence_id string, sequence_alignment string")
    assert rows(collapse_duplicates(chain), "sequence_id") == [("A",), ("C",)]
    ring = spark.createDataFrame([("A", "AN"), ("B", "NC"), ("C", "GN"), ("D", "NT")], "sequence_id string, sequence_alignment string")
    assert rows(collapse_duplicates(ring), "sequence_id") == [("A",)]  # all are ambiguous, and one connected set
    assert rows(collapse_duplicates(ring, dry=True), "sequence_id", "collapse_id", "collapse_class", "collapse_pass") == [("A", "1", "ambiguous", True), *((x, "1", "ambiguous", False) for x in "BCD")]
    with pytest.warns(UserWarning, match="colour"):
        collapse_duplicates(df, fields=["sample", "colour"])


def test_group_genes(spark):
    v = ["IGHV1-1", "IGHV1-1,IGHV1-2", "IGHV1-2,IGHV1-3", "IGHV1-2", "IGHV1-3", "IGHV1-3", "IGHV1-1,IGHV1-2", "IGHV1-2"]
    j = [f"IGHJ{k}" for k in (1, 2, 1, 1, 1, 2, 1, 2)]
    df = spark.createDataFrame([(i, a, b, "IGH") for i, (a, b) in enumerate(zip(v, j, strict=True))], "i int, v_call string, j_call string, locus string")
    assert [r.vj_group for r in group_genes(df).orderBy("i").collect()] == ["G1", "G2", "G1", "G1", "G1", "G3", "G1", "G2"]
    v = ["IGHV1-1*01", "IGHV1-1*01", "IGHV1-2*01", "IGHV1-1*01,IGHV1-2*01", "IGHV1-2*01", "IGKV1-1*01", "IGKV1-1*01", "IGKV1-1*01"]
    mixed = [(i, a, f"{a[:3]}J{2 if i == 0 else 1}*01", a[:3], c) for i, (a, c) in enumerate(zip(v, ("1", "2", "3", None, None, "1", None, "4"), strict=True))]
    mixed = spark.createDataFrame(mixed, "i int, v_call string, j_call string, locus string, cell_id string")
    assert [r.vj_group for r in group_genes(mixed, cell_id="cell_id").orderBy("i").collect()] == ["G2", "G1", "G1", "G1", "G1", "G2", None, None]
    with pytest.raises(ValueError, match="several heavy"):
        group_genes(mixed.withColumn("cell_id", F.lit("1")), cell_id="cell_id")


def test_make_clones_and_lineages(spark):
    data = [("A", "CCCCTGGG", "IgM", 1), ("B", "CCCCTGGN", "IgG", 2), ("C", "NAACTGGN", "IgG", 3), ("D", "NNNCTGNN", "IgA", 4)]
    df = spark.createDataFrame([(*r, "Homsap IGKV1-39*01 F", "Homsap IGKJ5*01 F", 2, "CCCCAGGG", "1", "IGH") for r in data], "sequence_id string, sequence_alignment string, type string, n int, v_call string, j_call string, junction_length int, germline_alignment string, clone_id string, locus string")
    how = {"text_fields": ["type"], "num_fields": ["n"]}
    made = make_clones(df, **how)
    assert rows(made.clones, "clone_id", "germline", "v_gene", "j_gene", "junc_len") == [("1", "CCCCAGGG", "IGKV1-39", "IGKJ5", 2)]
    assert rows(made.sequences, "sequence_id", "sequence", "type", "n", "collapse_count") == [("A", "CCCCTGGG", "IgG,IgM", 3, 2), ("C", "NAACTGGN", "IgG", 3, 1)]
    padded = make_clones(df, pad_end=True, **how)
    assert padded.clones.first().germline == "CCCCAGGGN" and rows(padded.sequences, "sequence") == [("CCCCTGGGN",), ("NAACTGGNN",)]
    masked = make_clones(df, max_mask=3, **how)
    assert rows(masked.sequences, "sequence_id", "sequence", "type", "n", "collapse_count") == [("A", "NNNCTGNN", "IgA,IgG,IgM", 10, 4)]
    with pytest.raises(ValueError):
        make_clones(df.withColumn("locus", F.lit("IGK")))
    nodes, edges = build_lineages(made, annotations=["type"])
    assert {r.name for r in nodes.collect()} >= {"Germline", "A", "C"} and edges.where("child = 'Germline'").count() == 0
    assert build_lineages(masked)[1].count() == 0  # one sequence is no lineage


def test_parsimony():
    germline = "AAAAAAAAAA"
    seqs = {"x": "CAAAAAAAAA", "y": "CCAAAAAAAA", "z": "CCTAAAAAAA", "w": "AAAAAAAAGG"}
    edges, inferred = parsimony(germline, seqs)
    tree = finish_edges(edges, germline, seqs | inferred)
    assert sum(w for *_, w in tree) == 5 and {c for _, c, _ in tree} >= set(seqs)
    below = {c: p for p, c, _ in tree}
    for n in seqs:  # every node hangs below the germline
        while n != "Germline":
            n = below[n]
    text, taxa = phylip_input(germline, seqs)
    assert text.startswith("5         10\nGermline  AAAAAAAAAA\nSAM1      CAAA") and taxa["SAM1"] == "x"


def test_phylip_output():
    output = "\nbetween      and       length\n-------      ---       ------\n   1           SAM1             0.100000\n   1           Germline         0.2\n\n\nFrom    To     Any Steps?    State at upper node\n\n          1                ACGT AC\n   1    SAM1       yes     ..T. ..\n\n          1                GG\n"
    assert phylip_edges(output, {"SAM1": "seq"}) == [("Inferred1", "seq"), ("Inferred1", "Germline")]
    assert phylip_inferred(output) == {"Inferred1": "ACGTACGG"}


def _tree(spark):
    notes = {"Germline": None, "A": "IGHA", "B": "IGHA,IGHG", "l1": "IGHG", "l2": "IGHG", "l3": "IGHG", "l4": "IGHA"}
    edges = [("Germline", "A", 20.0), ("A", "B", 3.0), ("B", "l1", 7.0), ("B", "l2", 1.0), ("B", "l3", 2.0), ("B", "l4", 0.0)]
    return spark.createDataFrame([(1, n, a) for n, a in notes.items()], "tree_id int, name string, iso string"), spark.createDataFrame([(1, *e) for e in edges], "tree_id int, parent string, child string, weight double")


def test_topology(spark):
    nodes, edges = _tree(spark)
    got = {r.name: (r.size, r.depth, r.pathlength, r.outdegree) for r in topology.summarize_subtrees(nodes, edges, ["iso"]).collect()}
    assert [got[n] for n in ("Germline", "A", "B", "l1")] == [(7, 4, 30, 1), (6, 3, 10, 1), (5, 2, 7, 4), (1, 1, 0, 0)]
    counts = rows(topology.table_edges(nodes, edges, "iso"), "parent", "child", "count")
    assert counts == sorted([("IGHA", "IGHA,IGHG", 1), ("IGHA,IGHG", "IGHA", 1), ("IGHA,IGHG", "IGHG", 3), (None, "IGHA", 1)], key=str)
    through = rows(topology.table_edges(nodes, edges, "iso", indirect=True, exclude=[None, "IGHA,IGHG"]), "parent", "child", "count")
    assert through == [("IGHA", "IGHA", 1), ("IGHA", "IGHG", 3)]
    assert rows(topology.table_edges(nodes, edges, "iso", indirect=True, exclude=["nothing"]), "parent", "child", "count") == counts
    far = {r.name: (r.steps, r.distance) for r in topology.path_lengths(nodes, edges, field="iso", exclude=["IGHA,IGHG"]).collect()}
    assert far["Germline"] == (0, 0) and far["A"] == (1, 20) and far["B"] == (1, 23) and far["l1"] == (2, 30)
    assert rows(topology.mrca(nodes, edges, field="iso", exclude=[None, "IGHA"]), "name", "distance") == [("B", 23.0)]
    shuffled = topology.permute_labels(nodes, "iso", nperm=5)
    want = sorted(r.iso for r in nodes.where("iso IS NOT NULL").collect())
    for i in range(1, 6):
        assert sorted(r.iso for r in shuffled.where(f"iter = {i}").collect()) == want
    tests, perms = topology.edge_test(nodes, edges, "iso", nperm=20)
    assert all(r.pvalue is None or 0 <= r.pvalue <= 1 for r in tests.collect()) and perms.agg(F.sum("count")).first()[0] == 20 * 5


def _grown(spark, n=60):
    """Two trees with labels of two kinds, one with several nearest nodes, and nodes without a label."""
    names = ["Germline", *(f"n{i}" for i in range(1, n))]
    nodes = [(t, x, None if i % 7 == t else "ABC"[i * i % 3]) for t in (1, 2) for i, x in enumerate(names)]
    edges = [(t, names[(i - 1) // 2], x, float(1 + (i % 5) * (t - 1))) for t in (1, 2) for i, x in enumerate(names) if i]
    return spark.createDataFrame(nodes, "tree_id int, name string, iso string"), spark.createDataFrame(edges, "tree_id int, parent string, child string, weight double")


def _no_rounds_as_rows(df):
    assert "sequence(1, 20" not in df._jdf.queryExecution().analyzed().toString()


def test_mrca_rounds(spark, monkeypatch):
    """The rounds' labels are never rows, and are those of permute_labels, however many tasks share a tree."""
    monkeypatch.setattr(topology, "DRAWN", 300)
    nodes, edges = _grown(spark)
    tests, perms = topology.mrca_test(nodes, edges, "iso", nperm=20)
    _no_rounds_as_rows(tests)
    near = topology.mrca(nodes, edges, field="iso", exclude=(None,)).select("tree_id", "name")
    label = topology.permute_labels(nodes, "iso", nperm=20).join(near, ["tree_id", "name"]).groupBy("iter", "tree_id").agg(F.collect_set("iso").alias("some"))
    want = label.where("size(some) = 1").groupBy("iter", F.col("some")[0].alias("annotation")).agg(F.count("*").alias("count"))
    assert rows(perms, "iter", "annotation", "count") == rows(want, "iter", "annotation", "count") and want.count() > 9


def test_histogram_draws_once(spark):
    """The rounds are drawn once, though the histogram reads them for its span and for its bins."""
    nodes, edges = _grown(spark)
    bins = topology.permutation_histogram(topology.mrca_test(nodes, edges, "iso", nperm=20)[1], ["annotation"], bins=3)
    _no_rounds_as_rows(bins)
    assert "FlatMapCoGroups" not in bins._jdf.queryExecution().optimizedPlan().toString()
    assert {r.annotation for r in bins.collect()} <= set("ABC") and bins.agg(F.sum("rounds")).first()[0] > 9


def _edge_rounds(spark, monkeypatch, indirect):
    monkeypatch.setattr(topology, "DRAWN", 300)
    nodes, edges = _grown(spark)
    tests, perms = topology.edge_test(nodes, edges, "iso", indirect=indirect, nperm=20)
    _no_rounds_as_rows(tests)
    pairs = topology._edge_pairs(nodes, edges, "iso", indirect, (None,)).collect()
    want = {}
    for i in range(1, 21):
        label = {(r.tree_id, r.name): r.iso for r in topology.permute_labels(nodes, "iso", nperm=20).where(f"iter = {i}").collect()} if i in (1, 20) else {}
        for r in pairs if label else []:
            k = (i, label[r.tree_id, r.parent], label[r.tree_id, r.child])
            want[k] = want.get(k, 0) + 1
    got = {(r.iter, r.parent, r.child): r["count"] for r in perms.collect()}
    assert {k: v for k, v in got.items() if k[0] in (1, 20)} == want and sum(got.values()) == 20 * len(pairs)


def test_edge_rounds(spark, monkeypatch):
    """The rounds' labels are never rows, and are those of permute_labels."""
    _edge_rounds(spark, monkeypatch, False)


def test_edge_rounds_indirect(spark, monkeypatch):
    _edge_rounds(spark, monkeypatch, True)


def test_sums_in_any_order(spark):
    """The same rows in another order and in other partitions give the same numbers, to the last bit."""
    counts = spark.range(20_000).select(F.lit("a").alias("g"), F.concat(F.lit("c"), "id").alias("clone"), (1 + F.col("id") % 23 * (F.col("id") % 7)).alias("x"))
    some = [counts.repartition(n, F.hash("clone", F.lit(n))).sortWithinPartitions(F.hash(F.lit(n), "clone")) for n in (1, 3, 5, 8)]
    adjusted = [{r.clone: r.p for r in diversity.adjusted_abundance(c, "clone", "x", "g").collect()} for c in some]
    assert all(a == adjusted[0] for a in adjusted)
    hill = [rows(diversity.diversity(c.withColumn("p", F.col("x") / 977), "p", [0.5, 1, 2, 3], "g"), "q", "d") for c in some]
    assert all(h == hill[0] for h in hill)


def test_abundance_without_rare_clones(spark):
    """No clone of one count leaves nothing to take away, however large the clones are."""
    large = spark.createDataFrame([("a", "c1", 2000), ("a", "c2", 6000)], "g string, clone string, x long")
    assert rows(diversity.adjusted_abundance(large, "clone", "x", "g"), "clone", "p") == [("c1", 0.25), ("c2", 0.75)]


def test_parsimony_of_a_large_clone():
    """Eighty sequences get inferred ancestors, and every one is placed where the whole tree is cheapest."""
    import numpy as np

    from repseq.operators.lineage import _sets, _Tree

    rng = np.random.default_rng(3)
    germline = "".join(rng.choice(list("ACGT"), 40))
    seqs = {}
    for i in range(80):
        base = list(germline if not i else seqs[f"s{rng.integers(i):02}"])
        base[rng.integers(40)] = rng.choice(list("ACGT"))
        seqs[f"s{i:02}"] = "".join(base)
    edges, inferred = parsimony(germline, seqs)
    assert len(inferred) == 79 and {c for _, c in edges} == seqs.keys() | inferred.keys()
    tree = _Tree(_sets(germline))
    for i, n in enumerate(list(seqs)[:12]):
        every = []
        for x in tree._post() if tree.top else ():
            other = _Tree(tree.germline)
            other.kids, other.sets, other.top = {k: list(v) for k, v in tree.kids.items()}, tree.sets | {n: _sets(seqs[n])}, tree.top
            other._insert(x, n, f"Inferred{i}")
            every.append(other.cost())
        tree.add(n, _sets(seqs[n]), f"Inferred{i}")
        assert tree.cost() == min(every, default=tree.cost())
