"""Files: tables, FASTQ, trees; and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from repseq.operators.quality import aligned_positions, mask_by_quality, position_quality, sequence_alignment_quality
from repseq.sources import fastq, tables, trees
from repseq.streaming.counts import stream_clone_counts, stream_gene_counts


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "acgt", True, 3, 0.5), ("b", None, None, None, None)], "SEQUENCE_ID string, JUNCTION string, FUNCTIONAL boolean, DUPCOUNT long, V_SCORE double")
    tables.write_legacy(df, f"{tmp_path}/c")
    back = tables.read_legacy(spark, f"{tmp_path}/c")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == [("a", "ACGT", True, 3, 0.5), ("b", None, None, None, None)]
    some = tables.read_legacy(spark, f"{tmp_path}/c", select=["SEQUENCE_ID", "JUNCTION", "DUPCOUNT"], drop=["DUPCOUNT"], seq_upper=False)
    assert some.columns == ["SEQUENCE_ID", "JUNCTION"] and some.where("SEQUENCE_ID = 'a'").first().JUNCTION == "acgt"
    airr = df.toDF("sequence_id", "junction", "productive", "duplicate_count", "v_score")
    tables.write_airr(airr, f"{tmp_path}/a")
    assert sorted(map(tuple, tables.read_airr(spark, f"{tmp_path}/a").collect())) == sorted(map(tuple, airr.collect()))
    with pytest.warns(UserWarning, match="AIRR"):
        tables.read_legacy(spark, f"{tmp_path}/a")


def test_cigar():
    assert aligned_positions(["5S2N3=1I2X1D2=4S"]) == [6, 7, 8, 9, 10, 12, 13]
    assert aligned_positions([]) == []


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r1|PRCONS=x\nACGTAC\n+\n@@I!IJ\n@r2\nAC\n+r2\nII\n")
    reads = {r.sequence_id: r for r in fastq.read_fastq(spark, f"{tmp_path}/r.fastq").collect()}
    assert reads["r1"].quality == "@@I!IJ" and reads["r1"].quality_num == "31,31,40,0,40,41" and set(reads) == {"r1", "r2"}
    schema = "sequence_id string, sequence string, sequence_alignment string, v_cigar string, d_cigar string, j_cigar string, np1_length int, np2_length int, v_sequence_end int, d_sequence_end int"
    db = spark.createDataFrame([("r1", "ACGTAC", "CG.T-C", "1S2=", None, "5S1=", 1, None, 3, None), ("r9", "A", "A", "1=", None, None, None, None, None, None)], schema)
    got = {r.sequence_id: r for r in fastq.read_fastq_db(db, f"{tmp_path}/r.fastq").collect()}
    assert got["r1"].quality_alignment_num == "31,40,NA,0,NA,41" and got["r1"].quality_alignment == "@I ! J" and got["r9"].quality_alignment is None
    assert "quality" not in got["r1"].asDict() and "quality_alignment" not in fastq.read_fastq_db(db, f"{tmp_path}/r.fastq", style="num").columns
    raw = sequence_alignment_quality(db.join(fastq.read_fastq(spark, f"{tmp_path}/r.fastq").drop("sequence"), "sequence_id"), raw=True)
    assert [tuple(r)[:2] for r in raw.orderBy("sequence_position").collect()] == [(2, 1), (3, 2), (4, 4), (6, 6)]
    with pytest.raises(ValueError):
        fastq.read_fastq_db(db, f"{tmp_path}/r.fastq", style="loud")


def test_fastq_splits_and_broken_records(spark, tmp_path):
    """A file read in many splits gives each record once, in whatever split its lines lie; a cut-off record is an error."""
    (tmp_path / "a.fastq").write_text("".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@I!J' * (i % 7 + 1)}\n" for i in range(3000)) + "\n\n")
    (tmp_path / "b.fastq").write_text("@x\nAC\n+\nII\n@y\nAC\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        reads = fastq.read_fastq(spark, f"{tmp_path}/a.fastq")
        assert spark.read.text(f"{tmp_path}/a.fastq").rdd.getNumPartitions() > 5
        got = {r.sequence_id: (r.sequence, r.quality) for r in reads.collect()}
        assert got == {f"r{i}": ("ACGT" * (i % 7 + 1), "@I!J" * (i % 7 + 1)) for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="broken FASTQ record"):
        fastq.read_fastq(spark, f"{tmp_path}/b.fastq").collect()


def test_position_quality(spark):
    df = spark.createDataFrame([("a", "AC-T", "90,60,NA,80"), ("b", "AC", "90,90"), ("c", None, None)], "sequence_id string, sequence_alignment string, quality_alignment_num string")
    assert position_quality(df).count() == 6 and position_quality(df).where("quality IS NULL").first().nt == "-"
    assert {r.sequence_id: r.sequence_alignment_masked for r in mask_by_quality(df).collect()} == {"a": "AN-T", "b": None, "c": None}
    with pytest.raises(Exception, match="differ in length"):
        position_quality(df.withColumn("quality_alignment_num", F.lit("1"))).collect()


TREE = "((a:0.1,b:0.2)n1:0.05,(c:0.3,d:0.00001)n2:0.00002,1_GERM:0.0)r;"


def test_newick():
    root = trees.parse_newick("(('a b':1,c:2)x:0.5,d:3)r;")
    assert [n.name for n in trees.walk(root)] == ["r", "x", "a b", "c", "d"] and root.children[0].length == 0.5
    assert trees.to_newick(trees.parse_newick("((a:1,c:2)x:0.5,d:3)r;")) == "((a:1,c:2)x:0.5,d:3)r;"
    with pytest.raises(ValueError):
        trees.parse_newick("((a,b)")
    flat = trees.collapse_short(trees.parse_newick("((a:1,b:1)x:0.01,c:1)r;"), 0.1)
    assert sorted((n.name, round(n.length, 2)) for n in flat.tips()) == [("a", 1.01), ("b", 1.01), ("c", 1.0)]


def test_reroot_keeps_path_lengths():
    def far(root):
        up, out = {}, {}
        for x in trees.walk(root):
            for c in x.children:
                up[id(c)] = (x, c.length)
        for t in root.tips():
            path, x, d = {id(t): 0.0}, t, 0.0
            while id(x) in up:
                x, step = up[id(x)]
                d += step
                path[id(x)] = d
            out[t.name] = path
        return {(a, b): min(out[a][k] + out[b][k] for k in out[a].keys() & out[b].keys()) for a in out for b in out if a < b}

    text = "((a:1,(b:2,g:0.5)y:1.5)x:0.25,c:3)r;"
    before, root = far(trees.parse_newick(text)), trees.reroot_germline(trees.parse_newick(text), "g")
    assert far(root) == pytest.approx(before) and any(c.name == "g" and c.length == 0 for c in root.children)


def test_codon_trees(spark, tmp_path):
    head = "CLONE\tNSEQ\tNSITE\tTREE_LENGTH\tLHOOD\tKAPPA_MLE\tTREE\n"
    body = "REPERTOIRE\t4\t100\t1.5\t-20\t2.0\tprogram --run\n1\t4\t100\t1.5\t-20\tNA\t" + "((a:0.1,b:0.2)n1:0.05,1_GERM:0.0)r;\n"
    (tmp_path / "t.tab").write_text(head + body)
    run = trees.read_codon_trees(spark, f"{tmp_path}/t.tab", id="run1")
    assert run.command == "program --run" and run.params.count() == 2
    assert sorted((r.parent, r.child, r.weight) for r in run.edges.collect()) == [("1_GERM", "n1", 5.0), ("n1", "a", 10.0), ("n1", "b", 20.0)]
    phylo = trees.read_codon_trees(spark, f"{tmp_path}/t.tab", format="phylo", branches="distance").edges
    assert phylo.where("parent = '0'").count() == 1 and phylo.count() == 5
    wide = trees.combine_codon_runs([run, trees.read_codon_trees(spark, f"{tmp_path}/t.tab", id="run2")])
    assert wide.columns == ["id", "nseq", "nsite", "lhood", "tree_length", "kappa_mle"] and wide.count() == 2
    assert trees.combine_codon_runs([run], "long").count() == 5
    with pytest.raises(ValueError, match="id"):
        trees.combine_codon_runs([trees.read_codon_trees(spark, f"{tmp_path}/t.tab")])


def test_phylo_and_back(spark):
    edges = spark.createDataFrame([(1, "Germline", "x", 2.0), (1, "x", "y", 1.0), (1, "x", "z", 3.0)], "tree_id int, parent string, child string, weight double")
    phylo = trees.graph_to_phylo(edges)
    assert {r.name for r in phylo.collect()} == {"Germline", "Germline_UCA", "x", "y", "z"}
    assert sorted(map(tuple, trees.phylo_to_graph(phylo).collect())) == sorted(map(tuple, edges.collect()))


def test_streams(spark, tmp_path):
    schema = "v_call string, clone_id string, sample string"
    spark.createDataFrame([("IGHV1-1*01", "a", "s"), ("IGHV1-1*02", "b", "s"), (None, "b", "s")], schema).write.parquet(f"{tmp_path}/in")
    for name, make, want in (("genes", lambda d: stream_gene_counts(d, "v_call", "sample"), [("s", "IGH", "IGHV1-1", 2)]), ("clones", lambda d: stream_clone_counts(d, "sample"), [("s", "a", 1), ("s", "b", 2)])):
        query = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == want
