"""Pairwise operators: self-joins blocked by group and length, on distinct sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repseq.functions.constants import dna_matrix
from repseq.functions.sequence import DEFAULT_IGNORE, mismatch_count, seq_dist, seq_equal
from repseq.session import tasks


def _pairs(left: DataFrame, right: DataFrame, seq: str, by: Sequence[str], order: Column) -> DataFrame:
    """Pairs within a block: equal ``by`` values (NULL is a value) and equal length.

    Both sides are dealt by block to as many tasks as there are, since the pairs outgrow the sequences by far.
    """
    n = tasks(left.sparkSession)
    block = F.to_json(F.struct(*(F.col(k).cast("string").alias(f"f{i}") for i, k in enumerate(by)))) if by else F.lit("")
    sides = []
    for name, df in (("a", left), ("b", right)):
        side = df.where(F.col(seq).isNotNull()).select(*by, F.col(seq)).distinct().withColumns({"_block": block, "_n": F.length(seq)})
        sides.append(side.repartition(n, "_block", "_n").alias(name))
    cond = (F.col("a._block") == F.col("b._block")) & (F.col("a._n") == F.col("b._n")) & order
    return sides[0].join(sides[1], cond).select(*(F.col(f"a.{k}") for k in by), F.col(f"a.{seq}").alias("seq1"), F.col(f"b.{seq}").alias("seq2"))


def pairwise_dist(df: DataFrame, seq: str, *, by: Sequence[str] = (), matrix: Mapping | None = None) -> DataFrame:
    """``(by, seq1, seq2, dist)`` for every two different sequences of equal length in a block, ``seq1 < seq2``.

    The matrix is symmetric with a zero diagonal, so one triangle says all. Block the join with ``by``: what is compared
    grows with the square of a block's distinct sequences.
    """
    return _pairs(df, df, seq, by, F.col(f"a.{seq}") < F.col(f"b.{seq}")).withColumn("dist", seq_dist("seq1", "seq2", matrix))


def pairwise_equal(df: DataFrame, seq: str, *, by: Sequence[str] = (), ignore: Sequence[str] = DEFAULT_IGNORE) -> DataFrame:
    """``(by, seq1, seq2, equal)`` for every two different sequences of equal length in a block, ``seq1 < seq2``."""
    return _pairs(df, df, seq, by, F.col(f"a.{seq}") < F.col(f"b.{seq}")).withColumn("equal", seq_equal("seq1", "seq2", ignore))


def nonsquare_dist(df: DataFrame, seq: str, subset: Column, *, by: Sequence[str] = (), matrix: Mapping | None = None) -> DataFrame:
    """``(by, seq1, seq2, dist)`` from each sequence of the rows in ``subset`` to every sequence of its block."""
    return _pairs(df.where(subset), df, seq, by, F.lit(True)).withColumn("dist", seq_dist("seq1", "seq2", matrix))


def fast_dist(df: DataFrame, seq: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Distances of sequences over A, C, G, T, N and ``?`` (of either case): length less matches; N matches any base, ``?`` itself.

    Other characters raise an error. Equals ``pairwise_dist`` with a gap distance of 0 on such sequences.
    """
    fine = F.upper(F.col(seq)).rlike("^[ACGTN?]*$")
    bad = F.raise_error(F.lit("Only A, C, G, T, N and ? are allowed.")).cast("string")
    clean = df.where(F.col(seq).isNotNull()).select(*by, F.when(fine, F.upper(seq)).otherwise(bad).alias(seq))
    pairs = _pairs(clean, clean, seq, by, F.col(f"a.{seq}") < F.col(f"b.{seq}"))

    def differs(i: Column) -> Column:
        p, q = F.substring("seq1", i, 1), F.substring("seq2", i, 1)
        return (p != q) & ((p == "?") | (q == "?") | ((p != "N") & (q != "N")))

    return pairs.withColumn("dist", F.size(F.filter(F.sequence(F.lit(1), F.length("seq1")), differs)).cast("double"))


def mismatch_matrix(samples: DataFrame, sample: str, germlines: DataFrame, germline: str, *, ignore: Sequence[str] = ("N", ".", "-")) -> DataFrame:
    """``(sample, germline, mismatches)`` of every distinct sample against every germline.

    The germlines are a reference set of fixed size (alleles of an organism), which is what makes this product feasible.
    """
    a, b = samples.select(F.col(sample).alias("sample")).distinct(), germlines.select(F.col(germline).alias("germline")).distinct()
    return a.crossJoin(b).withColumn("mismatches", mismatch_count("sample", "germline", ignore))


def gap0() -> dict:
    return dna_matrix(gap=0)
