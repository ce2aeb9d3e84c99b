"""Running gene and clone counts over a stream of rearrangements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repseq.functions.calls import get_gene
from repseq.operators.usage import _list


def stream_gene_counts(data: DataFrame, gene: str, groups: str | Sequence[str] = (), *, first: bool = True) -> DataFrame:
    """``(groups, locus, gene, seq_count)`` to be written in complete or update mode; state grows with genes, not with rows."""
    keyed = data.where(F.col(gene).isNotNull()).withColumn("gene", get_gene(gene, first=first))
    locus = F.col("locus") if "locus" in data.columns else F.substring("gene", 1, 3)
    return keyed.withColumn("locus", locus).groupBy(*_list(groups), "locus", "gene").agg(F.count("*").alias("seq_count"))


def stream_clone_counts(data: DataFrame, groups: str | Sequence[str] = (), *, clone: str = "clone_id") -> DataFrame:
    """``(groups, clone, seq_count)`` to be written in complete or update mode."""
    return data.where(F.col(clone).isNotNull()).groupBy(*_list(groups), clone).agg(F.count("*").alias("seq_count"))
