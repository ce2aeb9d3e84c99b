"""Clonal abundance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repseq.operators.usage import _list, _over


def count_clones(
    data: DataFrame, groups: str | Sequence[str] | None = None, *, copy: str | None = None, clone: str = "clone_id", cell_id: str | None = "cell_id", remove_na: bool = True
) -> DataFrame:
    """Sequences (and copies) of each clone with their shares of the group.

    A ``cell_id`` column switches to single-cell counting: a cell counts once per clone and each row without a cell
    counts by itself; copies cannot be counted then. NULL clones are dropped unless ``remove_na=False``.
    """
    groups = _list(groups)
    single = cell_id is not None and cell_id in data.columns
    if single and copy:
        raise ValueError("copy numbers cannot be counted for single cells")
    if remove_na:
        data = data.where(F.col(clone).isNotNull())
    keys = [*groups, clone]
    if single:  # distinct cells, and rows without a cell, by partial aggregation
        cells = data.groupBy(*keys, cell_id).agg(F.count("*").alias("_rows"))
        out = cells.groupBy(*keys).agg(F.sum(F.when(F.col(cell_id).isNull(), F.col("_rows")).otherwise(1)).alias("seq_count"))
    else:
        sums = {"seq_count": F.count("*")} | ({"copy_count": F.sum(copy)} if copy else {})
        out = data.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    out = out.withColumn("seq_freq", F.col("seq_count") / F.sum("seq_count").over(_over(groups)))
    if copy:
        out = out.withColumn("copy_freq", F.col("copy_count") / F.sum("copy_count").over(_over(groups)))
    return out.orderBy(F.desc("copy_count" if copy else "seq_count"))
