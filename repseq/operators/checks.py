"""Column checks, string translation and single-cell validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repseq.functions.calls import is_heavy, is_light


def check_columns(data: DataFrame, columns: Sequence[str], logic: str = "all") -> bool | str:
    """True if ``all`` (or ``any``) of the columns exist and hold a value; else what is wrong. One aggregation for all."""
    have = [c for c in columns if c in data.columns]
    counts = data.agg(*(F.count(c).alias(c) for c in have)).first().asDict() if have else {}
    wrong = [f"The column {c} was not found" if c not in have else f"The column {c} contains no data" for c in columns if not counts.get(c)]
    if logic == "any":
        return True if len(wrong) < len(columns) else "Input must contain at least one of the columns: " + ", ".join(columns)
    return wrong[0] if wrong else True


def translate_strings(strings: str | Column, translation: Mapping[str, str | Sequence[str]]) -> Column:
    """Whole strings that match one of a name's patterns become that name, name by name in order."""
    out = F.col(strings) if isinstance(strings, str) else strings
    for name, patterns in translation.items():
        several = [patterns] if isinstance(patterns, str) else list(patterns)
        out = F.regexp_replace(out, f"^({'|'.join(several)})$", name)
    return out


def single_cell_violations(data: DataFrame, locus: str = "locus", cell_id: str = "cell_id") -> DataFrame:
    """Cells that break the single-cell rules: ``cell_id, problem`` (several heavy chains, or a light one without a heavy)."""
    per = data.where(F.col(cell_id).isNotNull()).groupBy(cell_id).agg(F.count_if(is_heavy(locus)).alias("heavy"), F.count_if(is_light(locus)).alias("light"))
    problem = F.when(F.col("heavy") > 1, "multiple heavy").when((F.col("heavy") == 0) & (F.col("light") > 0), "light without heavy")
    return per.withColumn("problem", problem).where("problem IS NOT NULL").select(cell_id, "problem")


def validate_single_cells(data: DataFrame, locus: str = "locus", cell_id: str = "cell_id") -> None:
    """Raises if a cell has several heavy chains or a light chain without a heavy one."""
    found = single_cell_violations(data, locus, cell_id).limit(1).collect()
    if found:
        raise ValueError(f"cell {found[0][0]}: {found[0][1]}")


def cpu_count(spark) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
