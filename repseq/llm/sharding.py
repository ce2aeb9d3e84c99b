"""Proportional stratified interleaving: shards that all carry the corpus mixture (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import spare, table


#: Rows of a cell on average; a table has this many cells at least.
CELL_ROWS, CELLS = 65_536, 4096


def _positions(df: DataFrame, keys: list[str], cell: str, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """0-based position of each row among the rows with equal ``keys``, ordered by (``cell``, ``order``).

    Rows are counted per cell, the counts are summed up over the cells, and rows are numbered inside their cell only; so no
    window ever holds a whole key, however hot.
    """
    n, before, row = spare(df, "n", "before", "row")
    counts = df.groupBy(*keys, cell).agg(F.count("*").alias(n))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    up_to = w.orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(up_to), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum(n).over(w))
    inside = F.row_number().over(W.partitionBy(*keys, cell).orderBy(*order))
    return df.withColumn(row, inside).join(counts.drop(n), [*keys, cell]).withColumn(out, F.col(before) + F.col(row) - 1).drop(before, row)


def interleave(
    df: DataFrame, shards: int, *, by: str = "source", key: str = "doc_id", seed: int = 42, cells: int | None = None, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within the shard) to the rows of ``df``.

    Rows of each ``by`` value are shuffled by a seeded hash, ranked, and given the fractional rank (rank - 1/2) / size;
    sorting all rows by that rank spreads every value evenly, and the sorted order is cut into ``shards`` runs whose row
    counts differ by one at most. So each shard holds each value's share of the rows to within one row or so. It depends on
    the rows alone, not on how they are partitioned. Rows with equal texts are rows like others: they may lie in
    different shards.

    The hash is one of ``key`` and all other columns, so rows with equal or NULL keys spread like any; NULL in ``by`` is a
    value of its own; rows alike in every column take neighbouring places of one cell; an empty table gives an empty
    table. Columns of ``df`` named like a result column are replaced, all others come through, whatever their names.

    Both rankings number rows inside hash cells and add the counts of the cells before, so a value with a third of all rows
    is spread over all cells: ``cells`` per value, by default one for ``CELL_ROWS`` rows of the table. Only cell counts meet in one task.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop(shard, slot)
    columns = df.columns
    cells = cells or max(CELLS, df.count() // CELL_ROWS)
    rest = [F.col(c) for c in columns if c != key and df.schema[c].dataType.typeName() not in ("map", "variant")]
    one, hashed, cell, rank, size, at, everything, place, total = spare(df, *(f"_il_{x}" for x in ("by", "hash", "cell", "rank", "size", "at", "all", "pos", "total")))
    df = df.withColumns({one: F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")), hashed: F.xxhash64(F.lit(seed).cast("long"), F.col(key), *rest)})
    df = df.withColumn(cell, F.shiftrightunsigned(hashed, 16) % cells)
    df = _positions(df, [one], cell, [F.col(hashed), F.col(key), *rest], rank, size)
    df = df.withColumn(at, (F.col(rank) + 0.5) / F.col(size))
    df = df.withColumn(cell, F.floor(F.col(at) * cells)).withColumn(everything, F.lit(0))
    df = _positions(df, [everything], cell, [F.col(at), F.col(one), F.col(rank)], place, total)
    df = df.withColumn(shard, F.expr(f"CAST({place} * {shards} DIV {total} AS INT)"))
    first = F.expr(f"({shard} * {total} + {shards} - 1) DIV {shards}")
    return df.withColumn(slot, F.col(place) - first).select(*columns, shard, slot)


SHARDS = 40


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and slot; the law is ``rows`` (row counts at most one apart)."""
    docs = table(spark, sf_dir, "documents")
    digest = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return interleave(digest, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "source")
