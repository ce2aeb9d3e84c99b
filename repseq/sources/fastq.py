"""FASTQ files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.operators.quality import sequence_alignment_quality


def read_fastq(spark: SparkSession, path: str, *, quality_offset: int = -33, header: str = "piped") -> DataFrame:
    """``(sequence_id, sequence, quality, quality_num)`` of each four-line record.

    Records are counted by lines (an ``@`` may start a quality line). A file is read in splits: lines are counted per split,
    a prefix sum over the splits gives each line its number, and four lines meet by record number. With the ``piped``
    header the id ends at the first ``|``. Empty lines after the last record are no record; a record that is cut off, or
    that does not start with ``@``, is an error.
    """
    if header not in ("piped", "asis"):
        raise ValueError("header must be piped or asis")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.col("at") - F.col("first") + F.col("before")  # a split's lines have consecutive numbers
    lines = lines.join(splits.select("file", "start", "first", before.alias("before")), ["file", "start"]).select("file", number.alias("number"), "value")
    part = lambda i: F.max(F.when(F.col("number") % 4 == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("number") / 4).alias("record")).agg(*(part(i).alias(x) for i, x in enumerate(("name", "sequence", "plus", "quality"))), F.max(F.length(F.trim("value"))).alias("most"))
    name = F.when(F.col("quality").isNull() | ~F.startswith("name", F.lit("@")), F.raise_error(F.concat(F.lit("broken FASTQ record in "), "file")).cast("string")).otherwise(F.trim(F.substring("name", 2, 1 << 30)))
    quality = F.rtrim(F.col("quality"))
    codes = F.when(F.length(quality) > 0, F.array_join(F.transform(F.split(quality, ""), lambda c: (F.ascii(c) + quality_offset).cast("string")), ",")).otherwise("")
    return records.where("most > 0").select((F.substring_index(name, "|", 1) if header == "piped" else name).alias("sequence_id"), F.trim("sequence").alias("sequence"), quality.alias("quality"), codes.alias("quality_num"))


def read_fastq_db(data: DataFrame, path: str, *, quality_offset: int = -33, header: str = "piped", style: str = "both", quality_sequence: bool = False, **columns: str) -> DataFrame:
    """Adds alignment qualities from FASTQ files to the rearrangements with the same id.

    ``style``: ``num`` keeps the numbers, ``phred`` (or ``ascii``) the characters, ``both`` both; ``quality_sequence`` keeps
    the qualities of the whole read as well.
    """
    if style not in ("num", "phred", "ascii", "both"):
        raise ValueError("style must be num, phred, ascii or both")
    key = columns.get("sequence_id", "sequence_id")
    reads = read_fastq(data.sparkSession, path, quality_offset=quality_offset, header=header).select(F.col("sequence_id").alias(key), "quality", "quality_num")
    out = sequence_alignment_quality(data.join(reads, key, "left"), **columns)
    drop = [] if quality_sequence else ["quality", "quality_num"]
    drop += ["quality_alignment"] if style == "num" else ["quality_alignment_num"] if style in ("phred", "ascii") else []
    return out.drop(*drop)
