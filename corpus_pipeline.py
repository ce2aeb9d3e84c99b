"""The corpus pipeline: quality rules, language ID, near-duplicate removal, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; its result is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from repseq.llm.langid import langid_stage
from repseq.llm.mixing import mixing_stage
from repseq.llm.packing import packing_stage
from repseq.llm.quality import quality_stage
from repseq.llm.simhash import dedup_stage
from repseq.session import shared_dir

STAGES = [
    ("quality", quality_stage),
    ("language", langid_stage),
    ("near_duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the suffix array nor the language model, so the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, with every stage's result in the folder that the cluster shares.

    A stage's result is removed once the next one is written; the last one stays, as the returned rows are read from it.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
