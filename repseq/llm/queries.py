"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repseq.llm.ann import op10_ann
from repseq.llm.html import op6_html
from repseq.llm.langid import op2_langid
from repseq.llm.mixing import op4_mixing
from repseq.llm.packing import op9_packing
from repseq.llm.quality import op1_quality
from repseq.llm.sharding import op8_sharding
from repseq.llm.simhash import op3_simhash
from repseq.llm.toxicity import op7_toxicity
from repseq.llm.warc import ORACLE as WARC_SQL
from repseq.llm.warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_langid, op3_simhash, op4_mixing, op5_warc, op6_html, op7_toxicity, op8_sharding, op9_packing, op10_ann)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": WARC_SQL}
