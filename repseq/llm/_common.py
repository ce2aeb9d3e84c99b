"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.session import spread

#: Fixed by the query contracts: a word is a run of characters other than space and \t\n\v\f\r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: White space to str.split() but not to WORD.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """The words of a text, as WORD finds them; str.split() is faster where it agrees."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work far larger than reading it: a scan of fewer tasks than cores is dealt to all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; NULL keys count as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The batch's rows as tuples of Python values."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted column name, that name with enough underscores before it to clash with none in ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out
