from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from repseq.llm import sharding as H


def check(out, shards: int) -> None:
    sizes = out.groupby("shard").size()
    n = len(out)
    assert set(sizes.index) == set(range(shards)) if n >= shards else len(sizes) == n
    assert sizes.max() - sizes.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for _, g in out.groupby(out["source"].fillna("?none")):
        per = g.groupby("shard").size().reindex(range(shards), fill_value=0)
        assert per.max() - len(g) / shards <= 2 and len(g) / shards - per.min() <= 2


@pytest.mark.parametrize("parts", [1, 7])
def test_interleave(spark, parts):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}" if i % 2 else None, "keep") for i in range(3000)] + [(5, "hot", "keep")] * 4 + [(None, "hot", "keep")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(parts)
    out = H.interleave(df, 16, cells=64).toPandas()
    assert len(out) == len(rows)
    check(out, 16)
    again = H.interleave(df.repartition(3), 16, cells=64).toPandas()
    key = ["doc_id", "source", "shard", "slot"]
    assert sorted(map(str, out[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert H.interleave(df, 40).select("shard", "slot").first() == (0, 0)
    assert H.interleave(df.limit(0), 40).count() == 0
    with pytest.raises(ValueError):
        H.interleave(df, 0)


def test_query(spark, small):
    out = H.op8_sharding(spark, small)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = out.toPandas()
    check(got, 40)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(zlib.crc32(texts[r.doc_id]) == r.text_crc32 and len(texts[r.doc_id]) + 16 == r.size for r in got.itertuples())
    nulls = out.select(F.count("grown_shard"), F.count_if(F.col("law") != "rows")).first()
    assert tuple(nulls) == (0, 0)


def test_query_against_plain_rank_and_cut(spark, small):
    """Shard and slot of every document by sorting lists: ranks within sources, then all by fractional rank, then a cut."""
    out = H.op8_sharding(spark, small).toPandas()
    hashed = F.xxhash64(F.lit(42).cast("long"), "doc_id", "source", "size", "text_crc32")
    rows = [tuple(r) for r in spark.createDataFrame(out[["doc_id", "source", "size", "text_crc32"]], "doc_id long, source string, size long, text_crc32 long").select("doc_id", "source", hashed.alias("h")).collect()]
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    cell = lambda h: ((h % 2**64) >> 16) % 4096
    ranked = []
    for source, group in by.items():
        for rank, r in enumerate(sorted(group, key=lambda r: (cell(r[2]), r[2], r[0]))):
            ranked.append(((rank + 0.5) / len(group), "=" + source if source is not None else "", rank, r[0]))
    want = {}
    n = len(ranked)
    for place, (_, _, _, doc) in enumerate(sorted(ranked)):
        shard = place * 40 // n
        want[doc] = (shard, place - (shard * n + 39) // 40)
    assert {r.doc_id: (r.shard, r.slot) for r in out.itertuples()} == want


def test_columns_of_any_name_and_hot_keys(spark):
    rows = [(None if i % 3 == 0 else 7, "hot", i, "b", "c", i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _before int, _row string, _n string, _il_hash int")
    out = H.interleave(df, 8, cells=64)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.toPandas()
    check(got, 8)
    assert sorted(got["_before"]) == list(range(2000)) and set(got["_row"]) == {"b"}
