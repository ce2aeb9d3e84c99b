from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as C
from repseq.llm import quality as Q
from repseq.session import BATCH, small_batches


def test_stages(spark, small, tmp_path):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, columns, seen = [n for n, _ in C.STAGES], docs.columns, [docs.toPandas()]
    for name, stage in C.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.toPandas())
        assert name == names[-1] or docs.columns == columns
    start, good, found, single, mixed, packed = seen

    def kept(text):
        n_words, _, _, _, again = Q.base_counts(text)
        covered, longest, size = Q.repetition(text, 50)
        return n_words >= 50 and 100 * again <= 50 * n_words and covered <= 0.2 * size and longest <= 0.1 * size

    assert set(good["doc_id"]) == {r.doc_id for r in start.itertuples() if kept(r.text)}
    assert len(found) >= 0.99 * len(good)
    grams = {}
    for r in found.itertuples():
        w = r.text.lower().split()
        grams[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    at = {i: i for i in grams}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(grams)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(grams[i] & grams[j])
            if common / (len(grams[i]) + len(grams[j]) - common) >= 0.8:
                x, y = root(i), root(j)
                at[max(x, y)] = min(x, y)
    assert sorted(single["doc_id"]) == [i for i in ids if root(i) == i]
    assert 0.6 * len(single) < len(mixed) <= len(single) and set(packed["doc_id"]) == set(mixed["doc_id"])


def test_run(spark, small):
    assert C.run(spark, small).count() > 0 and C.ORACLE_SQL is None
    assert [n for n, _ in C.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]


def test_stages_take_small_batches(spark, small):
    """A stage's texts go to the Python workers a few MB at a time, not ten thousand or 64 MB of them at once."""
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{small}/documents.parquet").limit(40)
    large = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    try:
        for name, stage in C.STAGES:
            if name == "mixing":  # hands no texts to Python
                continue
            spark.conf.unset(key)
            stage(spark, docs, small)
            seen = large.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in seen) == 2_000 and max(r.size for r in seen) < BATCH + 100_000, name
        spark.conf.set(key, "1m")
        small_batches(spark)
        assert spark.conf.get(key) == "1m"  # a smaller setting stays
    finally:
        spark.conf.unset(key)
