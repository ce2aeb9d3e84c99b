from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from repseq.llm import packing as P
from repseq.llm.tokens import WordIds, default_path


def reference(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def test_word_cache_gives_the_library_ids():
    rng = random.Random(1)
    texts = ["", "Hello, World!", "it's you'll WE'RE 'S", "Ünïcödé ß ÿ µ ª", "a\tb\r\nc", "x\x0by\x0cz\x85w v", "日本語 テキスト", "<|endoftext|> <|startoftext|>", "İstanbul ΑΣ", "12 345 ²½", "é é", "''s '", "!!!...---"]
    alphabet = "abcXYZ'.,! 19\n\té² ́Σ<|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    words = WordIds(default_path(), limit=50)
    assert [words.encode(t) for t in texts] == [r[:-1].tobytes() for r in reference(texts)]


def test_windows():
    rng = random.Random(2)
    for gap in (1, 4, 99):
        w, placed, left = P.Windows(16, 3, gap), [], []
        sizes = [rng.randint(1, 16) for _ in range(300)]
        for i, n in enumerate(sizes):
            left += list(w.add(i, 0, n))
            assert len(w.open) <= 3
        for window in left:
            assert sum(x[2] for x in window) <= 16 and 16 - sum(x[2] for x in window) < max(gap, 16)
        placed = [x for window in [*left, *w.rest()] for x in window]
        for i, n in enumerate(sizes):
            assert sorted((s, k) for t, s, k in placed if t == i)[0][0] == 0 and sum(k for t, _, k in placed if t == i) == n


def check(out, ids: dict, capacity: int) -> float:
    """Every id once, offsets gapless; the share of padding."""
    for doc, g in out.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= capacity
    return 1 - out["length"].sum() / (capacity * out["sequence_id"].nunique())


def test_pack_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 40_000, 0), (4, "a b c", 0), (5, "日本 語", 0), *((i, f"text number {i} " * (i % 13), 0) for i in range(10, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    ids = dict(zip([r[0] for r in rows], reference([r[1] for r in rows]), strict=True))
    out = P.pack(df, capacity=64, windows=4, gap=4, with_ids=True).toPandas()
    assert check(out, ids, 64) < 0.07 and set(out["doc_id"]) == set(ids)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out.itertuples())
    assert P.pack(df.limit(0)).count() == 0
    twice = P.pack(df.where("doc_id = 4").union(df.where("doc_id = 4"))).toPandas()
    assert twice["length"].sum() == 2 * len(ids[4])


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    ids = dict(zip([r.doc_id for r in docs], reference([r.text for r in docs]), strict=True))
    assert check(P.op9_packing(spark, small).toPandas(), ids, 4096) < 0.02
