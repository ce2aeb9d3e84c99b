from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from repseq.llm import simhash as S


def plain(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fp: list[int]) -> list[int]:
    at = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    at[i] = at[j] = min(at[i], at[j])
    return at


def test_fingerprint():
    for t in (None, "", "  \n", "One", "one TWO", "Ä b c D", "a b c a b c a b c", "x " * 5000, "a b c d"):
        assert S.fingerprint(t) == plain(t)


def clusters(rng: random.Random) -> list[int]:
    """Dense groups, chains, and lone fingerprints."""
    fp = {0}
    for _ in range(6):
        base = rng.getrandbits(64)
        fp |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(9)} | {rng.getrandbits(64)}
        for _ in range(4):
            base ^= sum(1 << b for b in rng.sample(range(64), 3))
            fp.add(base)
    return sorted(fp)


@pytest.mark.parametrize("most,shared", [(4096, 4096), (4096, 0), (4096, 1 << 40), (1, 4096), (3, 2)])
def test_links_join_all_close_fingerprints(spark, monkeypatch, most, shared):
    """Tallied pair by pair, row by row, and by the values between two links."""
    monkeypatch.setattr(S, "LIST", most)
    monkeypatch.setattr(S, "SHARED", shared)
    fp = clusters(random.Random(5))
    marks = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fp], "fp long")
    found = {r.node: r.component for r in S.connected_components(S.links(marks)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fp]
    at = components(fp)
    groups = {i: min(signed[j] for j in range(len(fp)) if at[j] == at[i]) for i in range(len(fp))}
    assert [found.get(x, x) for x in signed] == [groups[i] for i in range(len(fp))]


def test_postings_decide_what_is_verified(monkeypatch):
    """In one list, exactly the pairs that share five bytes or more reach the verification, which keeps the close ones."""
    rng = random.Random(3)
    head = rng.getrandbits(24)
    fp = np.array(sorted({head | rng.choice([0, 1, 2, 255]) << 24 | rng.choice([0, 7]) << 32 | rng.choice([0, 1, 128]) << 40 | rng.getrandbits(1) << 63 for _ in range(60)}), np.uint64)
    seen = []
    monkeypatch.setattr(S, "verified", lambda f, i, j, plain=S.verified: (seen.extend(zip(i.tolist(), j.tolist(), strict=True)), plain(f, i, j))[1])
    key = np.zeros(len(fp), np.int64)  # the list of the three lowest bytes
    monkeypatch.setattr(S, "SHARED", 1 << 40)
    i, j = S._list_links(key, fp)
    octets = [int(f).to_bytes(8, "little") for f in fp.tolist()]
    pairs = [(a, b) for b in range(len(fp)) for a in range(b)]
    assert sorted(seen) == sorted((a, b) for a, b in pairs if sum(x == y for x, y in zip(octets[a], octets[b], strict=True)) >= S.LEAST_BYTES)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((a, b) for a, b in pairs if (int(fp[a]) ^ int(fp[b])).bit_count() <= 3)
    assert 0 < len(i) < len(seen) < len(pairs)


def test_lists_across_batches(monkeypatch):
    """A list that arrives in several batches is one list."""
    import pyarrow as pa

    fp = clusters(random.Random(9))
    key = [(f >> 60) for f in fp]
    order = sorted(range(len(fp)), key=lambda i: key[i])
    signed = np.array([fp[i] for i in order], np.uint64).view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([key[i] for i in order], pa.int64()), pa.array(signed)], ["key", "fp"])
    whole = {frozenset(x) for b in S._scan_lists([batch]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    parts = {frozenset(x) for b in S._scan_lists([batch.slice(i, 3) for i in range(0, len(fp), 3)]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert whole == parts and whole


def test_edges(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(20_000))
    rows = [(5, None, "x"), (6, "", "x"), (7, " \n", "x"), (8, long, "x"), (3, long, "x"), (3, long, "y"), (9, "one two three four", "x"), (None, "one two three four", "x"), (None, "alone here now", "x"), (3, "another text altogether", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = S.near_duplicates(df).collect()
    assert len(out) == 10
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 5), (6, 5), (7, 5), (8, 3), (3, 3), (9, 9), (None, 9), (None, None)}
    assert S.near_duplicates(df.limit(0)).count() == 0
    named = df.withColumn("doc_id", S.F.concat(S.F.lit("d"), "doc_id"))
    assert {(r.doc_id, r.component_id) for r in S.near_duplicates(named).collect()} >= {("d8", "d3"), ("d7", "d5"), (None, None)}


def test_stage_keeps_different_texts(spark):
    """Texts that differ stay even under one id, or none; columns of any name come through; repeated rows leave one."""
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, text, "a", 1), (1, "completely other words than those before it", "a", 1), (2, text, "a", 1), (3, None, None, None), (4, "", "b", 2), (None, "no id but text of its own here", "c", 3), (None, "no id but text of its own here", "c", 3), (None, text, "c", 3), (1, text, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string, k int")
    kept = S.dedup_stage(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, text), (1, "completely other words than those before it"), (3, None), (None, "no id but text of its own here")], key=str)
    assert S.dedup_stage(spark, df.limit(0), "").count() == 0
    again = S.dedup_stage(spark, df.repartition(5), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_query_against_brute_force(spark, small):
    out = S.op3_simhash(spark, small).toPandas().sort_values("doc_id")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fp = [int(x, 16) for x in out["fingerprint"]]
    assert fp == [plain(texts[i]) for i in out["doc_id"]]
    ids = out["doc_id"].tolist()
    assert out["component_id"].tolist() == [ids[i] for i in components(fp)]
