from __future__ import annotations

from repseq.llm import minhash as M
from repseq.llm import simhash as S


def grams(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stage_removes_near_copies_beyond_three_bits(spark):
    """Against all pairs: components over Jaccard 0.8 of five-word shingles, and the smallest id of each stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: grams(t) for i, t in texts.items()}
    at, ids, far = {i: i for i in sets}, sorted(sets), 0

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                far += (S.fingerprint(texts[i]) ^ S.fingerprint(texts[j])).bit_count() > 3
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    assert far > 0
    assert {r.doc_id: r.component_id for r in M.near_copies(docs).collect()} == {i: root(i) for i in ids}
    assert {r.doc_id for r in S.dedup_stage(spark, docs, "").collect()} == {i for i in ids if root(i) == i}


def test_stage_takes_the_simhash_index(spark, monkeypatch):
    """Without any band the index alone finds close pairs, and the whole sets decide on them: a passage repeated 400 times makes
    the fingerprints of two texts close, but not the texts near copies."""
    base = [f"w{i}" for i in range(3000)]
    line = ["one", "two", "three", "four", "five", "six", "seven"]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"v{i}" for i in range(50)))]
    rows += [(4, " ".join(line * 400 + [f"x{i}" for i in range(20)])), (5, " ".join(line * 400 + [f"y{i}" for i in range(20)]))]
    fp = {i: S.fingerprint(t, words=5) for i, t in rows}
    assert (fp[1] ^ fp[2]).bit_count() <= 3 and (fp[4] ^ fp[5]).bit_count() <= 3
    docs, seen, links = spark.createDataFrame(rows, "doc_id long, text string"), [], M.links
    monkeypatch.setattr(M, "links", lambda marks: seen.append({r.fp for r in marks.collect()}) or links(marks))
    monkeypatch.setattr(M, "bands", lambda h: h[:0].view("int64"))
    assert {r.doc_id for r in S.dedup_stage(spark, docs, "").collect()} == {1, 3, 4, 5}
    assert {x % 2**64 for x in seen[0]} == set(fp.values())


def test_pairs_across_components_of_a_band(spark, monkeypatch):
    """One band for all texts: the pairs that the smallest key does not join are still compared."""
    import numpy as np

    monkeypatch.setattr(M, "bands", lambda h: np.zeros(1, np.int64))
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(1, "x y z"), (2, " ".join(a)), (3, " ".join(b)), (4, " ".join([*a, "new"])), (5, " ".join([*b, "new"])), (6, " ".join(b))]
    out = M.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: 3}


def test_group_of_copies_with_many_edits(spark):
    """Copies of one text, each with up to six words changed: many share bands without being alike. Against all pairs."""
    import random

    dice = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(dice.randint(0 if i == 70 else 1, 6)):
            at = dice.randrange(len(w))
            w[at : at + 1] = dice.choice([[], [f"n{dice.randrange(40)}"], [w[at], f"n{dice.randrange(40)}"]])
        texts[i] = " ".join(w)
    sets = {i: grams(t) for i, t in texts.items()}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in texts:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    expected = {i: root(i) for i in texts}
    assert 3 < len(set(expected.values())) < 147
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in M.near_copies(df).collect()} == expected
