from __future__ import annotations

import random
from collections import Counter

import pytest

from repseq.llm import quality as Q


def brute(data: bytes) -> list[int]:
    out = []
    for i in range(len(data)):
        best = 0
        for j in range(len(data)):
            n = 0
            while i != j and i + n < len(data) and j + n < len(data) and data[i + n] == data[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab", "a\x00b", "abcdefgh"])
def test_suffix_array_and_repeats(alphabet):
    rng = random.Random(alphabet)
    for _ in range(40):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))
        data = (text + text[: rng.randint(0, 60)]).encode()
        order, _ = Q.suffix_array(data) if data else ([], None)
        assert list(order) == sorted(range(len(data)), key=lambda i: data[i:])
        far = brute(data)
        assert list(Q.longest_repeats(data)) == [n if n >= 8 else 0 for n in far]
        covered = {j for i, n in enumerate(far) if n >= 32 for j in range(i, i + n)}
        longest = max(far, default=0)
        assert Q.repetition(data.decode(), 32) == (len(covered), longest if longest >= 32 else 0, len(data))


def test_base_counts():
    assert Q.base_counts("a b c\na b c\n\n# x|y\n") == (8, 10, 2, 1, 6)
    assert Q.base_counts("") == (0, 0, 0, 0, 0)
    # A word may hold white space that is not ASCII.
    assert Q.base_counts("a b c")[:2] == (2, 4)


def test_counts_against_a_plain_version():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        three = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert Q.base_counts(" ".join(words))[4] == len(inside)


def test_edge_rows(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    clean = " ".join(f"w{i * i * 7919 % 100003}" for i in range(400))
    rows = [(1, None, 5), (2, "", 5), (3, clean, 5), (3, clean, 5), (4, "\n".join([line] * 40), 5), (5, clean + clean, 5), (6, "x" * 300_000, 5), (None, clean, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = Q.measure(df).select("doc_id", Q.base_failed().alias("bad"), Q.passes().alias("good"), "quality.n_bytes").collect()
    got = {r.doc_id: (r.bad, r.good) for r in out}
    assert len(out) == 8 and got[1] == got[2] == (True, True) and got[3] == got[None] == (False, True)
    assert got[4] == (True, False) and got[5][1] is False and got[6] == (True, False)
    assert Q.measure(df.limit(0)).count() == 0
    kept = Q.quality_stage(spark, df, "")
    assert kept.columns == df.columns and kept.count() == 3


def test_query(spark, small):
    out = Q.op1_quality(spark, small).toPandas()
    assert out["doc_id"].is_unique and 0.7 < out["kept"].mean() < 1 and not (out["kept"] & out["base_failed"]).any()


def test_repeats_below_the_base_rule_are_rejected(spark):
    """A quarter of the text repeated passes the base rules and fails the verdict; a short repeat and a clean text stay."""
    words = [f"w{i * i * 7919 % 100003}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:60])), (3, " ".join(words + words[:12]))]
    out = Q.measure(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", Q.base_failed().alias("bad"), Q.passes().alias("good")).collect()
    assert {r.doc_id: (r.bad, r.good) for r in out} == {1: (False, True), 2: (False, False), 3: (False, True)}
