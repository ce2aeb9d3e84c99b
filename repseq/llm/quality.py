"""Quality rules: base counts, and repetition measured with a suffix array over each whole text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.llm._common import WORD, spare, split_words, table
from repseq.session import give_back, small_batches

#: Fixed by the query contract.
SYMBOLS = "#*$%&|<>"


def suffix_array(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``data`` and its keys: the first eight bytes of each suffix as a big-endian number.

    Suffixes are sorted by those keys, then by prefix doubling; a round sorts only suffixes that are still tied.
    """
    n = len(data)
    a = np.zeros(n + 7, np.uint64)
    a[:n] = np.frombuffer(data, np.uint8)
    k = (a[:-1] << np.uint64(8)) | a[1:]
    k = (k[:-2] << np.uint64(16)) | k[2:]
    k = (k[:-4] << np.uint64(32)) | k[4:]
    order = np.argsort(k)
    first = np.empty(n, bool)
    first[:1] = True
    np.not_equal(k[order[1:]], k[order[:-1]], out=first[1:])
    width, slots = 8, np.arange(n)
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(first, slots, 0))
    rank[order] = start
    tied = ~first
    tied[:-1] |= ~first[1:]
    at = slots[tied]  # places in the array whose suffixes share their first ``width`` bytes with a neighbour
    while len(at):
        who = order[at]
        after = who + width
        # A suffix that ends inside the prefix sorts before those that go on; the shorter one first.
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, -who - 1)
        group = rank[who]
        by = np.lexsort((nxt, group))
        who, group, nxt = who[by], group[by], nxt[by]
        order[at] = who
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        lone = new.copy()
        lone[:-1] &= new[1:]
        at = at[~lone]
        width *= 2
    return order, k


def _extend(data: np.ndarray, i: int, j: int) -> int:
    """Length of the common prefix of two suffixes, in growing blocks."""
    done, block = 0, 64
    while True:
        x, y = data[i + done : i + done + block], data[j + done : j + done + block]
        m = min(len(x), len(y))
        differ = x[:m] != y[:m]
        if differ.any():
            return done + int(differ.argmax())
        done += m
        if m < block:
            return done
        block *= 2


def longest_repeats(data: bytes) -> np.ndarray:
    """For each position of ``data``, the length of the longest substring from there that also occurs elsewhere.

    That is the larger of the two longest-common-prefix values beside the position's suffix. A common prefix is only
    measured where the bytes before the two suffixes differ; elsewhere it is one less than at the position before
    (so the work is O(n log n), also on periodic texts). Lengths below eight come out as 0.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    order, k = suffix_array(data)
    a = np.frombuffer(data, np.uint8)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (before <= 0)
    fresh[1:] |= a[before[1:] - 1] != a[:-1]
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    live = live[k[live] == k[before[live]]]
    other, room = before[live], n - np.maximum(live, before[live])
    length = np.zeros(len(live), np.int64)
    todo = np.arange(len(live))
    while len(todo) > 8:
        p, q = live[todo] + length[todo], other[todo] + length[todo]
        inside = length[todo] < room[todo]
        p, q = np.minimum(p, n - 1), np.minimum(q, n - 1)
        x = np.where(inside, k[p] ^ k[q], np.uint64(1 << 63))
        same = x == 0
        # Leading zero bytes of the difference, without rounding: compare against the eight byte masks.
        lead = np.zeros(len(todo), np.int64)
        for b in range(1, 8):
            lead += (x >> np.uint64(64 - 8 * b)) == 0
        length[todo] += np.where(same, 8, lead)
        todo = todo[same]
    for t in todo:
        length[t] += _extend(a, int(live[t] + length[t]), int(other[t] + length[t])) if length[t] < room[t] else 0
    plcp[live] = np.minimum(length, room)
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    plcp = np.maximum(plcp[last] - (i - last), 0)
    out = plcp.copy()
    has = before >= 0
    out[before[has]] = np.maximum(out[before[has]], plcp[has])
    out[out < 8] = 0
    return out


def _may_repeat(data: bytes) -> bool:
    """False only if no window of 32 bytes occurs twice (equal windows have equal hashes)."""
    n = len(data) - 31
    if n < 2:
        return False
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, odd in ((1, 0x100), (2, 0x10000), (4, 0x100000000), (8, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F)):
            a = a[:-shift] * np.uint64(odd) + a[shift:]
    a = np.sort(a)
    return bool((a[1:] == a[:-1]).any())


def repetition(text: str, least: int) -> tuple[int, int, int]:
    """Bytes of ``text`` (UTF-8) under repeated substrings of ``least`` bytes or more, longest repeat, all bytes.

    ``least`` is 32 at least; where no repeat is that long, the first two numbers are 0 and no suffix array is built.
    The union of the spans of all maximal repeats (the LCP intervals of that depth or more) is the union, over
    positions, of the longest repeat from there.
    """
    if least < 32:
        raise ValueError("least must be 32 or more")
    data = text.encode("utf-8", "surrogatepass")
    if not _may_repeat(data):
        return 0, 0, len(data)
    far = longest_repeats(data)
    longest = int(far.max())
    if longest < least:
        return 0, 0, len(data)
    at = np.flatnonzero(far >= least)
    reach = np.maximum.accumulate(at + far[at])
    covered = int((reach - np.maximum(at, np.concatenate(([0], reach[:-1])))).sum())
    return covered, longest, len(data)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = split_words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(three)) < len(three):
        often, end = {x for x, n in Counter(three).items() if n > 1}, 0
        for i, x in enumerate(three):
            if x in often:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "repeat_bytes", "longest_repeat")


def measure(df: DataFrame, text: str = "text", *, least: int = 50, out: str = "quality") -> DataFrame:
    """Adds the struct column ``out`` with the base counts and ``n_bytes, repeat_bytes, longest_repeat`` of the text.

    NULL texts count as empty: all numbers are 0. Rows stay as they are and where they are (no shuffle); memory is a
    few dozen bytes per byte of the longest text. A column named like ``out`` is replaced.
    """
    df = df.drop(out)
    kind = f"struct<{', '.join(f'{c}: long' for c in COLUMNS)}>"

    @F.pandas_udf(kind)
    def counts(texts):
        found = []
        for t in texts:
            t = t or ""
            covered, longest, size = repetition(t, least)
            found.append((*base_counts(t), size, covered, longest))
        give_back()
        return pd.DataFrame(found, columns=list(COLUMNS), dtype="int64")

    return df.withColumn(out, counts(F.col(text)))


def passes(quality: str = "quality", *, max_covered: float = 0.2, max_longest: float = 0.1) -> Column:
    """The verdict on a measured row: its repeats cover ``max_covered`` of the bytes at most, the longest ``max_longest``.

    Both limits lie well below the base rule's half of the words, so they judge texts that it passes. A passage that
    occurs twice covers twice its length, so the two agree on it.
    """
    q = F.col(quality)
    return (q["repeat_bytes"] <= q["n_bytes"] * max_covered) & (q["longest_repeat"] <= q["n_bytes"] * max_longest)


def base_failed(quality: str = "quality") -> Column:
    """Fixed by the query contract: fewer than 50 words, or over half of them in repeated three-word windows."""
    q = F.col(quality)
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, repetition and verdict of every document."""
    df = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", *(F.col(f"quality.{c}") for c in COLUMNS), base_failed().alias("base_failed"), (~base_failed() & passes()).alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that pass, with their columns unchanged."""
    small_batches(spark)
    (name,) = spare(docs, "quality")
    return measure(docs, out=name).where(~base_failed(name) & passes(name)).drop(name)
