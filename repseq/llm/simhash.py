"""SimHash near-duplicates: a byte-position inverted index with count filtering, verification, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import dealt, rows
from repseq.operators.components import connected_components
from repseq.session import cut_lineage, given_back, join_counted, small_batches

#: Bits by which linked fingerprints differ at most; each can spoil one byte, so five of the eight bytes stay equal.
MAX_BITS = 3
LEAST_BYTES = 8 - MAX_BITS
#: Posting lists are kept by three byte positions with their values. Of any five of the eight positions, three lie in one half.
POSITIONS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
_OTHERS = [[p for p in range(8) if p not in c] for c in POSITIONS]
#: Fingerprints of a list that a task takes at once; longer lists are joined by the values that lie between two links.
LIST = 4096
#: Postings shared by the pairs of one list up to which they are tallied pair by pair; beyond, row by row.
SHARED = 4096


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the ASCII-lower-cased words' shingles, repeats included; a shorter text is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in shingles), np.uint64)


def fingerprint(text: str | None, *, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: its ASCII-lower-cased words' shingles, repeats included, by XXH64."""
    return simhash(shingle_hashes(text, words, seed))


def simhash(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp)``: each row's fingerprint as a signed long. NULL and wordless texts have fingerprint 0."""

    def scan(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words=words, seed=seed) for (t,) in rows(b, "t")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fp.view(np.int64))], ["k", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(scan, f"k {kind}, fp long").withColumnRenamed("k", key)


def _byte(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 8 * i).bitwiseAND(255)


def _within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal values of the sorted array ``group``, the earlier place second."""
    n = len(group)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(n), 0))
    many = np.arange(n) - first  # each place pairs with the earlier ones of its group
    one = np.repeat(np.arange(n), many)
    ends = np.cumsum(many)
    return one, np.arange(len(one)) - np.repeat(ends - many, many) + first[one]


def tally(lists: np.ndarray, kind: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places ``(i, j)`` in one posting list that share ``LEAST_BYTES`` bytes or more, counted by postings.

    ``lists`` numbers the lists (ascending), ``kind`` is the triple of positions that a list is for. The five other positions
    are inverted too: within a list, fingerprints with the same byte at a position meet in a posting. A pair's postings
    are counted, and with the list's own three bytes it must reach the guaranteed minimum.
    """
    n, found = len(fp), []
    octets = fp.view(np.uint8).reshape(-1, 8)
    for p in range(8):
        at = np.flatnonzero(np.array([p in o for o in _OTHERS])[kind])
        posting = lists[at] * 256 + octets[at, p]
        by = np.argsort(posting, kind="stable")
        one, other = _within(posting[by])
        i, j = at[by[one]], at[by[other]]
        found.append(np.minimum(i, j) * n + np.maximum(i, j))
    pairs, shared = np.unique(np.concatenate(found), return_counts=True)
    pairs = pairs[shared + 3 >= LEAST_BYTES]
    return pairs // n, pairs % n


def verified(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]) <= MAX_BITS


def _crowded(kind: int, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one list whose pairs share many postings: each fingerprint that the forest reaches
    tallies the bytes that those not yet reached share with it, so no two are compared twice and no link is stored."""
    octets, left, edges = fp.view(np.uint8).reshape(-1, 8)[:, _OTHERS[kind]], np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            shared = (octets[left] == octets[u]).sum(1)
            some = np.flatnonzero(shared + 3 >= LEAST_BYTES)
            some = some[verified(fp, left[some], np.full(len(some), u))]
            edges += [(u, int(v)) for v in left[some]]
            queue += left[some].tolist()
            left = np.delete(left, some)
    return edges


def _list_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in whole lists (``key`` sorted): all of a list with few shared postings, a spanning forest of a crowded one."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    number = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    kind, octets, size = (key >> 24).astype(np.int64), fp.view(np.uint8).reshape(-1, 8), np.diff(np.concatenate((starts, [len(key)])))
    shared = np.zeros(len(starts), np.int64)
    for p in range(8):
        at = np.flatnonzero(np.array([p in o for o in _OTHERS])[kind])
        posting, count = np.unique(number[at] * 256 + octets[at, p], return_counts=True)
        shared += np.bincount(posting // 256, count * (count - 1) // 2, len(starts)).astype(np.int64)
    out = []
    few = np.flatnonzero(np.repeat(shared <= SHARED, size))
    for a in range(0, len(few), 1 << 15):
        b = few[a : a + (1 << 15)]
        more = few[a + (1 << 15) :]
        b = np.concatenate([b, more[number[more] == number[b[-1]]]]) if len(more) else b
        b = b[number[b] != number[few[a - 1]]] if a else b
        if len(b) > 1:
            i, j = tally(number[b], kind[b], fp[b])
            good = verified(fp[b], i, j)
            out.append(np.column_stack([b[i[good]], b[j[good]]]))
    for x in np.flatnonzero(shared > SHARED):
        a = starts[x]
        edges = _crowded(int(kind[a]), fp[a : a + size[x]])
        if edges:
            out.append(np.array(edges, np.int64) + a)
    e = np.concatenate([np.empty((0, 2), np.int64), *out])
    return e[:, 0], e[:, 1]


def _scan_lists(batches) -> Iterator[pa.RecordBatch]:
    """Links of posting lists that arrive sorted; the last list of a batch waits for the next batch."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(k, f):
        i, j = _list_links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(f[i].view(np.int64)), pa.array(f[j].view(np.int64))], ["src", "dst"])

    for b in batches:
        key = np.concatenate([key, b.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if whole:
            yield links(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield links(key, fp)


def _between(long: DataFrame) -> DataFrame:
    """Links in lists of any length, without comparing pairs.

    Two fingerprints of a list that differ in three bits or fewer have a value between them, one bit or none from the one
    and two or fewer from the other. So each is put down at all values that near (in the 40 bits that the list leaves open:
    821 of them), and at each value all are linked to the smallest that is one bit off at most: never more than 821 in a
    group, and a class of any size is joined by a number of links in proportion to it.
    """
    flips = [0] + [1 << i for i in range(40)]
    far = sorted({a ^ b for a in flips for b in flips})
    masks = F.explode(F.lit(np.array(far, np.int64))).alias("mask")
    open_bits = F.lit(0).cast("long")
    for n, others in enumerate(_OTHERS):
        bits = F.lit(0).cast("long")
        for place, p in enumerate(others):
            bits = bits.bitwiseOR(F.shiftleft(_byte(F.col("fp"), p), 8 * place))
        open_bits = F.when(F.shiftright("key", 24) == n, bits).otherwise(open_bits)
    put = long.select("key", "fp", open_bits.alias("bits"), masks)
    put = put.select("key", "fp", F.col("bits").bitwiseXOR(F.col("mask")).alias("value"), (F.bit_count("mask") <= 1).alias("near"))
    first = F.min(F.when(F.col("near"), F.col("fp"))).over(W.partitionBy("key", "value"))
    return put.withColumn("dst", first).where("dst IS NOT NULL AND dst != fp").select(F.col("fp").alias("src"), "dst").distinct()


def links(marks: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` between fingerprints that connect every two of ``marks (fp)`` at ``MAX_BITS`` or fewer bits.

    Every pair at that distance meets in a posting list. A task streams the lists that it got; their pairs' postings are
    tallied, those that reach the guaranteed minimum are verified, and a crowded list yields a spanning forest. Lists beyond
    ``LIST`` are joined by the values between two links, so no task holds a long list and no list is copied.
    """
    fp = F.col("fp")
    keys = [F.lit(n << 24).bitwiseOR(_byte(fp, a)).bitwiseOR(F.shiftleft(_byte(fp, b), 8)).bitwiseOR(F.shiftleft(_byte(fp, c), 16)) for n, (a, b, c) in enumerate(POSITIONS)]
    posts = marks.select("fp", F.explode(F.array(*(k.cast("long") for k in keys))).alias("key"))
    many = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = cut_lineage(posts.join(many, "key"))
    short = posts.where(F.col("n") <= LIST).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return short.mapInArrow(lambda it: given_back(_scan_lists(it)), "src long, dst long").union(_between(posts.where(F.col("n") > LIST)))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp, component_id)`` per row of ``df``: fingerprint and the smallest key reachable over links.

    Equal fingerprints are one node from the start. Texts without words have fingerprint 0 and are linked like any other.
    Keys are of any type that can be ordered; rows with equal keys keep one row each; rows with a NULL key link like others
    and get their component's smallest key (NULL where it has none). An empty table gives no rows. Fingerprints that very
    many rows share come back by a broadcast, so no task meets all copies of a text.
    """
    marks = cut_lineage(fingerprints(df, key=key, text=text, words=words, seed=seed))
    nodes = cut_lineage(marks.groupBy("fp").agg(F.min(key).alias("rep"), F.count("*").alias("n")))
    found = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    nodes = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = cut_lineage(nodes)
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    named = join_counted(nodes, least, "component", "size", nodes.count()).select("fp", "component_id", "n")
    return join_counted(marks, named, "fp", "n", marks.count()).select(key, "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(dealt(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, with its columns unchanged.

    Near copies share four fifths of their five-word shingles or more. Candidates come from the SimHash index (fingerprints
    of five-word shingles, ``links``) and are verified by their whole sets; what three bits do not reach is searched among
    the components that this leaves (see ``minhash``). Of a group the row with the smallest id stays, rows without id last; of several texts under that id
    the one with the smallest hash; of rows alike in id and text one. Different texts under one id are different documents.
    NULL, empty and wordless texts are copies of each other; no rows give no rows.
    """
    from repseq.llm.minhash import one_of_each_class  # builds on this module

    small_batches(spark)
    return one_of_each_class(docs)
