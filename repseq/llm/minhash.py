"""Near copies by the Jaccard similarity of word shingles: candidates from the SimHash index, then from MinHash bands for what
it leaves apart; exact verification; components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.llm._common import rows, spare
from repseq.llm.simhash import links, shingle_hashes, simhash
from repseq.operators.components import connected_components
from repseq.session import cut_lineage, few, given_back, join_counted

#: Words in a shingle, and the similarity from which two texts are near copies.
WORDS, LEAST = 5, 0.8
#: Minima that make a band, and bands. A pair at similarity s shares no band with probability (1 - s**5)**32: 3e-6 at 0.8.
ROWS, BANDS = 5, 32
#: Sets of shingles that a partition holds at least.
SETS = 5_000
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64)[:, None]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the ASCII-lower-cased words' shingles; a shorter text is one shingle."""
    return _distinct(shingle_hashes(text, words))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The set; texts without words have the hash of nothing."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the set's minima."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[None, i : i + 2048] * _TIMES + _PLUS).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _scan(df: DataFrame, text: str, words: int, sets: bool) -> DataFrame:
    """The rows' ``key, h1, h2``, the digest ``d`` of the set of shingles, its size ``n``, in ``v`` the set or else
    its bands, and the SimHash ``fp`` of the shingles, repeats included."""
    own = ["key", "h1", "h2"]

    def scan(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                every = [shingle_hashes(t, words) for (t,) in rows(part, "t")]
                found = [_distinct(h) for h in every]
                fp = pa.array(np.array([0 if sets else simhash(h) for h in every], np.uint64).view(np.int64))
                values = [(h.view(np.int64) if sets else bands(h)) for h in found]
                v = pa.array(values, pa.list_(pa.int64()))
                d = pa.array([xxhash.xxh128_digest(h.tobytes()) for h in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), d, pa.array([len(h) for h in found], pa.int32()), v, fp], [*own, "d", "n", "v", "fp"])

    return df.select(*own, F.col(text).alias("t")).mapInArrow(lambda it: given_back(scan(it)), f"key {df.schema['key'].dataType.simpleString()}, h1 long, h2 long, d binary, n int, v array<long>, fp long")


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text with two hashes of the text, which with the key tell documents apart."""
    return df.select(F.col(key).alias("key"), F.col(text).alias("t"), F.xxhash64(F.lit(1), F.col(text)).alias("h1"), F.xxhash64(F.lit(2), F.col(text)).alias("h2"))


def _close(nodes: DataFrame, total: int) -> DataFrame:
    """Pairs ``(src, dst)`` of ``nodes (id, fp)`` that connect all whose fingerprints are equal or, by the SimHash index, linked."""
    hubs = cut_lineage(few(nodes.groupBy("fp").agg(F.min("id").alias("hub"), F.count("*").alias("rows")), total))
    same = join_counted(nodes.select("id", "fp"), hubs, "fp", "rows", total, "inner").where("id != hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"))
    end = hubs.select("fp", "hub")
    near = links(hubs.select("fp")).join(end.toDF("src", "a"), "src").join(end.toDF("dst", "b"), "dst")
    near = cut_lineage(same.union(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    return few(near, near.count())


def _classes(df: DataFrame, key: str, text: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``(key, h1, h2, d)``, and nodes ``(d, c, rows)``: each set of shingles, its class, and how many rows have it."""
    df = _named(df, key, text)
    marks = cut_lineage(_scan(df, "t", words, sets=False))
    total = marks.count()
    one = F.min(F.struct(F.col("key").isNull(), "key", "h1", "h2"))
    nodes = marks.groupBy("d").agg(one.alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("v").alias("v"), F.min("fp").alias("fp"))
    nodes = cut_lineage(few(nodes, total).withColumn("id", F.monotonically_increasing_id()))  # numbers hold, as the nodes are written down
    close = _close(nodes, total)
    posts = nodes.select("id", F.explode("v").alias("band"))
    many = posts.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1").select("band", "hub")
    posts = cut_lineage(few(posts.join(many, "band"), total * BANDS))
    shared = posts.count()
    posts = few(posts, shared)
    some = posts.select("id").union(close.select("src")).union(close.select("dst")).distinct()
    wanted = nodes.join(some, "id", "left_semi").select("id", "d", "n", "rep.key", "rep.h1", "rep.h2")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("key", "h1", "h2")]
    texts = df.alias("a").join(wanted.alias("b"), same[0] & same[1] & same[2], "left_semi")
    sets = _scan(texts, "t", words, sets=True).select("d", "v").dropDuplicates(["d"])
    sets = cut_lineage(few(sets.join(wanted.select("id", "d", "n"), "d").select("id", "n", "v"), total, SETS))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs ``(src, dst)`` those at the similarity."""
        size = sets.select("id", "n")
        pairs = pairs.distinct().join(size.toDF("src", "n1"), "src").join(size.toDF("dst", "n2"), "dst").where(F.least("n1", "n2") / F.greatest("n1", "n2") >= least)
        both = pairs.join(sets.select(F.col("id").alias("src"), F.col("v").alias("v1")), "src").join(sets.select(F.col("id").alias("dst"), F.col("v").alias("v2")), "dst")
        both = both.withColumn("common", F.size(F.array_intersect("v1", "v2")))
        return cut_lineage(both.where(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")) >= least).select("src", "dst"))

    def parted(posts: DataFrame, joined: DataFrame) -> DataFrame:
        """Of ``posts`` with ``band`` and ``id`` those whose band lies in several components, with the component ``c``."""
        posts = posts.join(joined, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        split = posts.groupBy("band").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("band")
        return cut_lineage(few(posts.join(split, "band"), shared))

    def between(posts: DataFrame, joined: DataFrame) -> DataFrame:
        """Of ``posts (band, id)`` those whose band lies in several components, with component, size ``n`` and ``k``.

        ``k`` counts the shingles that another of these sets has too, so no partner shares more. Rows for which that is too
        few for a set as small as the band's smallest have no partner there and are left out.
        """
        posts = parted(posts, joined)
        own = sets.join(posts.select("id").distinct(), "id", "left_semi")
        alone = own.select("id", F.explode("v").alias("s")).groupBy("s").agg(F.count("*").alias("times"), F.min("id").alias("id")).where("times = 1")
        alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
        size = own.select("id", "n").join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("k"))
        size = cut_lineage(few(size, shared))
        posts = posts.join(size, "id")
        smallest = posts.groupBy("band").agg(F.min("n").alias("smallest"))
        room = F.col("k") * ((1 + least) / least) - F.col("n") + 1e-6  # the size up to which a partner can reach the similarity
        return cut_lineage(few(posts.join(smallest, "band").where(room >= F.greatest(F.col("smallest"), F.col("n") * least)).drop("smallest"), shared))

    def across(nodes: DataFrame) -> DataFrame:
        """Pairs of ``nodes (id, c, n, k)`` from different components that can reach the similarity.

        Each set's shingles are ordered from the rarest among these sets. Of two sets that reach the similarity the first
        ``n - t * n + 1`` of the larger and the first ``n - 2 * t / (1 + t) * n + 1`` of the smaller have one in common, so
        only these are joined; a passage that many share comes last and joins nothing. The place of their first common
        shingle bounds how many the two can share; a pair that meets at none where that is enough is left out.
        """
        each = sets.select("id", "v").join(nodes, "id").select("id", "c", "n", "k", F.explode("v").alias("s"))
        times = each.groupBy("s").agg(F.count("*").alias("times"), F.count("*").alias("rows"))
        each = join_counted(each, times, "s", "rows", nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "inner")
        each = each.withColumn("at", F.row_number().over(W.partitionBy("id").orderBy("times", "s")))
        front = [F.col("n") - F.ceil(F.col("n") * x - 1e-6) + 1 for x in (least, 2 * least / (1 + least))]
        each = each.where((F.col("at") <= front[0]) & (F.col("times") > 1)).withColumn("lead", F.col("at") <= front[1])
        each = cut_lineage(each.select("id", "c", "n", "k", "s", "at", "lead"))
        most = f"least(x.k, y.k, 1 + x.n - x.at, 1 + y.n - y.at) * {(1 + least) / least} + 1e-6 >= x.n + y.n"
        fits = f"x.s = y.s AND y.lead AND x.c != y.c AND (x.n, x.id) > (y.n, y.id) AND y.n >= x.n * {least} - 1e-6 AND {most}"
        return each.alias("x").join(each.alias("y"), F.expr(fits)).select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"))

    edges = alike(close)
    joined = cut_lineage(few(connected_components(edges).withColumnRenamed("node", "id"), total))
    spokes = parted(posts, joined).where("id != hub").drop("c")
    edges = edges.union(alike(spokes.select(F.col("hub").alias("src"), F.col("id").alias("dst"))))
    joined = cut_lineage(few(connected_components(edges).withColumnRenamed("node", "id"), total))
    open_ = between(spokes.select("band", "id"), joined)
    best = open_.groupBy("band").agg(F.max_by(F.struct("id", "c"), F.struct("k", -F.col("id"))).alias("hub"))
    open_ = cut_lineage(few(open_.join(best, "band"), shared))
    more = alike(open_.where("c != hub.c").select(F.col("hub.id").alias("src"), F.col("id").alias("dst")))
    if not more.isEmpty():
        edges = edges.union(more)
        joined = cut_lineage(few(connected_components(edges).withColumnRenamed("node", "id"), total))
    open_ = between(open_.where("id != hub.id").select("band", "id"), joined)
    last = alike(across(open_.groupBy("id").agg(F.min("c").alias("c"), F.min("n").alias("n"), F.min("k").alias("k"))))
    found = joined if last.isEmpty() else connected_components(edges.union(last)).withColumnRenamed("node", "id")
    return marks.select("key", "h1", "h2", "d"), nodes.join(found, "id", "left").select("d", F.coalesce("component", "id").alias("c"), "rows")


def near_copies(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``(key, component_id)`` per row: the smallest key reachable over pairs of similarity ``least`` or more.

    Equal sets of shingles are one node from the start. Sets whose SimHash fingerprints are equal or linked by the index are
    compared first, by the whole sets; bands whose sets that joins are done. In the others, too, pairs are compared by their whole sets: first
    each with the first node of its band, then, where that leaves a band in several components, with the node that has most
    shingles in common with others, and at last the pairs across components that share one of their rarest shingles, as
    every two at the similarity do. Before the second and the third step nodes go that have too few shingles in common with
    any other. So a class of near copies is joined without all its pairs, and a passage that many share makes none; only
    where many nodes alike to neither first node share rare shingles are their pairs compared one by one. Texts without words, NULL ones too, are copies of each other.
    Rows with a NULL key get their class's smallest key, NULL where it has none. An empty table gives no rows.
    """
    marks, nodes = _classes(df, key, text, words, least)
    marks = cut_lineage(join_counted(marks, nodes, "d", "rows", marks.count()).select("key", "c"))
    least_key = marks.groupBy("c").agg(F.min("key").alias("component_id"), F.count("*").alias("rows"))
    return join_counted(marks, least_key, "c", "rows", marks.count()).select(F.col("key").alias(key), "component_id")


def one_of_each_class(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of ``df`` without near copies: of each class the row with the smallest key (NULL ones last), then the smallest
    hashes of the text; of rows alike in these one. Only keys and hashes of what goes meet the rows."""
    marks, nodes = _classes(df, key, text, words, least)
    total = marks.count()
    marks = join_counted(marks, nodes, "d", "rows", total).groupBy("c", "key", "h1", "h2").agg(F.count("*").alias("rows"))
    marks = cut_lineage(few(marks, total))
    best = marks.groupBy("c").agg(F.min(F.struct(F.col("key").isNull(), "key", "h1", "h2")).alias("best"), F.count("*").alias("size"))
    marks = join_counted(marks, best, "c", "size", marks.count())
    stays = F.col("best.key").eqNullSafe(F.col("key")) & (F.col("best.h1") == F.col("h1")) & (F.col("best.h2") == F.col("h2"))
    h1, h2, place, k, k1, k2 = spare(df, "h1", "h2", "place", "k", "k1", "k2")
    marks = few(marks, total)
    marks = cut_lineage(marks.select(F.col("key").alias(k), F.col("h1").alias(k1), F.col("h2").alias(k2), stays.alias("stays"), (F.col("rows") > 1).alias("again")))
    whole = df.withColumns({h1: F.xxhash64(F.lit(1), F.col(text)), h2: F.xxhash64(F.lit(2), F.col(text))})
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2))
    kept = whole.join(marks.where("NOT stays OR again").select(k, k1, k2), same, "left_anti")
    order = [F.xxhash64(*(F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")))]
    again = whole.join(marks.where("stays AND again").select(k, k1, k2), same, "left_semi")
    again = again.withColumn(place, F.row_number().over(W.partitionBy(key, h1, h2).orderBy(*order))).where(F.col(place) == 1).drop(place)
    return kept.unionByName(again).select(*df.columns)
