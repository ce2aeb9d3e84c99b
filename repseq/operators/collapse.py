"""Collapsing duplicate sequences that are equal up to ambiguous characters."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.functions.sequence import DEFAULT_IGNORE, seq_equal
from repseq.operators.components import connected_components
from repseq.session import cut_lineage, tasks

#: Fixed: characters that carry no information, whatever is ignored in comparisons.
UNINFORMATIVE = "N-.?"


def informative_length(seq: Column) -> Column:
    return F.length(F.translate(seq, UNINFORMATIVE, ""))


def _related(rows: DataFrame, ignore: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(block, s1, s2)`` of equal distinct sequences (both ways and each with itself), and the ambiguous ``(block, s)``.

    A sequence is ambiguous if two of those it equals differ from each other.
    """
    u = rows.select("_b", "_s").distinct().withColumn("_n", F.length("_s")).repartition(tasks(rows.sparkSession), "_b", "_n")
    a, b = u.alias("a"), u.alias("b")
    meet = (F.col("a._b") == F.col("b._b")) & (F.col("a._n") == F.col("b._n")) & (F.col("a._s") < F.col("b._s"))
    one = a.join(b, meet).where(seq_equal("a._s", "b._s", [c[:1] for c in ignore])).select(F.col("a._b").alias("_b"), F.col("a._s").alias("s1"), F.col("b._s").alias("s2"))
    one = cut_lineage(one)
    ways = F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2")))
    both = one.select("_b", F.inline(ways))
    left, right = both.alias("l"), both.alias("r")
    wedge = left.join(right, (F.col("l._b") == F.col("r._b")) & (F.col("l.s1") == F.col("r.s1")) & (F.col("l.s2") < F.col("r.s2")))
    wedge = wedge.select(F.col("l._b").alias("_b"), F.col("l.s1").alias("_s"), F.col("l.s2").alias("s1"), F.col("r.s2").alias("s2"))
    ambiguous = wedge.join(one, ["_b", "s1", "s2"], "left_anti").select("_b", "_s").distinct()
    return both, cut_lineage(ambiguous)


def collapse_duplicates(
    data: DataFrame, *, id: str = "sequence_id", seq: str = "sequence_alignment", text_fields: Sequence[str] = (), num_fields: Sequence[str] = (), seq_fields: Sequence[str] = (),
    add_count: bool = False, fields: Sequence[str] = (), ignore: Sequence[str] = DEFAULT_IGNORE, sep: str = ",", dry: bool = False,
) -> DataFrame:
    """One row for each set of sequences that are equal up to ``ignore``; ambiguous sequences are dropped.

    Within each value of ``fields`` (NULL is a value): a sequence that equals two different ones is ambiguous. The others
    fall into clusters; a cluster's row is the one with most informative characters, with text fields split, sorted and
    joined, numbers summed, and sequence fields taken where they are most informative. Single rows stay as they are. Where
    at most one row is not ambiguous, each connected set of equal sequences gives its most informative row, unmerged. Ties
    go to the smallest ``id``. ``add_count`` adds ``collapse_count``.

    ``dry`` keeps all rows and adds ``collapse_id`` (clusters numbered by their smallest id; ambiguous rows list all they
    touch), ``collapse_class`` (unique, duplicated, ambiguous_duplicate, ambiguous) and ``collapse_pass``.

    Comparisons happen between distinct sequences of one block and length only; what a block costs grows with the square
    of its distinct sequences, so choose ``fields`` (a clone) accordingly.
    """
    missing = [f for f in fields if f not in data.columns]
    if missing:
        warnings.warn(f"columns not found: {', '.join(missing)}", stacklevel=2)
    fields = [f for f in fields if f in data.columns]
    plain = data.columns
    if add_count and not dry:
        data = data.withColumn("collapse_count", F.lit(1).cast("long"))
        num_fields = [*num_fields, "collapse_count"]
    block = F.to_json(F.struct(*(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))) if fields else F.lit("")
    rows = cut_lineage(data.withColumns({"_b": block, "_s": F.col(seq), "_info": informative_length(F.col(seq)), "_id": F.col(id)}))
    both, ambiguous = _related(rows, ignore)
    rows = rows.join(ambiguous.withColumn("_amb", F.lit(True)), ["_b", "_s"], "left").withColumn("_amb", F.coalesce("_amb", F.lit(False)))
    clear = rows.groupBy("_b").agg(F.count_if(~F.col("_amb")).alias("_clear"))
    rows = cut_lineage(rows.join(clear, "_b"))

    # Clusters of clear sequences: equality is transitive among them, so the smallest neighbour names the cluster.
    near = both.join(ambiguous.withColumnRenamed("_s", "s2"), ["_b", "s2"], "left_anti")
    least = near.groupBy("_b", F.col("s1").alias("_s")).agg(F.min("s2").alias("_least"))
    clustered = rows.join(least, ["_b", "_s"], "left").withColumn("_cluster", F.when(~F.col("_amb"), F.least("_s", "_least"))).drop("_least")
    first = F.struct(-F.col("_info"), F.col("_id"))

    def components(part: DataFrame) -> DataFrame:
        """Rows of blocks without clusters, with the connected set they are in."""
        node = lambda s: F.concat(F.col("_b"), F.lit("|"), F.col(s))
        found = connected_components(both.join(part.select("_b").distinct(), "_b", "left_semi").select(node("s1").alias("src"), node("s2").alias("dst")))
        return part.withColumn("node", node("_s")).join(found, "node", "left").withColumn("_set", F.coalesce("component", "node")).drop("node", "component")

    few = clustered.where("_clear <= 1")
    few_linked = few.where("_amb")
    if few_linked.isEmpty():
        few = few.withColumn("_set", F.col("_s"))
    else:  # only blocks with ambiguous rows need the graph
        linked = few.join(few_linked.select("_b").distinct(), "_b", "left_semi")
        alone = few.join(few_linked.select("_b").distinct(), "_b", "left_anti").withColumn("_set", F.col("_s"))
        few = components(linked).unionByName(alone)
    few = few.withColumn("_pick", F.row_number().over(W.partitionBy("_b", "_set").orderBy(F.desc("_info"), "_id")) == 1)
    many = clustered.where("_clear > 1")

    if not dry:
        keep = [c for c in data.columns]
        groups = many.where("NOT _amb").groupBy("_b", "_cluster")
        merged = {}
        for f in text_fields:
            parts = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(f), lambda t: F.split(t, sep)))))
            merged[f] = F.when(F.count("*") == 1, F.max(f)).when(F.count(f) > 0, F.array_join(parts, sep))
        for f in num_fields:
            merged[f] = F.sum(f)
        for f in seq_fields:
            merged[f] = F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(-informative_length(F.col(f)), F.col("_id"))))
        best = groups.agg(F.min_by(F.struct(*keep), first).alias("_row"), *(c.alias(f"_m_{f}") for f, c in merged.items()))
        types = dict(data.dtypes)
        out = best.select(*(F.col(f"_m_{c}").cast(types[c]).alias(c) if c in merged else F.col(f"_row.{c}").alias(c) for c in keep))
        return out.unionByName(few.where("_pick").select(*keep))

    per = many.where("NOT _amb").groupBy("_b", "_cluster").agg(F.count("*").alias("_size"), F.min("_id").alias("_first"), F.min_by("_id", first).alias("_best"))
    per = per.withColumn("_number", F.row_number().over(W.partitionBy("_b").orderBy("_first")))
    touched = both.join(ambiguous.withColumnRenamed("_s", "s2"), ["_b", "s2"], "left_semi").select("_b", F.col("s1").alias("_cs"), F.col("s2").alias("_s"))
    cluster_of = many.where("NOT _amb").select("_b", F.col("_s").alias("_cs"), "_cluster").distinct()
    lists = touched.join(cluster_of, ["_b", "_cs"]).join(per.select("_b", "_cluster", "_number"), ["_b", "_cluster"])
    lists = lists.groupBy("_b", "_s").agg(F.array_join(F.transform(F.array_sort(F.collect_set("_number")), lambda n: n.cast("string")), ",").alias("_list"))
    with_amb = touched.join(cluster_of, ["_b", "_cs"]).select("_b", "_cluster").distinct().withColumn("_touched", F.lit(True))
    out = many.join(per, ["_b", "_cluster"], "left").join(with_amb, ["_b", "_cluster"], "left").join(lists, ["_b", "_s"], "left")
    kind = F.when(F.col("_amb"), "ambiguous").when(F.col("_size") > 1, "duplicated").when(F.coalesce("_touched", F.lit(False)), "ambiguous_duplicate").otherwise("unique")
    passes = F.when(F.col("_amb"), False).when(F.col("_size") > 1, F.col("_id") == F.col("_best")).otherwise(True)
    out = out.select(*plain, F.when(F.col("_amb"), F.col("_list")).otherwise(F.col("_number").cast("string")).alias("collapse_id"), kind.alias("collapse_class"), passes.alias("collapse_pass"))
    sets = few.groupBy("_b", "_set").agg(F.min("_id").alias("_first"), F.count("*").alias("_members")).withColumn("_number", F.row_number().over(W.partitionBy("_b").orderBy("_first")))
    kind = F.when(F.col("_amb"), "ambiguous").when(F.col("_members") > 1, "ambiguous_duplicate").otherwise("unique")
    rest = few.join(sets, ["_b", "_set"]).select(*plain, F.col("_number").cast("string").alias("collapse_id"), kind.alias("collapse_class"), F.col("_pick").alias("collapse_pass"))
    return out.unionByName(rest)
