"""Queries over lineage trees, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.operators import topology as T
from repseq.plans.fixtures import WITH_FOREST, forest
from repseq.plans.registry import Registry

REGISTRY = Registry()
_CLOSURE = WITH_FOREST.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """,
  closure AS (SELECT tree_id, name AS anc, name AS node, 0 AS steps, CAST(0 AS DOUBLE) AS dist FROM nodes
    UNION ALL SELECT c.tree_id, c.anc, e.child, c.steps + 1, c.dist + e.weight FROM closure c JOIN edges e ON e.tree_id = c.tree_id AND e.parent = c.node)"""
_SKIP = "annotation IS NULL OR annotation = 'BUILDING'"
_EXCLUDE = ("Germline", None, "BUILDING")
#: Steps that count: the node itself and those on its path that are not excluded.
_PATH = """, skip AS (SELECT tree_id, name, {skip} AS skip FROM nodes),
  path AS (SELECT g.tree_id, g.node AS name, g.dist AS distance, count(*) FILTER (NOT s.skip AND s.name <> 'Germline') AS steps
    FROM closure g JOIN closure up ON up.tree_id = g.tree_id AND up.node = g.node JOIN skip s ON s.tree_id = g.tree_id AND s.name = up.anc WHERE g.anc = 'Germline' GROUP BY ALL)"""


def _add(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = make(*forest(spark, d))
        return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    REGISTRY.add(name, run, f"{_CLOSURE}{sql}" if sql else None)


_add(
    "summarize_subtrees",
    lambda n, e: T.summarize_subtrees(n, e, ["annotation"]),
    """, s AS (SELECT tree_id, anc AS name, count(*) AS size, max(steps) + 1 AS depth, max(dist) AS pathlength, count(*) FILTER (steps = 1) AS outdegree FROM closure GROUP BY ALL)
    SELECT s.tree_id, s.name, annotation, e.parent, outdegree, size, CAST(depth AS BIGINT) AS depth, round(pathlength, 6) AS pathlength, round(outdegree / sum(outdegree) OVER w, 6) AS outdegree_norm,
      round(size / max(size) OVER w, 6) AS size_norm, round(depth / max(depth) OVER w, 6) AS depth_norm, round(pathlength / max(pathlength) OVER w, 6) AS pathlength_norm
    FROM s JOIN nodes n ON n.tree_id = s.tree_id AND n.name = s.name LEFT JOIN edges e ON e.tree_id = s.tree_id AND e.child = s.name WINDOW w AS (PARTITION BY s.tree_id)""",
)
_add("path_lengths", lambda n, e: T.path_lengths(n, e), _PATH.format(skip="false") + " SELECT tree_id, name, steps, distance FROM path")
_add("path_lengths_exclude", lambda n, e: T.path_lengths(n, e, field="annotation", exclude=_EXCLUDE), _PATH.format(skip=_SKIP) + " SELECT tree_id, name, steps, distance FROM path")
for _how in ("distance", "steps"):
    _add(
        f"mrca_{_how}",
        lambda n, e, how=_how: T.mrca(n, e, path=how, field="annotation", exclude=_EXCLUDE).select("tree_id", "name", "annotation", "steps", "distance"),
        _PATH.format(skip=_SKIP)
        + f""" SELECT tree_id, name, annotation, steps, distance FROM path JOIN nodes USING (tree_id, name) WHERE NOT ({_SKIP}) AND name <> 'Germline'
        QUALIFY {_how} = min({_how}) OVER (PARTITION BY tree_id)""",
    )
_add(
    "table_edges",
    lambda n, e: T.table_edges(n, e, "annotation"),
    " SELECT e.tree_id, p.annotation AS parent, c.annotation AS child, count(*) AS count FROM edges e JOIN nodes p ON p.tree_id = e.tree_id AND p.name = e.parent JOIN nodes c ON c.tree_id = e.tree_id AND c.name = e.child GROUP BY ALL",
)
_add(
    "table_edges_indirect",
    lambda n, e: T.table_edges(n, e, "annotation", indirect=True, exclude=_EXCLUDE),
    f""", k AS (SELECT tree_id, name, annotation, {_SKIP} AS skip FROM nodes),
    pair AS (SELECT p.tree_id, p.annotation AS parent, c.annotation AS child FROM closure x JOIN k p ON p.tree_id = x.tree_id AND p.name = x.anc JOIN k c ON c.tree_id = x.tree_id AND c.name = x.node
      WHERE x.steps > 0 AND NOT p.skip AND NOT c.skip AND NOT EXISTS (SELECT 1 FROM closure a JOIN closure b ON b.tree_id = a.tree_id AND b.anc = a.node JOIN k m ON m.tree_id = a.tree_id AND m.name = a.node
        WHERE a.tree_id = x.tree_id AND a.anc = x.anc AND b.node = x.node AND a.steps > 0 AND b.steps > 0 AND NOT m.skip))
    SELECT tree_id, parent, child, count(*) AS count FROM pair GROUP BY ALL""",
)

# Permutations: labels follow from a digest, so SQL draws the same ------------------------------------------------------------
def _permuted(rounds: int) -> str:
    return f""", kept AS (SELECT tree_id, name, annotation FROM nodes WHERE annotation IS NOT NULL), it AS (SELECT CAST(unnest(range(1, {rounds} + 1)) AS INTEGER) AS iter),
  drawn AS (SELECT *, row_number() OVER (PARTITION BY iter, tree_id ORDER BY name) AS fixed,
    row_number() OVER (PARTITION BY iter, tree_id ORDER BY md5('42|' || CAST(iter AS VARCHAR) || '|' || CAST(tree_id AS VARCHAR) || '|' || name), name) AS place FROM kept, it),
  perm AS (SELECT a.iter, a.tree_id, a.name, b.annotation FROM drawn a JOIN drawn b ON b.iter = a.iter AND b.tree_id = a.tree_id AND b.place = a.fixed)"""


_NEAR = _PATH.format(skip="annotation IS NULL") + """, near AS (SELECT tree_id, name, annotation FROM path JOIN nodes USING (tree_id, name) WHERE annotation IS NOT NULL AND name <> 'Germline'
    QUALIFY distance = min(distance) OVER (PARTITION BY tree_id)),
  ones AS (SELECT annotation, count(*) AS count FROM (SELECT tree_id, min(annotation) AS annotation FROM near GROUP BY tree_id HAVING min(annotation) = max(annotation)) GROUP BY annotation)"""
_ROUNDS = """, counted AS (SELECT iter, annotation, count(*) AS count FROM (SELECT iter, tree_id, min(p.annotation) AS annotation FROM perm p JOIN near USING (tree_id, name) GROUP BY ALL
    HAVING min(p.annotation) = max(p.annotation)) GROUP BY ALL)"""
_add("permute_labels", lambda n, e: T.permute_labels(n, "annotation"), _permuted(1) + " SELECT iter, tree_id, name, annotation FROM perm")
_add(
    "test_mrca",
    lambda n, e: T.mrca_test(n, e, "annotation")[0],
    _permuted(200) + _NEAR + _ROUNDS + """ SELECT o.annotation, o.count, round(sum(c.count) / count(c.count), 6) AS expected, round(sum(CASE WHEN c.count > o.count THEN 1 ELSE 0 END) / count(c.count), 6) AS pvalue
    FROM ones o LEFT JOIN counted c ON c.annotation = o.annotation GROUP BY ALL""",
)
_add(
    "mrca_histogram",
    lambda n, e: T.permutation_histogram(T.mrca_test(n, e, "annotation")[1], ["annotation"]),
    _permuted(200) + _NEAR + _ROUNDS + """, s AS (SELECT min(count) AS lo, greatest((max(count) - min(count)) / 50, 1e-9) AS width FROM counted)
    SELECT annotation, CAST(least(floor((count - lo) / width), 49) AS INTEGER) AS bin, round(lo + least(floor((count - lo) / width), 49) * width, 6) AS low, count(*) AS rounds FROM counted, s GROUP BY ALL""",
)
_EDGES = """ SELECT o.parent, o.child, o.count, round(sum(c.count) / count(c.count), 6) AS expected, round(sum(CASE WHEN c.count > o.count THEN 1 ELSE 0 END) / count(c.count), 6) AS pvalue
    FROM seen o LEFT JOIN counted c ON c.parent = o.parent AND c.child = o.child GROUP BY ALL"""
_LABELLED = """, seen AS (SELECT p.annotation AS parent, c.annotation AS child, count(*) AS count FROM pair e JOIN nodes p ON p.tree_id = e.tree_id AND p.name = e.parent JOIN nodes c ON c.tree_id = e.tree_id AND c.name = e.child
    WHERE p.annotation IS NOT NULL AND c.annotation IS NOT NULL GROUP BY ALL),
  counted AS (SELECT p.iter, p.annotation AS parent, c.annotation AS child, count(*) AS count FROM pair e JOIN perm p ON p.tree_id = e.tree_id AND p.name = e.parent
    JOIN perm c ON c.tree_id = e.tree_id AND c.name = e.child AND c.iter = p.iter GROUP BY ALL)"""
_DIRECT = ", pair AS (SELECT tree_id, parent, child FROM edges)"
_INDIRECT = """, k AS (SELECT tree_id, name, annotation IS NULL AS skip FROM nodes),
  pair AS (SELECT x.tree_id, x.anc AS parent, x.node AS child FROM closure x JOIN k p ON p.tree_id = x.tree_id AND p.name = x.anc JOIN k c ON c.tree_id = x.tree_id AND c.name = x.node
    WHERE x.steps > 0 AND NOT p.skip AND NOT c.skip AND NOT EXISTS (SELECT 1 FROM closure a JOIN closure b ON b.tree_id = a.tree_id AND b.anc = a.node JOIN k m ON m.tree_id = a.tree_id AND m.name = a.node
      WHERE a.tree_id = x.tree_id AND a.anc = x.anc AND b.node = x.node AND a.steps > 0 AND b.steps > 0 AND NOT m.skip))"""
_add("test_edges", lambda n, e: T.edge_test(n, e, "annotation")[0], _permuted(200) + _DIRECT + _LABELLED + _EDGES)
_add("test_edges_indirect", lambda n, e: T.edge_test(n, e, "annotation", indirect=True)[0], _permuted(200) + _INDIRECT + _LABELLED + _EDGES)
