"""Queries over grouping, collapsing and clones, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.operators.collapse import collapse_duplicates
from repseq.operators.grouping import group_genes
from repseq.plans.fixtures import WITH_AIRR, airr
from repseq.plans.registry import Registry
from repseq.plans.usage import sql_gene

REGISTRY = Registry()


# Grouping --------------------------------------------------------------------------------------------------------------
def _group_sql(first: bool = False, length: bool = False, cells: str | None = None) -> str:
    v, j = sql_gene("v_call", first=first), sql_gene("j_call", first=first)
    tail = " || '@' || jl" if length else ""
    heavy = "AND locus IN ('IGH', 'TRB', 'TRD')" if cells else ""
    pool = "UNION SELECT (SELECT min(keys[1]) FROM c JOIN r USING (combo) WHERE cell_id IS NULL), c.keys[1] FROM c JOIN r USING (combo) WHERE cell_id IS NULL" if cells == "pooled" else ""
    base = f"""{WITH_AIRR}, g AS (SELECT *, {v} AS v, {j} AS j, CAST(duplicate_count % 4 AS VARCHAR) AS jl FROM airr),
      r AS (SELECT *, v || '#' || j{" || '#' || jl" if length else ""} AS combo FROM g WHERE v IS NOT NULL AND j IS NOT NULL {heavy}),
      c AS (SELECT combo, list_sort(list_distinct(flatten(list_transform(string_split(any_value(v), ','), lambda a: list_transform(string_split(any_value(j), ','), lambda b: a || '@' || b{tail.replace("jl", "any_value(jl)")}))))) AS keys FROM r GROUP BY combo),
      e AS (SELECT keys[1] AS a, unnest(keys) AS b FROM c {pool}), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      reach AS (SELECT DISTINCT a AS node, a AS seen FROM f UNION SELECT reach.node, f.b FROM reach JOIN f ON f.a = reach.seen),
      l AS (SELECT node, min(seen) AS label FROM reach GROUP BY node),
      n AS (SELECT combo, label FROM c JOIN l ON l.node = c.keys[1]), k AS (SELECT combo, 'G' || dense_rank() OVER (ORDER BY label) AS vj_group FROM n)"""
    base = base.replace("WITH airr", "WITH RECURSIVE airr", 1)
    if not cells:
        return f"{base} SELECT sequence_id, vj_group FROM r JOIN k USING (combo)"
    celled = "SELECT sequence_id, vj_group FROM airr LEFT JOIN (SELECT cell_id, vj_group FROM r JOIN k USING (combo) WHERE cell_id IS NOT NULL) USING (cell_id) WHERE airr.cell_id IS NOT NULL"
    loose = "SELECT sequence_id, CASE WHEN locus IN ('IGH', 'TRB', 'TRD') THEN (SELECT min(vj_group) FROM r JOIN k USING (combo) WHERE cell_id IS NULL) END FROM airr WHERE cell_id IS NULL"
    if cells == "independent":
        loose = "SELECT a.sequence_id, vj_group FROM airr a LEFT JOIN (SELECT sequence_id, vj_group FROM r JOIN k USING (combo)) USING (sequence_id) WHERE cell_id IS NULL"
    return f"{base} {celled} UNION ALL {loose}"


def _groups(name: str, sql: str, cells: bool = False, **how) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        data = airr(spark, d).withColumn("junction_group", F.col("duplicate_count") % 4)
        if cells:  # one heavy chain a cell: others of the cell get a cell of their own
            data = _single(data)
        return group_genes(data, **how).select("sequence_id", "vj_group")

    REGISTRY.add(name, run, sql)


def _single(data: DataFrame) -> DataFrame:
    """Cells by order number, so that each holds one heavy chain at most."""
    own = F.when(F.col("cell_id").isNotNull(), F.concat(F.lit("s"), F.when(F.col("locus") == "IGH", F.col("sequence_id")).otherwise(F.col("cell_id"))))
    return data.withColumn("cell_id", own)


_CELL = "CASE WHEN cell_id IS NOT NULL THEN 's' || CASE WHEN locus = 'IGH' THEN sequence_id ELSE cell_id END END AS cell_id"


def _celled(sql: str) -> str:
    return sql.replace("WITH RECURSIVE airr AS (SELECT * FROM", f"WITH RECURSIVE airr AS (SELECT * REPLACE ({_CELL}) FROM", 1)


_groups("group_genes", _group_sql())
_groups("group_genes_first", _group_sql(first=True), first=True)
_groups("group_genes_junc_len", _group_sql(length=True), junc_len="junction_group")
_groups("group_genes_cell", _celled(_group_sql(cells="pooled")), cells=True, cell_id="cell_id")
_groups("group_genes_cell_independent", _celled(_group_sql(cells="independent")), cells=True, cell_id="cell_id", mixed_bulk="independent")


# Collapsing ------------------------------------------------------------------------------------------------------------
_FIELDS = ["sample_id", "clone_id"]
_SAME = "length({0}) = length({1}) AND len(list_filter(range(1, length({0}) + 1), lambda i: substr({0}, CAST(i AS INT), 1) <> substr({1}, CAST(i AS INT), 1) AND strpos('N-.?', substr({0}, CAST(i AS INT), 1)) = 0 AND strpos('N-.?', substr({1}, CAST(i AS INT), 1)) = 0)) = 0"
_COLLAPSE = f"""{WITH_AIRR.replace("WITH airr", "WITH RECURSIVE airr", 1)}, x AS (SELECT *, sample_id || '|' || coalesce(clone_id, '') AS b, sequence_alignment AS s, length(translate(sequence_alignment, 'N-.?', '')) AS info FROM airr),
  u AS (SELECT DISTINCT b, s FROM x),
  e AS (SELECT p.b, p.s AS s1, q.s AS s2 FROM u p JOIN u q ON p.b = q.b AND (p.s = q.s OR ({_SAME.format("p.s", "q.s")}))),
  amb AS (SELECT DISTINCT l.b, l.s1 AS s FROM e l JOIN e r ON l.b = r.b AND l.s1 = r.s1 AND l.s2 < r.s2 ANTI JOIN e t ON t.b = l.b AND t.s1 = l.s2 AND t.s2 = r.s2),
  y AS (SELECT x.*, amb.s IS NOT NULL AS amb, count(*) FILTER (amb.s IS NULL) OVER (PARTITION BY x.b) AS clear FROM x LEFT JOIN amb ON amb.b = x.b AND amb.s = x.s),
  cl AS (SELECT e.b, e.s1 AS s, min(e.s2) AS cluster FROM e ANTI JOIN amb a1 ON a1.b = e.b AND a1.s = e.s1 ANTI JOIN amb a2 ON a2.b = e.b AND a2.s = e.s2 GROUP BY ALL),
  z AS (SELECT y.*, cl.cluster FROM y LEFT JOIN cl ON cl.b = y.b AND cl.s = y.s),
  reach AS (SELECT DISTINCT b, s1 AS node, s1 AS seen FROM e WHERE b IN (SELECT b FROM y WHERE clear <= 1) UNION SELECT reach.b, reach.node, e.s2 FROM reach JOIN e ON e.b = reach.b AND e.s1 = reach.seen),
  st AS (SELECT b, node, min(seen) AS st FROM reach GROUP BY ALL),
  few AS (SELECT z.*, st.st, row_number() OVER (PARTITION BY z.b, st.st ORDER BY info DESC, sequence_id) = 1 AS pick FROM z JOIN st ON st.b = z.b AND st.node = z.s WHERE clear <= 1)"""


def _collapse(spark: SparkSession, d: str) -> DataFrame:
    out = collapse_duplicates(airr(spark, d), fields=_FIELDS, text_fields=["c_call"], num_fields=["duplicate_count"], seq_fields=["germline_alignment"], add_count=True)
    return out.select("sequence_id", "sample_id", "clone_id", "sequence_alignment", "c_call", "duplicate_count", "germline_alignment", "collapse_count")


_COLS = "sequence_id, sample_id, clone_id, sequence_alignment"
REGISTRY.add(
    "collapse_duplicates",
    _collapse,
    f"""{_COLLAPSE} SELECT arg_min(sequence_id, k) AS sequence_id, any_value(sample_id) AS sample_id, any_value(clone_id) AS clone_id, arg_min(s, k) AS sequence_alignment,
      array_to_string(list_sort(list_distinct(list(c_call))), ',') AS c_call, CAST(sum(duplicate_count) AS BIGINT) AS duplicate_count,
      arg_min(germline_alignment, row(-length(translate(germline_alignment, 'N-.?', '')), sequence_id)) AS germline_alignment, count(*) AS collapse_count
      FROM (SELECT *, row(-info, sequence_id) AS k FROM z WHERE clear > 1 AND NOT amb) GROUP BY b, cluster
      UNION ALL SELECT {_COLS}, c_call, duplicate_count, germline_alignment, 1 FROM few WHERE pick""",
)


def _dry(spark: SparkSession, d: str) -> DataFrame:
    out = collapse_duplicates(airr(spark, d), fields=_FIELDS, dry=True)
    return out.select("sequence_id", "collapse_id", "collapse_class", "collapse_pass")


REGISTRY.add(
    "collapse_dry",
    _dry,
    f"""{_COLLAPSE}, per AS (SELECT b, cluster, count(*) AS size, min(sequence_id) AS first, arg_min(sequence_id, row(-info, sequence_id)) AS best FROM z WHERE clear > 1 AND NOT amb GROUP BY ALL),
      num AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY first) AS n FROM per),
      t AS (SELECT DISTINCT e.b, e.s1 AS s, num.n, num.cluster FROM e JOIN amb ON amb.b = e.b AND amb.s = e.s1 JOIN cl ON cl.b = e.b AND cl.s = e.s2 JOIN num ON num.b = e.b AND num.cluster = cl.cluster),
      ls AS (SELECT b, s, array_to_string(list_sort(list(DISTINCT n)), ',') AS ls FROM t GROUP BY ALL), tc AS (SELECT DISTINCT b, cluster FROM t),
      sets AS (SELECT b, st, min(sequence_id) AS first, count(*) AS members FROM few GROUP BY ALL), sn AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY first) AS n FROM sets)
      SELECT sequence_id, CASE WHEN amb THEN ls ELSE CAST(n AS VARCHAR) END AS collapse_id,
        CASE WHEN amb THEN 'ambiguous' WHEN size > 1 THEN 'duplicated' WHEN tc.cluster IS NOT NULL THEN 'ambiguous_duplicate' ELSE 'unique' END AS collapse_class,
        CASE WHEN amb THEN false WHEN size > 1 THEN sequence_id = best ELSE true END AS collapse_pass
      FROM z LEFT JOIN num ON num.b = z.b AND num.cluster = z.cluster LEFT JOIN tc ON tc.b = z.b AND tc.cluster = z.cluster LEFT JOIN ls ON ls.b = z.b AND ls.s = z.s WHERE clear > 1
      UNION ALL SELECT sequence_id, CAST(n AS VARCHAR), CASE WHEN amb THEN 'ambiguous' WHEN members > 1 THEN 'ambiguous_duplicate' ELSE 'unique' END, pick
      FROM few JOIN sn ON sn.b = few.b AND sn.st = few.st""",
)
