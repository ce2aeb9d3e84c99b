"""Receptor-shaped views over the driver's tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repseq.session import spread

#: One rearrangement per order.
AIRR = """
SELECT concat('S', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS sequence_id,
       o_orderstatus AS sample_id,
       concat('IGH', substr('MDGAE', CAST(1 + o_custkey % 5 AS INT), 1)) AS c_call,
       loc AS locus,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL
            ELSE concat('Homsap ', loc, 'V', CAST(1 + o_custkey % 4 AS STRING),
                        CASE WHEN o_custkey % 13 = 0 THEN 'D' ELSE '' END, '-', CAST(1 + o_custkey % 12 AS STRING),
                        '*0', CAST(1 + o_orderkey % 3 AS STRING), ' F',
                        CASE WHEN o_custkey % 50 = 0
                             THEN concat(',Homsap ', loc, 'V', CAST(1 + o_custkey % 4 AS STRING), '-', CAST(1 + (o_custkey + 4) % 12 AS STRING), '*01 F')
                             ELSE '' END) END AS v_call,
       concat('Homsap ', loc, 'J', CAST(1 + o_orderkey % 6 AS STRING), '*0', CAST(1 + o_orderkey % 2 AS STRING), ' F') AS j_call,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL
            WHEN o_orderkey % 3 = 0 THEN concat('c', CAST(CAST(floor(o_orderkey / 9) AS BIGINT) AS STRING))
            ELSE concat('k', CAST(o_custkey % 211 AS STRING)) END AS clone_id,
       CAST(1 + o_orderkey % 9 AS BIGINT) AS duplicate_count,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('cell', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)) END AS cell_id,
       translate(concat('323', lpad(CAST(o_custkey * 7919 % 1000003 AS STRING), 9, '7'),
                        lpad(CAST(o_orderkey % 64 * 104729 % 1000003 AS STRING), 9, '4'), '322'),
                 '0123456789', 'ACGTACGTAC') AS junction,
       CASE o_orderkey % 10 WHEN 0 THEN concat('N', substr(base, 2)) WHEN 1 THEN concat(substr(base, 1, 6), '---', substr(base, 10))
                            WHEN 2 THEN concat(substr(base, 1, 14), 'NNNNNNN', substr(base, 22)) WHEN 3 THEN concat('..', substr(base, 3)) ELSE base END AS sequence_alignment,
       concat(substr(base, 1, 12), 'NNNNNN', substr(base, 19)) AS germline_alignment
FROM (SELECT *, translate(concat('323', lpad(CAST(o_custkey % 40 * 7919 % 1000003 AS STRING), 9, '7'),
                                 lpad(CAST(o_orderkey % 8 * 104729 % 1000003 AS STRING), 9, '4'), '322'),
                          '0123456789', 'ACGTACGTAC') AS base, CASE o_custkey % 4 WHEN 0 THEN 'IGK' WHEN 1 THEN 'IGL' ELSE 'IGH' END AS loc FROM orders) o
"""

#: One lineage tree per nation, a complete binary shape over its customers.
FOREST = """
r AS (SELECT c_nationkey AS tree_id, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer),
nodes AS (SELECT tree_id, rn, CASE WHEN rn = 0 THEN 'Germline' ELSE concat('n', CAST(rn AS STRING)) END AS name,
  CASE WHEN rn = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS annotation, CAST(1 + c_custkey % 7 AS DOUBLE) AS weight,
  CASE WHEN rn = 0 THEN NULL WHEN rn = 1 THEN 0 ELSE CAST(1 + floor((rn - 2) / 2) AS BIGINT) END AS parent_rn FROM r),
edges AS (SELECT c.tree_id, p.name AS parent, c.name AS child, c.weight FROM nodes c JOIN nodes p ON p.tree_id = c.tree_id AND p.rn = c.parent_rn)
"""

def _with(columns: str = "*") -> str:
    return f"WITH airr AS (SELECT {columns} FROM ({AIRR}) _a)"


#: Common table expressions for the SQL of a query.
WITH_AIRR = _with()
WITH_FOREST = f"WITH {FOREST.strip()}"


def airr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rearrangement view over ``orders``."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return spark.sql(AIRR.replace("FROM orders)", "FROM {orders})"), orders=orders)


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the lineage trees over ``customer``."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = WITH_FOREST.replace("FROM customer)", "FROM {customer})")
    nodes = spark.sql(text + " SELECT tree_id, rn, name, annotation, weight FROM nodes", customer=customer)
    edges = spark.sql(text + " SELECT tree_id, parent, child, weight FROM edges", customer=customer)
    return nodes, edges
