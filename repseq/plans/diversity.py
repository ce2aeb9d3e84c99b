"""Queries over diversity, with their SQL where it is deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.operators import diversity as D
from repseq.operators.clones import count_clones
from repseq.plans.fixtures import WITH_AIRR, airr
from repseq.plans.registry import Registry

REGISTRY = Registry()
_COUNTS = f"{WITH_AIRR}, c AS (SELECT sample_id, clone_id, CAST(count(*) AS DOUBLE) AS x FROM airr WHERE clone_id IS NOT NULL GROUP BY ALL), s AS (SELECT sample_id, sum(x) AS n, CAST(count(*) FILTER (x = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (x = 2) AS DOUBLE) AS f2 FROM c GROUP BY 1)"
_C1 = "CASE WHEN f2 > 0 THEN 1 - (f1 / n) * ((n - 1) * f1 / ((n - 1) * f1 + 2 * f2)) WHEN f1 = 0 THEN 1.0::DOUBLE ELSE 1 - (f1 / n) * ((n - 1) * (f1 - 1) / ((n - 1) * (f1 - 1) + 2)) END"
_F0 = "CAST(ceil(CASE WHEN f2 > 0 THEN (n - 1) * f1 * f1 / (2 * n * f2) ELSE (n - 1) * f1 * (f1 - 1) / (2 * n) END) AS BIGINT)"
_ADJ = f", w AS (SELECT c.*, n, {_C1} AS c1 FROM c JOIN s USING (sample_id)), l AS (SELECT *, (1 - c1) / sum(x / n * exp(-x)) OVER (PARTITION BY sample_id) AS lam FROM w), a AS (SELECT sample_id, clone_id, x / n * (1 - lam * exp(-x)) AS p FROM l)"
_UN = f", k AS (SELECT sample_id, {_F0} AS k, {_C1} AS c1 FROM s), u AS (SELECT sample_id, 'U' || CAST(i AS VARCHAR) AS clone_id, (1 - c1) / k AS p FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM k WHERE k > 0))"


def _add(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None, digits: int = 6) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        counts = count_clones(airr(spark, d).drop("cell_id"), "sample_id").select("sample_id", "clone_id", F.col("seq_count").alias("x"))
        out = make(counts)
        return out.select(*(F.round(c, digits).alias(c) if t == "double" and c != "q" else F.col(c) for c, t in out.dtypes))

    REGISTRY.add(name, run, f"{_COUNTS}{sql}" if sql else None)


_Q = [0.0, 0.5, 1.0, 2.0, 4.0]
_add("coverage_1", lambda c: D.coverage(c, "x", "sample_id"), f" SELECT sample_id, round({_C1}, 6) AS coverage FROM s")
_add(
    "coverage_2",
    lambda c: D.coverage(c, "x", "sample_id", r=2),
    """, t AS (SELECT sample_id, sum(x) AS n, CAST(count(*) FILTER (x = 2) AS DOUBLE) AS fr, CAST(count(*) FILTER (x = 3) AS DOUBLE) AS fs, sum(x * x) FILTER (x >= 2) AS pw FROM c GROUP BY 1)
    SELECT sample_id, round(1 - (2 * fr / pw) * pow((n - 2) * fr / ((n - 2) * fr + 3 * fs), 2), 6) AS coverage FROM t""",
)
_add("unseen_count", lambda c: D.unseen_count(c, "x", "sample_id"), f" SELECT sample_id, {_F0} AS unseen FROM s")
_add("adjusted_abundance", lambda c: D.adjusted_abundance(c, "clone_id", "x", "sample_id"), f"{_ADJ} SELECT sample_id, clone_id, round(p, 9) AS p FROM a", 9)
_add("unseen_abundance", lambda c: D.unseen_abundance(c, "x", "sample_id"), f"{_UN} SELECT sample_id, clone_id, round(p, 9) AS p FROM u", 9)
_add("complete_abundance", lambda c: D.complete_abundance(c, "clone_id", "x", "sample_id"), f"{_ADJ}{_UN} SELECT sample_id, clone_id, round(p, 9) AS p FROM a UNION ALL SELECT sample_id, clone_id, round(p, 9) FROM u", 9)
_HILL = """, q AS (SELECT CAST(unnest([0.0, 0.5, 1.0, 2.0, 4.0]) AS DOUBLE) AS q), o AS (SELECT q, CASE WHEN q = 1 THEN 0.9999::DOUBLE ELSE q END AS o FROM q),
  h AS (SELECT sample_id, q, pow(sum(pow(x / n, o)), 1 / (1 - any_value(o))) AS d FROM c JOIN s USING (sample_id), o GROUP BY ALL)"""
_add("hill_numbers", lambda c: D.diversity(c, "x", _Q, "sample_id"), f"{_HILL} SELECT sample_id, q, round(d, 6) AS d FROM h")


def _evenness(c: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    h = D.diversity(c, "x", _Q, "sample_id")
    return h.withColumn("e", F.col("d") / F.max(F.when(F.col("q") == 0, F.col("d"))).over(W.partitionBy("sample_id")))


_add("hill_evenness", _evenness, f"{_HILL} SELECT sample_id, q, round(d, 6) AS d, round(d / max(d) FILTER (q = 0) OVER (PARTITION BY sample_id), 6) AS e FROM h")
_M = 300
_add(
    "rarefied_coverage",
    lambda c: D.rarefied_coverage(c, "x", _M, "sample_id"),
    f""" SELECT sample_id, round(1 - sum(CASE WHEN n - x >= {_M} THEN x / n * exp(lgamma(n - x + 1) - lgamma(n - {_M} - x + 1) - lgamma(n) + lgamma(n - {_M})) ELSE 0 END), 6) AS coverage
    FROM c JOIN s USING (sample_id) GROUP BY sample_id""",
)
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"
_add(
    "rarefied_diversity",
    lambda c: D.rarefied_diversity(c, "x", _Q, _M, "sample_id"),
    f""", q AS (SELECT CAST(unnest([0.0, 0.5, 1.0, 2.0, 4.0]) AS DOUBLE) AS q), o AS (SELECT q, CASE WHEN q = 1 THEN 0.9999::DOUBLE ELSE q END AS o FROM q),
    t AS (SELECT sample_id, n, x, CAST(count(*) AS DOUBLE) AS f FROM c JOIN s USING (sample_id) WHERE x <= {_M} GROUP BY ALL),
    k AS (SELECT *, CAST(unnest(range(1, CAST(x AS INT) + 1)) AS DOUBLE) AS k FROM t),
    e AS (SELECT sample_id, k, sum(exp({_LC.format('x', 'k')} + {_LC.format('(n - x)', f'{_M} - k')} - {_LC.format('n', str(_M))}) * f) AS fk FROM k WHERE n - x >= {_M} - k GROUP BY ALL)
    SELECT sample_id, q, round(pow(sum(pow(k / {_M}, o) * fk), 1 / (1 - any_value(o))), 3) AS d FROM e, o GROUP BY ALL""",
    3,  # order 0.9999 raises the rounding of lgamma to the power 10,000
)


# Random results: rows only ----------------------------------------------------------------------------------------------
def _curve(spark: SparkSession, d: str) -> D.AbundanceCurve:
    return D.estimate_abundance(airr(spark, d).drop("cell_id"), group="sample_id")


REGISTRY.add("estimate_abundance", lambda spark, d: _curve(spark, d).abundance)
REGISTRY.add("alpha_diversity", lambda spark, d: D.alpha_diversity(_curve(spark, d), step_q=0.5).diversity)
REGISTRY.add("alpha_tests", lambda spark, d: D.alpha_diversity(_curve(spark, d), step_q=1).tests)
REGISTRY.add("beta_diversity", lambda spark, d: D.beta_diversity(_curve(spark, d), {"F-O": ["F", "O"], "all": ["F", "O", "P"]}, step_q=1))
REGISTRY.add("stouffer_meta", lambda spark, d: spark.createDataFrame([D.stouffer_meta([0.1, 0.05, 0.3]), D.stouffer_meta([0.1, 0.05, 0.3], [5, 3, 1])], "z double, pvalue double"))
_TEST = """, i AS (SELECT sample_id AS g, k AS iter, CAST(q AS DOUBLE) AS q, sum(pow(x, q)) FILTER (length(clone_id) % 3 <> k) AS d FROM c, (SELECT unnest(range(0, 4)) AS k), (SELECT unnest([0, 1, 2]) AS q) GROUP BY ALL),
  p AS (SELECT a.g || ' != ' || b.g AS test, a.q, a.d - b.d AS delta FROM i a JOIN i b ON a.iter = b.iter AND a.q = b.q AND a.g < b.g),
  t AS (SELECT test, q, avg(delta) AS m, stddev_samp(delta) AS sd, CASE WHEN avg(delta) >= 0 THEN avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END) END AS p0 FROM p GROUP BY ALL)"""


def _fixed_tests(c: DataFrame) -> DataFrame:
    k = c.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("q", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))))
    d = F.sum(F.when(F.length("clone_id") % 3 != F.col("iter"), F.pow(F.col("x").cast("double"), F.col("q"))))
    return D.diversity_tests(k.groupBy("sample_id", "iter", "q").agg(d.alias("d")), "sample_id")


_add("diversity_tests_fixed", _fixed_tests, f"{_TEST} SELECT test, q, round(abs(m), 6) AS delta_mean, round(sd, 6) AS delta_sd, round(CASE WHEN p0 <= 0.5 THEN 2 * p0 ELSE 2 * (1 - p0) END, 6) AS pvalue FROM t")
