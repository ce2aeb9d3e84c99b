"""Queries over gene calls, gene usage and clones, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.functions import calls as C
from repseq.operators.checks import single_cell_violations, translate_strings
from repseq.operators.clones import count_clones
from repseq.operators.usage import count_genes
from repseq.plans.fixtures import WITH_AIRR, airr
from repseq.plans.registry import Registry

REGISTRY = Registry()
_EDGE = r"[^,]*"


def _sql_extract(col: str, pattern: str) -> str:
    return rf"regexp_replace({col}, '{_EDGE}{pattern}{_EDGE}', '\1', 'g')"


def _sql_strip_d(x: str) -> str:
    return rf"regexp_replace({x}, '([A-Z0-9][0-9])D(\*|-|,|$)', '\1\2', 'g')"


def _sql_first(x: str) -> str:
    return f"regexp_replace({x}, ',.*$', '')"


def _sql_distinct(x: str) -> str:
    parts = f"string_split(regexp_replace({x}, ',$', ''), ',')"
    return f"array_to_string(list_filter({parts}, lambda x, i: list_position({parts}, x) = i), ',')"


def sql_gene(col: str = "v_call", pattern: str = C.GENE, first: bool = True) -> str:
    x = _sql_strip_d(_sql_extract(col, pattern))
    return _sql_first(x) if first else _sql_distinct(x)


# Calls -----------------------------------------------------------------------------------------------------------------
def _call_query(name: str, column, sql: str, source: str = "v_call") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return airr(spark, d).select("sequence_id", column(source).alias("call"))

    REGISTRY.add(name, run, f"{WITH_AIRR} SELECT sequence_id, {sql} AS call FROM airr")


for _name, _fn, _pattern in (("allele", C.get_allele, C.ALLELE), ("gene", C.get_gene, C.GENE), ("family", C.get_family, C.FAMILY), ("locus", C.get_locus, C.LOCUS)):
    _call_query(f"get_{_name}", _fn, sql_gene("v_call", _pattern))
_call_query("get_gene_j", C.get_gene, sql_gene("j_call"), "j_call")
_locus = _sql_first(_sql_strip_d(_sql_extract("v_call", C.LOCUS)))
_call_query("get_chain", C.get_chain, f"regexp_replace(regexp_replace({_locus}, '(IGH)|(TR[BD])', 'VH', 'g'), '(IG[KL])|(TR[AG])', 'VL', 'g')")
_call_query("get_gene_all", lambda c: C.get_gene(c, first=False), sql_gene(first=False))
_call_query("get_gene_nocollapse", lambda c: C.get_gene(c, first=False, collapse=False), _sql_strip_d(_sql_extract("v_call", C.GENE)))
_call_query("get_gene_keep_d", lambda c: C.get_gene(c, strip_d=False), _sql_first(_sql_extract("v_call", C.GENE)))
_nl = _sql_extract("regexp_replace(v_call, 'V1-', 'V1-NL', 'g')", C.ALLELE)
_nl = f"regexp_replace({_nl}, '{C.NON_LOCALISED.format(sep=',')}', '', 'g')"
_call_query("get_gene_omit_nl", lambda c: C.get_gene(F.regexp_replace(c, "V1-", "V1-NL"), first=False, omit_nl=True), _sql_distinct(_sql_strip_d(_sql_extract(_nl, C.GENE))))


def _sort(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.sort_genes(airr(spark, d).select(F.col("v_call").alias("call")).where("call IS NOT NULL").distinct(), "call", method=method)

    return run


def _sort_sql(order: str) -> str:
    gene = _sql_first(_sql_extract("one", C.GENE))
    return rf"""{WITH_AIRR}, d AS (SELECT DISTINCT v_call FROM airr WHERE v_call IS NOT NULL),
      o AS (SELECT {_sql_distinct(_sql_extract("v_call", C.ALLELE))} AS one FROM d),
      k AS (SELECT one AS call, {_sql_first(_sql_extract("one", C.FAMILY))} AS family,
        coalesce(TRY_CAST(regexp_replace(regexp_replace({gene}, '[^-]+-([^-*D]+).*', '\1', 'g'), '[^0-9]+', '99', 'g') AS DOUBLE), 0) AS g1,
        coalesce(TRY_CAST(regexp_replace(regexp_replace({gene}, '[^-]+-[^-]+-?', '', 'g'), '[^0-9]+', '99', 'g') AS DOUBLE), 0) AS g2,
        coalesce(TRY_CAST(regexp_replace({_sql_first(_sql_extract("one", C.ALLELE))}, '^([^*]+\*|[^*]+$)', '') AS DOUBLE), 0) AS a1 FROM o)
      SELECT call, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM k"""


REGISTRY.add("sort_genes_name", _sort("name"), _sort_sql("family, g1, g2, a1, call"))
REGISTRY.add("sort_genes_position", _sort("position"), _sort_sql("g1 DESC, g2 DESC, family, a1, call"))


# Gene usage ------------------------------------------------------------------------------------------------------------
def _usage(name: str, sql: str, drop: tuple = ("cell_id",), gene: str = "v_call", groups=("sample_id",), **how) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = count_genes(airr(spark, d).drop(*drop), gene, list(groups), **how)
        return out.select(*(F.round(c, 9).alias(c) if c.endswith("_freq") else F.col(c) for c in out.columns))

    REGISTRY.add(name, run, sql)


def _usage_sql(gene: str, groups: str = "sample_id", copy: bool = False, where: str = "WHERE v_call IS NOT NULL") -> str:
    g = f"{groups}, " if groups else ""
    more = ", CAST(sum(duplicate_count) AS BIGINT) AS copy_count" if copy else ""
    w = f"OVER (PARTITION BY {g}locus)"
    extra = f", CAST(sum(copy_count) {w} AS BIGINT) AS locus_copy_count, round(copy_count / sum(copy_count) {w}, 9) AS copy_freq, copy_count" if copy else ""
    return f"""{WITH_AIRR},
      c AS (SELECT {g}locus, {gene} AS gene, count(*) AS seq_count{more} FROM airr {where} GROUP BY ALL)
      SELECT {g}locus, gene, seq_count, CAST(sum(seq_count) {w} AS BIGINT) AS locus_count, round(seq_count / sum(seq_count) {w}, 9) AS seq_freq{extra} FROM c"""


for _mode, _pattern in (("gene", C.GENE), ("family", C.FAMILY), ("allele", C.ALLELE)):
    _usage(f"count_genes_{_mode}", _usage_sql(sql_gene("v_call", _pattern)), mode=_mode)
_usage("count_genes_asis", _usage_sql("v_call"), mode="asis")
_usage("count_genes_ungrouped", _usage_sql(sql_gene(), ""), groups=())
_usage("count_genes_by_isotype", _usage_sql(sql_gene(), "sample_id, c_call"), groups=("sample_id", "c_call"))
_usage("count_genes_copy", _usage_sql(sql_gene(), copy=True), copy="duplicate_count")
_usage("count_genes_all_calls", _usage_sql(sql_gene(first=False)), first=False)
_usage("count_genes_all_calls_nocollapse", _usage_sql(_sql_strip_d(_sql_extract("v_call", C.GENE))), first=False, collapse=False)
_usage("count_genes_keep_na", _usage_sql(sql_gene(), where=""), remove_na=False)
_usage(
    "count_genes_no_locus",
    f"""{WITH_AIRR}, c AS (SELECT sample_id, substr({sql_gene()}, 1, 3) AS locus, {sql_gene()} AS gene, count(*) AS seq_count FROM airr GROUP BY ALL)
      SELECT *, CAST(sum(seq_count) OVER (PARTITION BY sample_id, locus) AS BIGINT) AS locus_count, round(seq_count / sum(seq_count) OVER (PARTITION BY sample_id, locus), 9) AS seq_freq FROM c""",
    drop=("cell_id", "locus"), remove_na=False,
)
_usage(
    "count_genes_clone",
    f"""{WITH_AIRR}, c AS (SELECT sample_id, locus, clone_id, {sql_gene()} AS gene, count(*) AS n FROM airr WHERE v_call IS NOT NULL AND clone_id IS NOT NULL GROUP BY ALL),
      b AS (SELECT sample_id, locus, gene FROM c QUALIFY row_number() OVER (PARTITION BY sample_id, locus, clone_id ORDER BY n DESC, gene) = 1),
      t AS (SELECT sample_id, locus, gene, count(*) AS clone_count FROM b GROUP BY ALL)
      SELECT *, CAST(sum(clone_count) OVER w AS BIGINT) AS locus_clone_count, round(clone_count / sum(clone_count) OVER w, 9) AS clone_freq FROM t WINDOW w AS (PARTITION BY sample_id, locus)""",
    clone="clone_id",
)
_usage(
    "count_genes_cell",
    f"""{WITH_AIRR}, c AS (SELECT DISTINCT sample_id, {sql_gene()} AS gene, cell_id FROM airr WHERE v_call IS NOT NULL),
      t AS (SELECT sample_id, count(*) AS cell_count FROM (SELECT DISTINCT sample_id, cell_id FROM c) GROUP BY 1)
      SELECT sample_id, gene, seq_count, cell_count, round(seq_count / cell_count, 9) AS seq_freq FROM (SELECT sample_id, gene, count(*) AS seq_count FROM c GROUP BY ALL) JOIN t USING (sample_id)""",
    drop=(),
)
_usage(
    "count_genes_cell_clone",
    f"""{WITH_AIRR}, c AS (SELECT sample_id, clone_id, {sql_gene()} AS gene, count(*) AS n FROM (SELECT DISTINCT * FROM airr) WHERE v_call IS NOT NULL AND clone_id IS NOT NULL GROUP BY ALL),
      b AS (SELECT sample_id, gene FROM c QUALIFY row_number() OVER (PARTITION BY sample_id, clone_id ORDER BY n DESC, gene) = 1),
      t AS (SELECT sample_id, gene, count(*) AS clone_count FROM b GROUP BY ALL)
      SELECT *, round(clone_count / sum(clone_count) OVER (PARTITION BY sample_id), 9) AS clone_freq FROM t""",
    drop=(), clone="clone_id",
)
_usage(
    "count_genes_fill",
    f"""{WITH_AIRR}, c AS (SELECT sample_id, c_call, locus, {sql_gene("v_call", C.ALLELE)} AS gene, count(*) AS seq_count FROM airr WHERE v_call IS NOT NULL GROUP BY ALL),
      f AS (SELECT *, CAST(sum(seq_count) OVER (PARTITION BY sample_id, c_call, locus) AS BIGINT) AS locus_count FROM c),
      d AS (SELECT * FROM (SELECT DISTINCT sample_id FROM c), (SELECT DISTINCT c_call FROM c), (SELECT DISTINCT gene FROM c))
      SELECT sample_id, c_call, substr(gene, 1, 3) AS locus, gene, coalesce(seq_count, 0) AS seq_count, locus_count, coalesce(round(seq_count / locus_count, 9), 0) AS seq_freq
      FROM d LEFT JOIN f USING (sample_id, c_call, gene)""",
    groups=("sample_id", "c_call"), mode="allele", fill=True,
)


# Clones ----------------------------------------------------------------------------------------------------------------
def _clones(name: str, sql: str, groups=("sample_id",), cells: bool = False, **how) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        data = airr(spark, d)
        out = count_clones(data if cells else data.drop("cell_id"), list(groups), **how)
        return out.select(*(F.round(c, 9).alias(c) if c.endswith("_freq") else F.col(c) for c in out.columns))

    REGISTRY.add(name, run, sql)


def _clones_sql(groups: str = "sample_id", where: str = "WHERE clone_id IS NOT NULL", count: str = "count(*)", copy: bool = False) -> str:
    g = f"{groups}, " if groups else ""
    w = f"OVER (PARTITION BY {groups})" if groups else "OVER ()"
    more = ", CAST(sum(duplicate_count) AS BIGINT) AS copy_count" if copy else ""
    extra = f", round(copy_count / sum(copy_count) {w}, 9) AS copy_freq" if copy else ""
    return f"{WITH_AIRR}, c AS (SELECT {g}clone_id, {count} AS seq_count{more} FROM airr {where} GROUP BY ALL) SELECT *, round(seq_count / sum(seq_count) {w}, 9) AS seq_freq{extra} FROM c"


_clones("count_clones", _clones_sql())
_clones("count_clones_ungrouped", _clones_sql(""), groups=())
_clones("count_clones_copy", _clones_sql(copy=True), copy="duplicate_count")
_clones("count_clones_cell", _clones_sql(count="count(DISTINCT cell_id) + count(*) - count(cell_id)"), cells=True)
_clones("count_clones_keep_na", _clones_sql(where=""), remove_na=False)


# Utilities -------------------------------------------------------------------------------------------------------------
def _translate(spark: SparkSession, d: str) -> DataFrame:
    names = {"Mu/Delta": ["IGHM", "IGHD"], "Gamma": "IGHG"}
    return airr(spark, d).select("sequence_id", translate_strings("c_call", names).alias("class"))


REGISTRY.add("translate_strings", _translate, f"{WITH_AIRR} SELECT sequence_id, CASE WHEN c_call IN ('IGHM', 'IGHD') THEN 'Mu/Delta' WHEN c_call = 'IGHG' THEN 'Gamma' ELSE c_call END AS class FROM airr")


def _check(spark: SparkSession, d: str) -> DataFrame:
    from repseq.operators.checks import check_columns

    data = airr(spark, d).withColumn("empty", F.lit(None).cast("string"))
    tests = {"present": (["v_call", "clone_id"], "all"), "missing": (["v_call", "d_call"], "all"), "no_data": (["v_call", "empty"], "all"), "any": (["v_call", "d_call"], "any")}
    return spark.createDataFrame([(k, check_columns(data, *v) is True) for k, v in tests.items()], "test string, ok boolean")


REGISTRY.add("check_columns", _check, f"{WITH_AIRR} SELECT * FROM (VALUES ('present', (SELECT count(v_call) > 0 AND count(clone_id) > 0 FROM airr)), ('missing', false), ('no_data', false), ('any', true)) t(test, ok)")
REGISTRY.add(
    "chain_class",
    lambda spark, d: airr(spark, d).select("sequence_id", C.is_heavy("locus").alias("heavy"), C.is_light("locus").alias("light")),
    f"{WITH_AIRR} SELECT sequence_id, locus IN ('IGH', 'TRB', 'TRD') AS heavy, locus IN ('IGK', 'IGL', 'TRA', 'TRG') AS light FROM airr",
)
REGISTRY.add(
    "single_cell_violations",
    lambda spark, d: single_cell_violations(airr(spark, d)),
    f"""{WITH_AIRR}, c AS (SELECT cell_id, count(*) FILTER (locus IN ('IGH', 'TRB', 'TRD')) AS heavy, count(*) FILTER (locus IN ('IGK', 'IGL', 'TRA', 'TRG')) AS light FROM airr WHERE cell_id IS NOT NULL GROUP BY 1)
      SELECT cell_id, CASE WHEN heavy > 1 THEN 'multiple heavy' ELSE 'light without heavy' END AS problem FROM c WHERE heavy > 1 OR (heavy = 0 AND light > 0)""",
)
