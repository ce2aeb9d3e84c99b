"""V(D)J call parsing: Column functions over delimited call strings (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The patterns of allele, gene, family and locus names, and of non-localised alleles.
ALLELE = r"((IG[HKL]|TR[ABDG])[VDJADEGMC][A-R0-9\(\)]*[-/\w]*[-\*]*[\.\w]+)"
GENE = r"((IG[HKL]|TR[ABDG])[VDJADEGMC][A-R0-9\(\)]*[-/\w]*)"
FAMILY = r"((IG[HKL]|TR[ABDG])[VDJADEGMC][A-R0-9\(\)]*)"
LOCUS = r"((IG[HLK]|TR[ABDG]))"
EDGE = r"[^,]*"
NON_LOCALISED = r"(IG[HKL]|TR[ABDG])[VDJADEGMC][0-9]+-NL[0-9]([-/\w]*[-\*][\.\w]+)*({sep}|$)"
DUPLICATED = r"(?<=[A-Z0-9][0-9])D(?=\*|-|{sep}|$)"
#: Loci of heavy and of light chains.
HEAVY, LIGHT = ("IGH", "TRB", "TRD"), ("IGK", "IGL", "TRA", "TRG")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def get_segment(call: str | Column, pattern: str, *, first: bool = True, collapse: bool = True, strip_d: bool = True, omit_nl: bool = False, sep: str = ",") -> Column:
    """The parts of a call that match ``pattern``; a call without a match stays as it is, NULL stays NULL.

    In order: ``omit_nl`` drops non-localised alleles; each name is cut to the pattern; ``strip_d`` drops the D of
    duplicated genes; ``first`` keeps the first name only, else ``collapse`` keeps each name once, in order.
    """
    edge = EDGE if sep == "," else f"[^{sep}]*"
    out = _col(call)
    if omit_nl:
        out = F.regexp_replace(out, edge + ALLELE + edge, "$1")
        out = F.regexp_replace(out, NON_LOCALISED.format(sep=sep), "")
    out = F.regexp_replace(out, edge + pattern + edge, "$1")
    if strip_d:
        out = F.regexp_replace(out, DUPLICATED.format(sep=sep), "")
    if first:
        return F.regexp_replace(out, f"{sep}.*$", "")
    if collapse:
        names = F.array_distinct(F.split(F.regexp_replace(out, f"{sep}$", ""), sep))
        return F.array_join(names, sep)
    return out


def get_allele(call: str | Column, **how) -> Column:
    return get_segment(call, ALLELE, **how)


def get_gene(call: str | Column, **how) -> Column:
    return get_segment(call, GENE, **how)


def get_family(call: str | Column, **how) -> Column:
    return get_segment(call, FAMILY, **how)


def get_locus(call: str | Column, **how) -> Column:
    return get_segment(call, LOCUS, **how)


def get_chain(call: str | Column, **how) -> Column:
    """Heavy (VH) or light (VL) chain of each locus; the chains are not collapsed again."""
    out = F.regexp_replace(get_locus(call, **how), r"(IGH)|(TR[BD])", "VH")
    return F.regexp_replace(out, r"(IG[KL])|(TR[AG])", "VL")


def is_heavy(locus: str | Column) -> Column:
    return _col(locus).isin(*HEAVY)


def is_light(locus: str | Column) -> Column:
    return _col(locus).isin(*LIGHT)


def sort_keys(call: str | Column) -> dict[str, Column]:
    """What calls are sorted by: family, first and second gene number, allele number (missing ones are 0)."""
    one = get_allele(call, first=False, strip_d=False)
    gene, allele = get_gene(one, strip_d=False), get_allele(one, strip_d=False)
    digits = lambda c: F.coalesce(F.regexp_replace(c, "[^0-9]+", "99").try_cast("double"), F.lit(0.0))
    return {
        "family": get_family(one, strip_d=False),
        "g1": digits(F.regexp_replace(gene, r"[^-]+-([^-\*D]+).*", "$1")),
        "g2": digits(F.regexp_replace(gene, r"[^-]+-[^-]+-?", "")),
        "a1": F.coalesce(F.regexp_replace(allele, r"^([^\*]+\*|[^\*]+$)", "").try_cast("double"), F.lit(0.0)),
        "call": one,
    }


def sort_genes(df: DataFrame, call: str, *, method: str = "name", rank: str = "rank") -> DataFrame:
    """Adds the normalised ``call`` and its ``rank`` by name or by position in the locus; equal keys rank by the call."""
    k = sort_keys(call)
    by = {
        "name": [k["family"], k["g1"], k["g2"], k["a1"], k["call"]],
        "position": [k["g1"].desc(), k["g2"].desc(), k["family"], k["a1"], k["call"]],
    }[method]
    # Only distinct calls with their numbers of rows meet in one order (a germline set); rows are numbered within their call.
    distinct = df.groupBy(call).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy(*by, F.col(call)).rowsBetween(W.unboundedPreceding, -1))
    distinct = distinct.select(F.col(call).alias("_call"), F.coalesce(before, F.lit(0)).alias("_before"), k["call"].alias("_named"))
    inside = F.row_number().over(W.partitionBy(call).orderBy(F.lit(0)))
    out = df.withColumn("_inside", inside).join(distinct, F.col(call).eqNullSafe(F.col("_call")), "left")
    return out.withColumn(rank, (F.col("_before") + F.col("_inside")).cast("int")).withColumn(call, F.col("_named")).drop("_inside", "_call", "_before", "_named")


#: SQL functions without a Python worker.
_SQL = {"get_allele": ALLELE, "get_gene": GENE, "get_family": FAMILY, "get_locus": LOCUS}


def register_functions(spark: SparkSession) -> None:
    """Registers get_allele, get_gene, get_family, get_locus and get_chain (first call, D stripped) for SQL."""
    def text(x: str) -> str:
        return x.replace("\\", "\\\\").replace("'", "\\'")

    for name, pattern in _SQL.items():
        body = f"regexp_replace(x, '{text(EDGE + pattern + EDGE)}', '$1')"
        body = f"regexp_replace({body}, '{text(DUPLICATED.format(sep=','))}', '')"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN regexp_replace({body}, ',.*$', '')")
    chain = "regexp_replace(regexp_replace(get_locus(x), '(IGH)|(TR[BD])', 'VH'), '(IG[KL])|(TR[AG])', 'VL')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION get_chain(x STRING) RETURNS STRING RETURN {chain}")
