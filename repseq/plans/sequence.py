"""Queries over sequences, amino acids and pairs of sequences, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repseq.functions import amino as A
from repseq.functions import sequence as S
from repseq.functions.constants import BULKINESS, CODONS, HYDROPATHY, PK, POLARITY, dna_matrix
from repseq.operators import pairwise as P
from repseq.plans.fixtures import WITH_AIRR, airr
from repseq.plans.registry import Registry

REGISTRY = Registry()


def _column(name: str, make: Callable[[], Column], sql: str, out: str = "value") -> None:
    REGISTRY.add(name, lambda spark, d: airr(spark, d).select("sequence_id", make().alias(out)), f"{WITH_AIRR} SELECT sequence_id, {sql} AS {out} FROM airr")


def _frame(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    REGISTRY.add(name, lambda spark, d: make(airr(spark, d)), f"{WITH_AIRR} {sql}")


# Translation, masking, padding, regions --------------------------------------------------------------------------------
def sql_translate(s: str) -> str:
    place = "strpos('TCAG', substr({s}, {i}, 1))"
    at = [place.format(s=s, i=f"CAST(3 * i + {k} AS INT)") for k in (1, 2, 3)]
    return f"array_to_string(list_transform(range(0, length({s}) // 3), lambda i: substr('{CODONS}', 16 * {at[0]} + 4 * {at[1]} + {at[2]} - 20, 1)), '')"


_column("translate_dna", lambda: S.translate_dna("junction"), sql_translate("junction"))
_trimmed = "substr(junction, 4, length(junction) - 6)"
_column("translate_dna_trim", lambda: S.translate_dna("junction", trim=True), sql_translate(_trimmed))
_gapless = "translate(sequence_alignment, '-.', 'NN')"
_read = f"""array_to_string(list_transform(range(0, length({_gapless}) // 3), lambda i: CASE WHEN contains(substr({_gapless}, CAST(3 * i + 1 AS INT), 3), 'N')
  THEN CASE WHEN regexp_matches(substr({_gapless}, CAST(3 * i + 1 AS INT), 3), '^(CTN|GTN|TCN|CCN|ACN|GCN|CGN|GGN)$')
    THEN substr('LVSPTARG', CAST((strpos('CTNGTNTCNCCNACNGCNCGNGGN', substr({_gapless}, CAST(3 * i + 1 AS INT), 3)) + 2) / 3 AS INT), 1) ELSE 'X' END
  ELSE substr('{CODONS}', 16 * strpos('TCAG', substr({_gapless}, CAST(3 * i + 1 AS INT), 1)) + 4 * strpos('TCAG', substr({_gapless}, CAST(3 * i + 2 AS INT), 1)) + strpos('TCAG', substr({_gapless}, CAST(3 * i + 3 AS INT), 1)) - 20, 1) END), '')"""
_column("translate_dna_ambiguous", lambda: S.translate_dna("sequence_alignment"), _read)
_column("mask_gaps", lambda: S.mask_gaps("sequence_alignment"), "translate(sequence_alignment, '-.', 'NN')")
_column(
    "mask_gaps_outer",
    lambda: S.mask_gaps("sequence_alignment", outer_only=True),
    r"repeat('N', length(regexp_extract(sequence_alignment, '^[-.]*'))) || regexp_replace(regexp_replace(sequence_alignment, '^[-.]+', ''), '[-.]+$', '') || "
    r"repeat('N', length(regexp_extract(regexp_replace(sequence_alignment, '^[-.]+', ''), '[-.]*$')))",
)
_ends = """, m AS (SELECT max(length(regexp_extract(s, '^N*'))) AS l, max(length(regexp_extract(s, 'N*$'))) AS r FROM (SELECT translate(sequence_alignment, '-.', 'NN') AS s FROM airr)),
  x AS (SELECT sequence_id, translate(sequence_alignment, '-.', 'NN') AS s, {l} AS l, {r} AS r FROM airr, m)"""


def _masked(df: DataFrame) -> DataFrame:
    return df.select("sequence_id", S.mask_gaps("sequence_alignment").alias("value"))


_frame("mask_ends", lambda df: S.mask_ends(_masked(df), "value"), _ends.format(l="l", r="r") + " SELECT sequence_id, repeat('N', l) || substr(s, CAST(l + 1 AS INT), CAST(length(s) - l - r AS INT)) || repeat('N', r) AS value FROM x")
_frame("mask_ends_max", lambda df: S.mask_ends(_masked(df), "value", max_mask=1), _ends.format(l="least(l, 1)", r="least(r, 1)") + " SELECT sequence_id, repeat('N', l) || substr(s, CAST(l + 1 AS INT), CAST(length(s) - l - r AS INT)) || repeat('N', r) AS value FROM x")
_frame("trim_ends", lambda df: S.mask_ends(_masked(df), "value", trim=True), _ends.format(l="l", r="r") + " SELECT sequence_id, substr(s, CAST(l + 1 AS INT), CAST(length(s) - l - r AS INT)) AS value FROM x")


def _ragged(df: DataFrame) -> DataFrame:
    return df.select("sequence_id", F.regexp_replace("junction", "AC.*$", "").alias("value"))


_pad = ", x AS (SELECT sequence_id, regexp_replace(junction, 'AC.*$', '') AS s FROM airr), w AS (SELECT max(length(s)) AS w FROM x), v AS (SELECT *, w + (3 - w % 3) % 3 AS n FROM x, w)"
_frame("pad_ends", lambda df: S.pad_ends(_ragged(df), "value"), _pad + " SELECT sequence_id, s || repeat('N', n - length(s)) AS value FROM v")
_frame("pad_start", lambda df: S.pad_ends(_ragged(df), "value", start=True), _pad + " SELECT sequence_id, repeat('N', n - length(s)) || s AS value FROM v")
_long = "repeat(sequence_alignment, 13)"
_frame(
    "extract_vregion",
    lambda df: df.select("sequence_id", *(c.alias(n) for n, c in S.extract_v_region(F.repeat("sequence_alignment", F.lit(13))).items())),
    f"SELECT sequence_id, substr({_long}, 1, 78) AS fwr1, substr({_long}, 79, 36) AS cdr1, substr({_long}, 115, 51) AS fwr2, substr({_long}, 166, 30) AS cdr2, substr({_long}, 196, 117) AS fwr3 FROM airr",
)


# Comparison ------------------------------------------------------------------------------------------------------------
def _chars(a: str, b: str, test: str) -> str:
    """Positions (1-based) of two strings of which a test on characters p and q holds."""
    names = {"p": f"substr({a}, CAST(i AS INT), 1)", "q": f"substr({b}, CAST(i AS INT), 1)"}
    test = re.sub(r"\b[pq]\b", lambda m: names[m[0]], test)
    return f"list_filter(range(1, CAST(least(length({a}), length({b})) AS INT) + 1), lambda i: {test})"


_S, _G = "sequence_alignment", "germline_alignment"
_equal = f"len({_chars(_S, _G, 'p <> q AND strpos($$N-.?$$, p) = 0 AND strpos($$N-.?$$, q) = 0')}) = 0"
_column("seq_equal", lambda: S.seq_equal(_S, _G), _equal)
_dna = "p <> q AND p NOT IN ($$N$$, $$-$$, $$.$$) AND q NOT IN ($$N$$, $$-$$, $$.$$)"
_gap = "(p IN ($$-$$, $$.$$)) <> (q IN ($$-$$, $$.$$))"


def _dist_sql(a: str, b: str, gap: int) -> str:
    base = f"len({_chars(a, b, _dna)})"
    if gap == 0:
        return f"CAST({base} AS DOUBLE)"
    at = _chars(a, b, _gap)
    extra = f"len({at})" if gap == 1 else f"len(list_filter({at}, lambda x: NOT list_contains({at}, x - 1)))"
    return f"CAST({base} + {extra} AS DOUBLE)"


for _g, _name in ((0, "gap0"), (1, "gap1"), (-1, "indel")):
    _column(f"seq_dist_{_name}", lambda g=_g: S.seq_dist(_S, _G, dna_matrix(g)), _dist_sql(_S, _G, _g))
_miss = _chars(_S, _G, "p <> q AND strpos($$N.-$$, p) = 0 AND strpos($$N.-$$, q) = 0")
_column("mismatch_count", lambda: S.mismatch_count(_S, _G), f"CAST(len({_miss}) AS INTEGER)")
_column("mismatch_positions", lambda: F.array_join(S.mismatch_positions(_S, _G).cast("array<string>"), ","), f"array_to_string({_miss}, ',')")
_frame("invalid_bases", lambda df: df.groupBy("sample_id").agg(S.invalid_bases(df, _S).alias("invalid")), "SELECT sample_id, count(*) FILTER (NOT regexp_matches(sequence_alignment, '^[ACGTN?]*$')) AS invalid FROM airr GROUP BY 1")

# Blocks: sample and clone. Every row takes part.
_by = ["sample_id", "clone_id"]
_pairs = ", u AS (SELECT DISTINCT sample_id, clone_id, {c} AS s FROM airr), p AS (SELECT a.sample_id, a.clone_id, a.s AS seq1, b.s AS seq2 FROM u a JOIN u b ON a.sample_id = b.sample_id AND a.clone_id IS NOT DISTINCT FROM b.clone_id AND length(a.s) = length(b.s) AND a.s < b.s)"
_frame("pairwise_dist", lambda df: P.pairwise_dist(df, _S, by=_by), _pairs.format(c=_S) + f" SELECT *, {_dist_sql('seq1', 'seq2', -1)} AS dist FROM p")
_frame("pairwise_equal", lambda df: P.pairwise_equal(df, _S, by=_by), _pairs.format(c=_S) + f" SELECT *, {_equal.replace(_S, 'seq1').replace(_G, 'seq2')} AS equal FROM p")
_frame("fast_dist", lambda df: P.fast_dist(df.withColumn("m", S.mask_gaps(_S)), "m", by=_by), _pairs.format(c="translate(sequence_alignment, '-.', 'NN')") + f" SELECT *, {_dist_sql('seq1', 'seq2', 0)} AS dist FROM p")
_frame(
    "nonsquare_dist",
    lambda df: P.nonsquare_dist(df, _S, F.col("c_call") == "IGHA", by=_by, matrix=dna_matrix(0)),
    f""", u AS (SELECT DISTINCT sample_id, clone_id, {_S} AS s FROM airr), v AS (SELECT DISTINCT sample_id, clone_id, {_S} AS s FROM airr WHERE c_call = 'IGHA'),
      p AS (SELECT a.sample_id, a.clone_id, a.s AS seq1, b.s AS seq2 FROM v a JOIN u b ON a.sample_id = b.sample_id AND a.clone_id IS NOT DISTINCT FROM b.clone_id)
      SELECT *, {_dist_sql("seq1", "seq2", 0)} AS dist FROM p""",
)
_frame(
    "mismatch_matrix",
    lambda df: P.mismatch_matrix(df, _S, df.where("germline_alignment IS NOT NULL"), _G),
    f", p AS (SELECT * FROM (SELECT DISTINCT {_S} AS sample FROM airr), (SELECT DISTINCT {_G} AS germline FROM airr)) SELECT *, CAST(len({_miss.replace(_S, 'sample').replace(_G, 'germline')}) AS INTEGER) AS mismatches FROM p",
)


# Amino acids -----------------------------------------------------------------------------------------------------------
_AA = "aa"
_aa = f", x AS (SELECT sequence_id, {sql_translate('junction')} AS aa FROM airr)"
_info = "nullif(length(translate(aa, 'X.*-', '')), 0)"


def _n(residues: str) -> str:
    return f"(length(aa) - length(translate(aa, '{residues}', '')))"


def _sum(scale: dict[str, float]) -> str:
    return "(" + " + ".join(f"{_n(r)} * CAST({v!r} AS DOUBLE)" for r, v in scale.items()) + ")"


_charge = " + ".join(f"{_n(r)} * CAST({1 / (1 + 10 ** (7.4 - PK[r]))!r} AS DOUBLE)" for r in "RHK") + "".join(f" - {_n(r)} * CAST({1 / (1 + 10 ** (PK[r] - 7.4))!r} AS DOUBLE)" for r in "DECY")
_SCORES = {
    "gravy": (A.gravy, f"{_sum(HYDROPATHY)} / {_info}"),
    "bulk": (A.bulk, f"{_sum(BULKINESS)} / {_info}"),
    "polar": (A.polar, f"{_sum(POLARITY)} / {_info}"),
    "aliphatic": (A.aliphatic, f"({_n('A')} + CAST(2.9 AS DOUBLE) * {_n('V')} + CAST(3.9 AS DOUBLE) * {_n('LI')}) / {_info}"),
    "charge": (A.charge, f"({_charge})"),
}


def _residues(df: DataFrame) -> DataFrame:
    return df.select("sequence_id", S.translate_dna("junction").alias("aa"))


for _name, (_fn, _sql) in _SCORES.items():
    _frame(_name, lambda df, f=_fn: _residues(df).select("sequence_id", F.round(f("aa"), 6).alias("value")), _aa + f" SELECT sequence_id, round({_sql}, 6) AS value FROM x")
_frame("valid_aa", lambda df: df.select("sequence_id", A.is_valid_aa("sequence_alignment").alias("value")), "SELECT sequence_id, regexp_matches(sequence_alignment, '^[ARNDCQEGHILKMFPSTWYVX.*-]*$') AS value FROM airr")
_frame("count_occurrences", lambda df: _residues(df).select("sequence_id", A.count_occurrences("aa", "[RHK].").alias("value")), _aa + " SELECT sequence_id, CAST(len(regexp_extract_all(aa, '[RHK].')) AS INTEGER) AS value FROM x")
_frame(
    "count_patterns",
    lambda df: (lambda o: o.select("sequence_id", F.round("region_arg", 6).alias("region_arg"), F.round("region_his", 6).alias("region_his")))(A.count_patterns(df, "junction", {"arg": "R", "his": "[HK].[AG]"}, trim=True)),
    f", x AS (SELECT sequence_id, {sql_translate(_trimmed)} AS aa FROM airr) SELECT sequence_id, round(len(regexp_extract_all(aa, 'R')) / length(aa), 6) AS region_arg, round(len(regexp_extract_all(aa, '[HK].[AG]')) / length(aa), 6) AS region_his FROM x",
)
_frame(
    "aa_properties",
    lambda df: (lambda o: o.select("sequence_id", *(F.round(c, 6).alias(c) for c in o.columns if "_aa_" in c)))(A.amino_acid_properties(df.select("sequence_id", "junction"))),
    _aa
    + " SELECT sequence_id, length(aa) AS junction_aa_length, "
    + ", ".join(f"round({s}, 6) AS junction_aa_{'polarity' if n == 'polar' else n}" for n, (_, s) in _SCORES.items())
    + f", round({_n('RHK')} / {_info}, 6) AS junction_aa_basic, round({_n('DE')} / {_info}, 6) AS junction_aa_acidic, round({_n('FWHY')} / {_info}, 6) AS junction_aa_aromatic FROM x",
)


# Junctions -------------------------------------------------------------------------------------------------------------
def _junction_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Alignments of 360 positions over the fixture, with starts and ends that vary, and a germline for each allele."""
    from repseq.functions.calls import get_allele

    n = F.substring("sequence_id", 2, 8).cast("int")
    rows = airr(spark, d).select(
        "sequence_id", "v_call", F.lit(None).cast("string").alias("d_call"), "j_call", "junction", (F.length("junction") - n % 3 * 9).alias("junction_length"),
        F.repeat("sequence_alignment", F.lit(15)).alias("sequence_alignment"), (1 + n % 5).alias("v_germline_start"), (310 + n % 20).alias("v_germline_end"),
        F.lit(1).alias("d_germline_start"), F.lit(2).alias("d_germline_end"), (1 + n % 4).alias("j_germline_start"), (20 + n % 30).alias("j_germline_end"),
    )
    alleles = rows.select(get_allele("v_call").alias("allele")).union(rows.select(get_allele("j_call"))).where("allele IS NOT NULL").distinct()
    return rows, alleles.withColumn("sequence", F.repeat(F.concat(F.lit("ACGT.."), F.col("allele")), F.lit(22)))


def _junctions(spark: SparkSession, d: str) -> DataFrame:
    rows, germlines = _junction_rows(spark, d)
    out = S.junction_alignment(rows, germlines)
    return out.select("sequence_id", *(c for c in out.columns if "deleted" in c or "cdr3" in c))


def _junctions_sql() -> str:
    from repseq.plans.usage import _sql_extract, _sql_first, _sql_strip_d
    from repseq.functions.calls import ALLELE

    v, j = (_sql_first(_sql_strip_d(_sql_extract(c, ALLELE))) for c in ("v_call", "j_call"))
    bare = "length(replace({}, '.', ''))"
    a, jl, end = "repeat(sequence_alignment, 15)", "length(junction) - n % 3 * 9", "jend"
    head = lambda g, s: f"CAST({bare.format(f'substr({g}, 1, {s} - 1)')} AS INTEGER)"
    tail = lambda g, e: f"CAST({bare.format(f'substr({g}, {e} + 1)')} AS INTEGER)"
    return f"""{WITH_AIRR}, x AS (SELECT *, CAST(substr(sequence_id, 2, 8) AS INTEGER) AS n, repeat('ACGT..' || ({v}), 22) AS vg, repeat('ACGT..' || ({j}), 22) AS jg FROM airr),
      y AS (SELECT *, {a} AS al, list_filter(range(310, 361), lambda i: length(replace(substr({a}, 310, CAST(i AS INT) - 309), '-', '')) > {jl})[1] - 1 AS jend FROM x)
      SELECT sequence_id, {head("vg", "(1 + n % 5)")} AS v_germline_deleted_5, {tail("vg", "(310 + n % 20)")} AS v_germline_deleted_3,
        CAST(NULL AS INTEGER) AS d_germline_deleted_5, CAST(NULL AS INTEGER) AS d_germline_deleted_3,
        {head("jg", "(1 + n % 4)")} AS j_germline_deleted_5, {tail("jg", "(20 + n % 30)")} AS j_germline_deleted_3,
        CASE WHEN {jl} > 6 AND vg IS NOT NULL THEN CAST(length(translate(substr(al, 313, greatest(0, 310 + n % 20 - 1 - n % 5 + 1 - 313 + 1)), '.-', '')) AS INTEGER) END AS v_cdr3_length,
        CASE WHEN {jl} > 6 THEN CAST(length(replace(substr(al, 360 - (20 + n % 30 - 1 - n % 4 + 1) + 1, CAST(greatest(0, {end} - 3 - (360 - (20 + n % 30 - 1 - n % 4 + 1) + 1) + 1) AS INT)), '-', '')) AS INTEGER) END AS j_cdr3_length
      FROM y"""


REGISTRY.add("junction_alignment", _junctions, _junctions_sql())
