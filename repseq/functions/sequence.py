"""Sequence operations: translation, masking, padding, regions, distances and mismatches (built-in expressions only)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repseq.functions.constants import CODONS, IUPAC_DNA, V_REGIONS, codon_table, dna_matrix

Seq = str | Column
DEFAULT_IGNORE = ("N", "-", ".", "?")


def _col(x: Seq) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _char(s: Column, i: Column | int) -> Column:
    return F.substring(s, i, 1)


# Translation -----------------------------------------------------------------------------------------------------------
def _ambiguous_codons() -> dict[str, str]:
    """Codons with ambiguity codes whose every reading is the same amino acid."""
    table, out = codon_table(), {}
    for codon in map("".join, product(IUPAC_DNA, repeat=3)):
        read = {table["".join(c)] for c in product(*(IUPAC_DNA[x] for x in codon))}
        if len(read) == 1 and codon not in table:
            out[codon] = read.pop()
    return out


def translate_dna(seq: Seq, *, trim: bool = False) -> Column:
    """Amino acids of a nucleotide sequence; gaps read as N, a codon with several readings as X, a last partial codon not at all.

    ``trim`` drops the first and last codon first. NULL and sequences shorter than a codon give NULL.
    """
    s = _col(seq)
    if trim:
        s = F.substring(s, F.lit(4), F.length(s) - 6)
    s = F.upper(F.translate(s, "-.", "NN"))
    rare = F.create_map(*(F.lit(x) for pair in _ambiguous_codons().items() for x in pair))

    def codon(i: Column) -> Column:
        place = [F.instr(F.lit("TCAG"), F.substring(s, 3 * i + k, 1)) for k in (1, 2, 3)]
        plain = F.substring(F.lit(CODONS), 16 * place[0] + 4 * place[1] + place[2] - 20, 1)
        known = (place[0] > 0) & (place[1] > 0) & (place[2] > 0)
        return F.when(known, plain).otherwise(F.coalesce(F.try_element_at(rare, F.substring(s, 3 * i + 1, 3)), F.lit("X")))

    count = (F.length(s) / 3).cast("int")
    return F.when(F.length(s) >= 3, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), codon), ""))


# Masking and padding ---------------------------------------------------------------------------------------------------
def mask_gaps(seq: Seq, *, mask_char: str = "N", outer_only: bool = False) -> Column:
    """Gaps (``-`` and ``.``) replaced by the mask character, everywhere or at both ends only."""
    s = _col(seq)
    if not outer_only:
        return F.translate(s, "-.", mask_char * 2)
    head = F.regexp_extract(s, r"^[-.]*", 0)
    rest = F.substring(s, F.length(head) + 1, F.length(s))
    tail = F.regexp_extract(rest, r"[-.]*$", 0)
    return F.concat(F.repeat(F.lit(mask_char), F.length(head)), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)), F.repeat(F.lit(mask_char), F.length(tail)))


def _spread(df: DataFrame, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Adds measures over the whole column, or over each ``by`` group."""
    if by:
        return df.withColumns({n: m.over(W.partitionBy(*by)) for n, m in measures.items()})
    return df.crossJoin(F.broadcast(df.agg(*(m.alias(n) for n, m in measures.items()))))  # one row


def mask_ends(df: DataFrame, seq: str, *, mask_char: str = "N", max_mask: int | None = None, trim: bool = False, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Masks (or trims) all sequences to the longest leading and trailing runs of the mask character, at most ``max_mask``.

    The runs are those of the whole column, or of each ``by`` group. ``out`` defaults to ``seq``.
    """
    c, m = F.col(seq), re.escape(mask_char)
    runs = {"_left": F.max(F.length(F.regexp_extract(c, f"^({m})*", 0))), "_right": F.max(F.length(F.regexp_extract(c, f"({m})*$", 0)))}
    cap = (lambda x: F.least(x, F.lit(max_mask))) if max_mask is not None else (lambda x: x)
    size, left, right = F.length(c), cap(F.col("_left")), cap(F.col("_right"))
    core = F.substring(c, left + 1, F.greatest(F.lit(0), size - left - right))
    if not trim:
        core = F.concat(F.repeat(F.lit(mask_char), F.least(left, size)), core, F.repeat(F.lit(mask_char), F.least(right, F.greatest(F.lit(0), size - left))))
    return _spread(df, by, runs).withColumn(out or seq, core).drop("_left", "_right")


def pad_ends(df: DataFrame, seq: str, *, length: int | None = None, start: bool = False, pad_char: str = "N", mod3: bool = True, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Pads all sequences to the longest one (of the column or of each ``by`` group; ``length`` at least), at the end or the start."""
    wide = F.col("_width") if length is None else F.greatest(F.col("_width"), F.lit(length))
    if mod3:
        wide = wide + (F.lit(3) - wide % 3) % 3
    pad = F.lpad if start else F.rpad
    return _spread(df, by, {"_width": F.max(F.length(seq))}).withColumn(out or seq, pad(F.col(seq), wide.cast("int"), F.lit(pad_char))).drop("_width")


def extract_v_region(seq: Seq, region: str | Sequence[str] = tuple(V_REGIONS)) -> Column | dict[str, Column]:
    """The part of an aligned V segment in one region, or a Column for each of several regions."""
    if isinstance(region, str):
        first, last = V_REGIONS[region]
        return F.substring(_col(seq), first, last - first + 1)
    return {r: extract_v_region(seq, r) for r in region}


# Comparison ------------------------------------------------------------------------------------------------------------
def seq_equal(a: Seq, b: Seq, ignore: Sequence[str] = DEFAULT_IGNORE) -> Column:
    """Whether two sequences of equal length agree wherever neither has a character to ignore."""
    x, y = _col(a), _col(b)
    skip = F.lit("".join(ignore))

    def fits(i: Column) -> Column:
        p, q = F.substring(x, i, 1), F.substring(y, i, 1)
        return (p == q) | (F.instr(skip, p) > 0) | (F.instr(skip, q) > 0)

    return F.when(x == y, True).when(F.length(x) != F.length(y), False).when(F.length(x) == 0, True).otherwise(F.forall(F.sequence(F.lit(1), F.length(x)), fits))


def seq_dist(a: Seq, b: Seq, matrix: Mapping[tuple[str, str], float] | None = None) -> Column:
    """Distance of two sequences of equal length: the sum of positive character distances, and 1 for each run of -1.

    Sequences of different length and characters that the matrix lacks raise an error; NULL gives NULL.
    """
    matrix = dna_matrix() if matrix is None else matrix
    names = sorted({x for pair in matrix for x in pair})
    letters, n = F.lit("".join(names)), len(names)
    flat = F.array(*(F.lit(float(matrix[x, y])) for x in names for y in names))
    x, y = _col(a), _col(b)

    def distance(i: Column) -> Column:
        p, q = F.instr(letters, F.substring(x, i, 1)), F.instr(letters, F.substring(y, i, 1))
        unknown = F.raise_error(F.lit("Character not found in the distance matrix.")).cast("double")
        return F.when((p > 0) & (q > 0), F.element_at(flat, (p - 1) * n + q)).otherwise(unknown)

    def add(acc: Column, d: Column) -> Column:
        indel = (d == -1) & (acc["last"] != -1)
        return F.struct((acc["sum"] + F.when(d > 0, d).when(indel, 1.0).otherwise(0.0)).alias("sum"), d.alias("last"))

    each = F.transform(F.sequence(F.lit(1), F.length(x)), distance)
    total = F.aggregate(each, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last")), add, lambda acc: acc["sum"])
    unequal = F.raise_error(F.lit("Sequences of different length.")).cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(F.length(x) != F.length(y), unequal).when(F.length(x) == 0, 0.0).otherwise(total)


def mismatch_positions(sample: Seq, germline: Seq, ignore: Sequence[str] = ("N", ".", "-")) -> Column:
    """1-based positions, up to the shorter length, where two sequences differ regardless of case and neither is ignored."""
    x, y = F.upper(_col(sample)), F.upper(_col(germline))
    skip = F.lit("".join(ignore).upper())

    def differs(i: Column) -> Column:
        p, q = F.substring(x, i, 1), F.substring(y, i, 1)
        return (p != q) & (F.instr(skip, p) == 0) & (F.instr(skip, q) == 0)

    size = F.least(F.length(x), F.length(y))
    none = F.array().cast("array<int>")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("array<int>")).when(size == 0, none).otherwise(F.filter(F.sequence(F.lit(1), size), differs))


def mismatch_count(sample: Seq, germline: Seq, ignore: Sequence[str] = ("N", ".", "-")) -> Column:
    """Number of mismatches; NULL where either sequence is NULL."""
    found = mismatch_positions(sample, germline, ignore)
    return F.when(found.isNotNull(), F.size(found))


def invalid_bases(df: DataFrame, seq: str) -> Column:
    """Aggregate: how many sequences are NULL or hold characters other than A, C, G, T, N and ``?`` (of either case)."""
    return F.sum(F.when(F.col(seq).isNull() | ~F.upper(F.col(seq)).rlike("^[ACGTN?]*$"), 1).otherwise(0))


# Junctions -------------------------------------------------------------------------------------------------------------
JUNCTION_START = 310


def _aligned_junction_end(alignment: Column, length: Column) -> Column:
    """Last position of the junction, whose gaps (``-``) do not count; NULL if the alignment ends before."""
    after = F.sequence(F.lit(JUNCTION_START), F.length(alignment))
    state = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, i: Column) -> Column:
        seen = acc["seen"] + F.when(F.substring(alignment, i, 1) != "-", 1).otherwise(0)
        return F.struct(seen.alias("seen"), F.coalesce(acc["end"], F.when(seen > length, i - 1)).alias("end"))

    return F.when(F.length(alignment) >= JUNCTION_START, F.aggregate(after, state, step, lambda acc: acc["end"]))


def junction_alignment(
    data: DataFrame,
    germlines: DataFrame,
    *,
    v_call: str = "v_call",
    d_call: str = "d_call",
    j_call: str = "j_call",
    v_start: str = "v_germline_start",
    v_end: str = "v_germline_end",
    d_start: str = "d_germline_start",
    d_end: str = "d_germline_end",
    j_start: str = "j_germline_start",
    j_end: str = "j_germline_end",
    junction: str = "junction",
    junction_length: str = "junction_length",
    sequence_alignment: str = "sequence_alignment",
    check: bool = True,
) -> DataFrame:
    """Germline nucleotides that the alignment lost at the ends of V, D and J, and those of V and J in the CDR3.

    ``germlines`` has ``allele, sequence``. Adds ``{v,d,j}_germline_deleted_5``, ``..._3``, ``v_cdr3_length`` and
    ``j_cdr3_length``. NULL calls give NULL; an allele that is not in ``germlines`` raises (with ``check``). CDR3 counts are
    NULL without a junction or where it has 6 nucleotides or fewer.
    """
    from repseq.functions.calls import get_allele

    out = data
    for seg, call, start, end in (("v", v_call, v_start, v_end), ("d", d_call, d_start, d_end), ("j", j_call, j_start, j_end)):
        table = germlines.select(F.col("allele").alias(f"_{seg}_allele"), F.col("sequence").alias(f"_{seg}_germline"))
        out = out.withColumn("_name", get_allele(call)).join(table, F.col("_name") == F.col(f"_{seg}_allele"), "left")
        germline = F.col(f"_{seg}_germline")
        if check:
            missing = F.raise_error(F.concat(F.col("_name"), F.lit(" not found in the germlines."))).cast("string")
            germline = F.when(germline.isNull() & F.col("_name").isNotNull(), missing).otherwise(germline)
        bare = lambda s: F.length(F.translate(s, ".", ""))
        first, last = F.col(start).cast("int"), F.col(end).cast("int")
        out = out.withColumns({
            f"{seg}_germline_deleted_5": bare(F.substring(germline, F.lit(1), first - 1)),
            f"{seg}_germline_deleted_3": bare(F.substring(germline, last + 1, F.greatest(F.lit(0), F.length(germline) - last))),
        }).drop(f"_{seg}_allele")
    aligned = F.col(sequence_alignment)
    usable = F.col(junction).isNotNull() & (F.col(junction_length) > 6)
    v_last = F.col(v_end) - F.col(v_start) + 1
    j_first = F.length(aligned) - (F.col(j_end) - F.col(j_start) + 1) + 1
    j_last = _aligned_junction_end(aligned, F.col(junction_length)) - 3
    part = lambda a, b: F.substring(aligned, a.cast("int"), F.greatest(F.lit(0), b - a + 1).cast("int"))
    out = out.withColumns({
        "v_cdr3_length": F.when(usable & F.col("_v_germline").isNotNull(), F.length(F.translate(part(F.lit(JUNCTION_START + 3), v_last), ".-", ""))),
        "j_cdr3_length": F.when(usable & F.col("_j_germline").isNotNull(), F.length(F.translate(part(j_first, j_last), "-", ""))),
    })
    return out.drop("_name", "_v_germline", "_d_germline", "_j_germline")
