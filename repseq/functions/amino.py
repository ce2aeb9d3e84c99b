"""Amino-acid properties: Column functions over residue strings (built-in expressions only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repseq.functions.constants import AMINO_ACIDS, BULKINESS, HYDROPATHY, PK, POLARITY
from repseq.functions.sequence import translate_dna

Seq = str | Column
#: What carries no information, besides the residues.
UNINFORMATIVE = "X.*-"


def _col(x: Seq) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_valid_aa(seq: Seq) -> Column:
    """Whether all characters are amino acids, ``X``, ``.``, ``*`` or ``-``; NULL is not valid."""
    return F.coalesce(_col(seq).rlike(f"^[{AMINO_ACIDS}X.*-]*$"), F.lit(False))


def informative(seq: Seq) -> Column:
    """Number of residues that carry information."""
    return F.length(F.translate(_col(seq), UNINFORMATIVE, ""))


def count_occurrences(seq: Seq, pattern: str) -> Column:
    """Matches of a pattern that do not overlap."""
    return F.regexp_count(_col(seq), F.lit(pattern))


def _count(s: Column, residues: str) -> Column:
    return F.length(s) - F.length(F.translate(s, residues, ""))


def _over(total: Column, size: Column) -> Column:
    """A share; NaN for a share of nothing."""
    return F.when(size == 0, F.lit(float("nan"))).otherwise(total / size)


def _mean(seq: Seq, scale: Mapping[str, float]) -> Column:
    """Mean score of the informative residues; NULL with a residue that the scale lacks, NaN without any."""
    s = F.translate(_col(seq), UNINFORMATIVE, "")
    total = F.lit(0.0)
    for residue, score in scale.items():
        total = total + _count(s, residue) * F.lit(float(score))
    known = F.length(F.translate(s, "".join(scale), "")) == 0
    return F.when(known, _over(total, F.length(s)))


def gravy(seq: Seq, hydropathy: Mapping[str, float] | None = None) -> Column:
    """Grand average of hydropathy."""
    return _mean(seq, hydropathy or HYDROPATHY)


def bulk(seq: Seq, bulkiness: Mapping[str, float] | None = None) -> Column:
    """Average bulkiness."""
    return _mean(seq, bulkiness or BULKINESS)


def polar(seq: Seq, polarity: Mapping[str, float] | None = None) -> Column:
    """Average polarity."""
    return _mean(seq, polarity or POLARITY)


def aliphatic(seq: Seq, *, normalize: bool = True) -> Column:
    """Aliphatic index A + 2.9 V + 3.9 (L + I), per informative residue if normalised."""
    s = _col(seq)
    total = _count(s, "A") + 2.9 * _count(s, "V") + 3.9 * _count(s, "LI")
    return _over(total, informative(s)) if normalize else total


def charge(seq: Seq, *, ph: float = 7.4, pk: Mapping[str, float] | None = None, normalize: bool = False) -> Column:
    """Net charge by the Henderson-Hasselbalch equation over R, H, K and D, E, C, Y."""
    pk, s = pk or PK, _col(seq)
    total = F.lit(0.0)
    for residue in "RHK":
        total = total + _count(s, residue) * F.lit(1 / (1 + 10 ** (ph - pk[residue])))
    for residue in "DECY":
        total = total - _count(s, residue) * F.lit(1 / (1 + 10 ** (pk[residue] - ph)))
    return _over(total, informative(s)) if normalize else total


def count_patterns(df: DataFrame, seq: str, patterns: Mapping[str, str], *, nt: bool = True, trim: bool = False, label: str = "region") -> DataFrame:
    """Adds ``label_name`` for each pattern: its matches per residue of the (translated) sequence."""
    aa = F.col("_residues")  # a column of its own, so that the translation runs once a row
    made = {f"{label}_{n}": _over(count_occurrences(aa, p).cast("double"), F.length(aa)) for n, p in patterns.items()}
    return df.withColumn("_residues", _residues(seq, nt, trim)).withColumns(made).drop("_residues")


def _residues(seq: str, nt: bool, trim: bool) -> Column:
    if nt:
        return translate_dna(seq, trim=trim)
    return F.substring(F.col(seq), F.lit(2), F.greatest(F.lit(0), F.length(seq) - 2)) if trim else F.col(seq)


PROPERTIES = ("length", "gravy", "bulk", "aliphatic", "polarity", "charge", "basic", "acidic", "aromatic")


def amino_acid_properties(
    df: DataFrame, property: Sequence[str] = PROPERTIES, seq: str = "junction", *, nt: bool = True, trim: bool = False, label: str | None = None,
    hydropathy: Mapping[str, float] | None = None, bulkiness: Mapping[str, float] | None = None, polarity: Mapping[str, float] | None = None, ph: float = 7.4, pk: Mapping[str, float] | None = None, normalize: bool | None = None,
) -> DataFrame:
    """Adds ``<label>_aa_<property>`` columns; rows whose residues are not valid get NULL. Existing columns are replaced.

    ``normalize`` overrides the defaults of the aliphatic index (per residue) and of the charge (whole).
    """
    aa = F.col("_residues")  # a column of its own, so that the translation runs once a row
    size = informative(aa)
    made = {
        "length": F.length(aa),
        "gravy": gravy(aa, hydropathy),
        "bulk": bulk(aa, bulkiness),
        "aliphatic": aliphatic(aa, normalize=normalize is not False),
        "polarity": polar(aa, polarity),
        "charge": charge(aa, ph=ph, pk=pk, normalize=bool(normalize)),
        "basic": _over(_count(aa, "RHK"), size),
        "acidic": _over(_count(aa, "DE"), size),
        "aromatic": _over(_count(aa, "FWHY"), size),
    }
    unknown = set(property) - set(made)
    if unknown:
        raise ValueError(f"unknown properties: {sorted(unknown)}")
    columns = {f"{label or seq}_aa_{p}": F.when(is_valid_aa(aa), made[p]) for p in property}
    return df.withColumn("_residues", _residues(seq, nt, trim)).withColumns(columns).drop("_residues")
