"""Rearrangement tables: tab-separated files in the AIRR and the older upper-case layout."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column types of the upper-case layout (all others are text).
LOGICAL = "FUNCTIONAL IN_FRAME STOP INDELS".split()
INTEGER = (
    "V_SEQ_START V_SEQ_LENGTH V_GERM_START_VDJ V_GERM_LENGTH_VDJ V_GERM_START_IMGT V_GERM_LENGTH_IMGT NP1_LENGTH D_SEQ_START D_SEQ_LENGTH D_GERM_START D_GERM_LENGTH "
    "NP2_LENGTH J_SEQ_START J_SEQ_LENGTH J_GERM_START J_GERM_LENGTH JUNCTION_START JUNCTION_LENGTH N1_LENGTH N2_LENGTH P3V_LENGTH P5D_LENGTH P3D_LENGTH P5J_LENGTH D_FRAME CONSCOUNT DUPCOUNT"
).split()
DOUBLE = "V_SCORE V_IDENTITY V_EVALUE D_SCORE D_IDENTITY D_EVALUE J_SCORE J_IDENTITY J_EVALUE HMM_SCORE".split()
#: Columns that hold sequences.
SEQUENCES = (
    "SEQUENCE_INPUT SEQUENCE_VDJ SEQUENCE_IMGT JUNCTION JUNCTION_AA CDR3_IGBLAST_NT CDR3_IGBLAST_AA GERMLINE_VDJ GERMLINE_VDJ_V_REGION GERMLINE_VDJ_D_MASK "
    "GERMLINE_IMGT GERMLINE_IMGT_V_REGION GERMLINE_IMGT_D_MASK FWR1_IMGT FWR2_IMGT FWR3_IMGT FWR4_IMGT CDR1_IMGT CDR2_IMGT CDR3_IMGT"
).split()
#: AIRR columns that are not text.
AIRR_LOGICAL = "rev_comp productive stop_codon vj_in_frame complete_vdj v_frameshift".split()
AIRR_INTEGER = "junction_length junction_aa_length np1_length np2_length np3_length consensus_count duplicate_count umi_count".split()
AIRR_DOUBLE = [f"{s}_{k}" for s in "vdjc" for k in ("score", "identity", "support")]
AIRR_POSITIONS = [f"{s}_{p}_{e}" for s in ("v", "d", "d2", "j") for p in ("sequence", "germline", "alignment") for e in ("start", "end")]
MISSING = ("", "NA", "None")


def _read(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False, enforceSchema=False)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))


def _typed(df: DataFrame, kinds: dict[str, Sequence[str]]) -> DataFrame:
    cast = {}
    for kind, names in kinds.items():
        for c in set(names) & set(df.columns):
            value = F.col(c)
            if kind == "boolean":
                value = F.when(F.upper(value).isin("T", "TRUE"), True).when(F.upper(value).isin("F", "FALSE"), False)
            elif kind == "long":
                value = F.coalesce(value.try_cast("long"), value.try_cast("double").cast("long"))  # whole numbers of any size, and those written as 3.0
            cast[c] = value if kind == "boolean" else value.try_cast(kind)
    return df.withColumns(cast) if cast else df


def read_legacy(spark: SparkSession, path: str | Sequence[str], *, select: Sequence[str] | None = None, drop: Sequence[str] | None = None, seq_upper: bool = True) -> DataFrame:
    """Reads upper-case tables with their types; ``select`` then ``drop`` columns, which the scan then skips."""
    df = _read(spark, path)
    if "sequence_id" in df.columns and "SEQUENCE_ID" not in df.columns:
        warnings.warn("the file looks like an AIRR table; use read_airr", stacklevel=2)
    names = [c for c in df.columns if (select is None or c in select) and c not in (drop or ())]
    df = _typed(df.select(*(f"`{c}`" for c in names)), {"boolean": LOGICAL, "long": INTEGER, "double": DOUBLE})
    return df.withColumns({c: F.upper(c) for c in names if c in SEQUENCES}) if seq_upper else df


def read_airr(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Reads AIRR rearrangement tables with their types."""
    return _typed(_read(spark, path), {"boolean": AIRR_LOGICAL, "long": [*AIRR_INTEGER, *AIRR_POSITIONS], "double": AIRR_DOUBLE})


def _write(df: DataFrame, path: str, true: str, false: str, mode: str) -> None:
    text = df.select(*(F.when(F.col(c), true).otherwise(F.when(~F.col(c), false)).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes))
    text.write.mode(mode).csv(path, sep="\t", header=True, nullValue="NA" if true == "TRUE" else "", quote="", emptyValue="")


def write_legacy(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes tab-separated files with ``NA`` for NULL."""
    _write(df, path, "TRUE", "FALSE", mode)


def write_airr(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes AIRR tables: ``T`` and ``F``, nothing for NULL."""
    _write(df, path, "T", "F", mode)
