"""IUPAC codes, amino-acid scales, region bounds. Each table is given in its natural order."""

from __future__ import annotations

# IUPAC nucleotide codes and the bases they stand for.
IUPAC_DNA = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
# IUPAC amino-acid codes and what they stand for (B is N or R here, as in the data model this library reads).
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
IUPAC_AA = {a: a for a in AMINO_ACIDS} | {"B": "NR", "Z": "EQ", "J": "IL", "X": AMINO_ACIDS + "*", "*": "*"}
# Three-letter names of the amino acids.
ABBREV_AA = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile",
    "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val",
}
# The standard genetic code, codons in TCAG order.
CODONS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Positions of the regions of an aligned V segment, first and last.
V_REGIONS = {"fwr1": (1, 78), "cdr1": (79, 114), "fwr2": (115, 165), "cdr2": (166, 195), "fwr3": (196, 312)}
# Published scales: hydropathy (KYTJ820101), bulkiness (ZIMJ680102), polarity (GRAR740102), pK (EMBOSS).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
BULKINESS = {
    "A": 11.50, "R": 14.28, "N": 12.82, "D": 11.68, "C": 13.46, "Q": 14.45, "E": 13.57, "G": 3.40, "H": 13.69, "I": 21.40,
    "L": 21.40, "K": 15.71, "M": 16.25, "F": 19.80, "P": 17.43, "S": 9.47, "T": 15.77, "W": 21.67, "Y": 18.03, "V": 21.57,
}
POLARITY = {
    "A": 8.1, "R": 10.5, "N": 11.6, "D": 13.0, "C": 5.5, "Q": 10.5, "E": 12.3, "G": 9.0, "H": 10.4, "I": 5.2,
    "L": 4.9, "K": 11.3, "M": 5.7, "F": 5.2, "P": 8.0, "S": 9.2, "T": 8.6, "W": 5.4, "Y": 6.2, "V": 5.9,
}
PK = {"C": 8.5, "D": 3.9, "E": 4.1, "H": 6.5, "K": 10.8, "R": 12.5, "Y": 10.1}


def codon_table() -> dict[str, str]:
    """Amino acid of every unambiguous codon."""
    bases = "TCAG"
    return {a + b + c: CODONS[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def codes_of(bases: str) -> str:
    """The nucleotide code that stands for exactly these bases."""
    wanted = set(bases)
    return next(code for code, meant in IUPAC_DNA.items() if set(meant) == wanted)


def _matrix(codes: dict[str, str], gap: float, gap_to_gap: float) -> dict[tuple[str, str], float]:
    out: dict[tuple[str, str], float] = {}
    for a, x in codes.items():
        for b, y in codes.items():
            out[a, b] = 0.0 if set(x) & set(y) else 1.0
    for g in "-.":
        for a in codes:
            out[g, a] = out[a, g] = gap
        for h in "-.":
            out[g, h] = gap_to_gap
    return out


def dna_matrix(gap: float = -1) -> dict[tuple[str, str], float]:
    """Distances of nucleotide codes: 0 if they share a base, else 1; ``gap`` to a gap, 0 between gaps; ``?`` equals itself only."""
    out = _matrix(IUPAC_DNA, gap, 0.0)
    for a in [*IUPAC_DNA, "-", "."]:
        out["?", a] = out[a, "?"] = 1.0
    return out | {("?", "?"): 0.0}


def aa_matrix(gap: float = 0) -> dict[tuple[str, str], float]:
    """Distances of amino-acid codes: 0 if they share a residue, else 1; ``gap`` to a gap and between gaps."""
    return _matrix(IUPAC_AA, gap, gap)
