"""Residues, their classes and fixed tables, and columns that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them as they are.
#: The order is the index of a residue everywhere.
ALPHABET = "MGKTRADEYVLQWFSHNPCI"
#: The order of printed matrices.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
THREE = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu",
    "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr",
}
ACIDIC, BASIC, POLAR, SMALL, HYDROPHOBIC = "DE", "KRH", "NQST", "GP", "AILMFWVYC"
CHARGED, POLAR_OR_CHARGED = ACIDIC + BASIC, "DEHKRNQST"
#: Weights in the standard order.
SURFACE = dict(zip(STANDARD, (0.35, -0.10, 0.95, 0.95, -0.75, 0.55, 0.35, -0.70, 1.00, -0.65, -0.35, 0.70, 0.80, 0.75, 1.00, 0.80, 0.55, -0.55, -1.00, -0.45)))
FLEX = dict(zip(STANDARD, (0.45, -0.10, 0.70, 0.70, -0.45, 1.00, 0.15, -0.55, 0.55, -0.45, -0.10, 0.55, 0.95, 0.55, 0.45, 0.80, 0.55, -0.40, -0.90, -0.25)))
#: Grantham's distances: a residue's row holds its distances to those after it in the standard order.
GRANTHAM = {
    "A": (195, 126, 107, 113, 60, 86, 94, 106, 96, 84, 111, 27, 91, 112, 99, 58, 64, 148, 112),
    "C": (154, 170, 205, 159, 174, 198, 202, 198, 196, 139, 169, 154, 180, 112, 149, 192, 215, 194),
    "D": (45, 177, 94, 81, 168, 101, 172, 160, 23, 108, 61, 96, 65, 85, 152, 181, 160),
    "E": (140, 98, 40, 134, 56, 138, 126, 42, 93, 29, 54, 80, 65, 121, 152, 122),
    "F": (153, 100, 21, 102, 22, 28, 158, 114, 116, 97, 155, 103, 50, 40, 22),
    "G": (98, 135, 127, 138, 127, 80, 42, 87, 125, 56, 59, 109, 184, 147),
    "H": (94, 32, 99, 87, 68, 77, 24, 29, 89, 47, 84, 115, 83),
    "I": (102, 5, 10, 149, 95, 109, 97, 142, 89, 29, 61, 33),
    "K": (107, 95, 94, 103, 53, 26, 121, 78, 97, 110, 85),
    "L": (15, 153, 98, 113, 102, 145, 92, 32, 61, 36),
    "M": (142, 87, 101, 91, 135, 81, 21, 67, 36),
    "N": (91, 46, 86, 46, 65, 133, 174, 143),
    "P": (76, 103, 74, 38, 68, 147, 110),
    "Q": (43, 68, 42, 96, 130, 99),
    "R": (110, 71, 96, 101, 77),
    "S": (58, 124, 177, 144),
    "T": (69, 128, 92),
    "V": (88, 55),
    "W": (37,),
}
#: Which residues of the target may stand in for a neighbour of the query's residue.
RESCUERS = {"F": "P", "W": "P", "Y": "P", "D": "RK", "E": "RK", "R": "DE", "K": "DE"}
SECOND_DONOR_WEIGHT, SECOND_DONOR_CAP = 0.35, 1.5

def distances() -> dict[tuple[str, str], int]:
    """All 400 distances; 0 on the diagonal."""
    out = {(a, a): 0 for a in STANDARD}
    for a, row in GRANTHAM.items():
        for b, d in zip(STANDARD[STANDARD.index(a) + 1 :], row):
            out[a, b] = out[b, a] = d
    return out


def index_of(residue: Column) -> Column:
    """0 to 19, or -1 for a letter that is no residue."""
    return F.instr(F.lit(ALPHABET), residue) - 1


def encode(sequence: Column) -> Column:
    return F.transform(F.split(sequence, ""), index_of)


def decode(indices: Column) -> Column:
    return F.array_join(F.transform(indices, lambda i: F.substring(F.lit(ALPHABET), i + 1, F.lit(1))), "")


def triplet_code(indices: Column) -> Column:
    return F.get(indices, 0) * 400 + F.get(indices, 1) * 20 + F.get(indices, 2)


def is_valid(sequence: Column) -> Column:
    return sequence.rlike(f"^[{ALPHABET}]+$")


def check_sequence(sequence: str, what: str = "sequence") -> str:
    """The sequence in upper case; an error if it is empty or holds other letters."""
    s = sequence.upper()
    if not s or set(s) - set(ALPHABET):
        raise ValueError(f"unsupported residues in {what}: {''.join(sorted(set(s) - set(ALPHABET)))!r}")
    return s
