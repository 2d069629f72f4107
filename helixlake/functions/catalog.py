"""Chemistry tables and catalogue rules, and the column expressions built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii in angstrom by element, and by residue.
VDW_RADII = {"H": 1.2, "Li": 1.82, "Na": 2.27, "K": 2.75, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "Se": 1.90, "Zn": 1.39, "Cu": 1.4, "Ni": 1.63}
RESIDUE_RADII = {"ALA": 2.52, "ARG": 3.60, "ASN": 3.0, "ASP": 2.94, "CYS": 2.92, "GLN": 3.25, "GLU": 3.21, "GLY": 2.25, "HIS": 3.308, "ILE": 3.22, "LEU": 3.20, "LYS": 3.42, "MET": 3.37, "PHE": 3.47, "PRO": 2.93, "SER": 2.67, "THR": 2.90, "TRP": 3.73, "TYR": 3.55, "VAL": 3.01}

# Hydrophobicity by one-letter code.
KD = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
BIOLOGICAL = {"A": -0.11, "C": 0.13, "D": -3.49, "E": -2.68, "F": 0.32, "G": -0.74, "H": -2.06, "I": 0.60, "K": -2.71, "L": 0.55, "M": 0.10, "N": -2.05, "P": -2.23, "Q": -2.36, "R": -2.58, "S": -0.84, "T": -0.52, "V": 0.31, "W": -0.30, "Y": -0.68}
OCTANAL = {"A": -0.50, "C": 0.02, "D": -3.64, "E": -3.63, "F": 1.71, "G": -1.15, "H": -0.11, "I": 1.12, "K": -2.80, "L": 1.25, "M": 0.67, "N": -0.85, "P": -0.14, "Q": -0.77, "R": -1.81, "S": -0.46, "T": -0.25, "V": 0.46, "W": 2.09, "Y": 0.71}

# Three-letter to one-letter codes; modified residues map to their parent.
THREE_TO_ONE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
MODIFIED = {"ABA": "X", "ASH": "D", "CIR": "R", "CME": "C", "CMT": "C", "CSD": "C", "CSO": "C", "CSW": "C", "CSX": "C", "CYM": "C", "CYX": "C", "DDE": "H", "GLH": "G", "HID": "H", "HIE": "H", "HIP": "H", "HSD": "H", "HSE": "H", "HSP": "H", "IAS": "D", "KCX": "K", "LYN": "K", "MHO": "M", "MLY": "K", "MSE": "M", "OCS": "C", "PFF": "F", "PTR": "Y", "SEP": "S", "TPO": "T"}
RESIDUES = tuple(THREE_TO_ONE)

# Pharmacophore classes of atom types.
PHARMACOPHORE = {"hydrophobic_atom": ("C", "A"), "aromatic_atom": ("A",), "hbond_acceptor": ("NA", "NS", "OA", "OS", "SA"), "hbond_donor": ("HS", "HD"), "metal": ("MG", "ZN", "MN", "CA", "FE")}

# Booleans of the catalogue, as the column they come from and their conditions.
THRESHOLDS = {
    "neg_charge": ("charge", (("<", 0.0),)),
    "pos_charge": ("charge", ((">", 0.0),)),
    "is_electronegative": ("electrostatic_potential", (("<", 0.0),)),
    "is_concave": ("cx", (("<=", 2.0),)),
    "is_hydrophobic": ("kd", ((">", 0.0),)),
    "residue_buried": ("residue_rasa", (("<", 0.2),)),
    "is_conserved": ("entropy", (("<", 0.5),)),
    "is_highly_frustrated": ("frustration_index", (("<=", -1.0),)),
    "is_minimally_frustrated": ("frustration_index", ((">=", 0.78),)),
    "has_neutral_frustration": ("frustration_index", ((">=", -1.0), ("<=", 0.78))),
}

_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """A literal map, with a value for keys that it lacks."""
    found = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def one_letter(residue: Column, modified: bool = True) -> Column:
    return lookup(THREE_TO_ONE | (MODIFIED if modified else {}), residue, "X")


def threshold(col: Column, rules) -> Column:
    """1.0 where all conditions hold, else 0.0. NaN holds none but ``!=``; null stays null. Spark orders NaN above all
    numbers, so it is told apart first."""
    for op, _ in rules:
        if op not in _OPS:
            raise ValueError(f"unknown comparison {op}")
    real = None
    for op, value in rules:
        one = _OPS[op](col, F.lit(value))
        real = one if real is None else real & one
    return F.when(F.isnan(col), F.lit(1.0 if all(op == "!=" for op, _ in rules) else 0.0)).otherwise(real.cast("double"))


def one_hot(key: Column, names: tuple[str, ...], suffix: str, unknown: str) -> dict[str, Column]:
    """A 0.0/1.0 column for each name, and ``unknown`` for keys that are none of them (or null)."""
    out = {f"{n}{suffix}": F.coalesce((key == n).cast("double"), F.lit(0.0)) for n in names}
    out[unknown] = F.when(F.coalesce(key.isin(*names), F.lit(False)), 0.0).otherwise(1.0)
    return out
