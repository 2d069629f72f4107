"""Sparse voxels of structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import lattice_points

V = ("vx", "vy", "vz")
#: Atoms in a task, about: its voxels (some twenty an atom) fit in the memory of one.
TASK_ATOMS = 100_000
_RULES = {"max": F.max, "min": F.min, "mean": F.avg}


def dealt(atoms: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Atoms with those of a structure in one task, in as many tasks as their number calls for. Voxels are made and gathered
    there; only atoms are shuffled."""
    return atoms.repartition(max(1, -(-atoms.count() // TASK_ATOMS)), *by)


def voxelize(atoms: DataFrame, features: list[str], by: tuple[str, ...] = ("cath_domain",), rules: dict[str, str] | None = None, truth: str | None = None) -> DataFrame:
    """One row a voxel that atoms cover: features, the number of atoms, the greatest b-factor.

    By default a feature is the greatest value there, and at least 0, as accumulators that start at zero give. ``rules``
    takes the catalogue's rule for each feature instead. Only columns used are carried through the lattice."""
    used = [c for c in dict.fromkeys([*by, "x", "y", "z", "vdw_radii", "bfactor", *features, *([truth] if truth else [])]) if c in atoms.columns]
    near = lattice_points(dealt(atoms.select(*used), by))
    floor = lambda c: F.greatest(F.lit(0.0), F.max(c))
    cols = [(_RULES[rules[f]](f) if rules else floor(f)).alias(f) for f in features if f != "bfactor"]
    if truth:
        cols.append(F.max(truth).alias(truth))
    return near.groupBy(*by, *V).agg(*cols, F.count("*").alias("n_atoms"), floor("bfactor").alias("bfactor"))


def raw_sample(atoms: DataFrame, features: list[str], by: tuple[str, ...] = ("cath_domain",)) -> DataFrame:
    """Features at the atoms' own places (four places), without a lattice."""
    return atoms.groupBy(*by, *(F.bround(c, 4).alias(c) for c in "xyz")).agg(*(F.greatest(F.lit(0.0), F.max(f)).alias(f) for f in features))


def sparse_samples(voxels: DataFrame, features: list[str], by: tuple[str, ...] = ("cath_domain",)) -> DataFrame:
    """One row a structure: its voxels' places and features as two ordered arrays. A structure is one sample by nature."""
    rows = F.sort_array(F.collect_list(F.struct(*V, *features)))
    out = voxels.groupBy(*by).agg(rows.alias("_v"))
    return out.select(*by, F.transform("_v", lambda v: F.array(*(v[c] for c in V))).alias("coords"), F.transform("_v", lambda v: F.array(*(v[f] for f in features))).alias("feats"))
