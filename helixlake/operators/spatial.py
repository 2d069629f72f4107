"""Range joins by cells, and lattices by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import XYZ


#: A cell, and the 13 of its 26 neighbours that come after it in order: of each two neighbouring cells one has the other.
HALF_SHELL = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
SHELL = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


#: A cell is so many radii wide: wider cells send fewer copies of a point to others, and have more points to look at.
CELL = 2.0


def _cells(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({f"_g{c}": F.floor(F.col(c) / width) for c in XYZ})


def neighbours(left: DataFrame, right: DataFrame, radius: float, by: list[str], key: str = "serial_number", ordered: bool = True, extra: str | None = None) -> DataFrame:
    """Pairs within ``radius``: columns ``by``, those of both sides named a_<name> and b_<name>, distance.

    Space is cut in cells of twice the radius. Points meet those of their own cell and of the cells round it that are no
    farther than the radius, so the join is one on equal cells, and a point in the middle of a cell is not repeated.
    ``ordered``: both sides are one table and pairs come once, a < b; a point is then sent to half of the cells round its
    own, and a and b are told apart afterwards. ``extra``: a further condition on these names."""
    names = [c for c in left.columns if c not in by], [c for c in right.columns if c not in by]
    cells, width = [f"_g{c}" for c in XYZ], CELL * radius
    a = _cells(left, width).select(*by, *cells, *(F.col(c).alias(f"a_{c}") for c in names[0]))
    offsets = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(XYZ, o, strict=True))) for o in (HALF_SHELL if ordered else SHELL)))
    # a little more than the radius, as cells are found by a rounded quotient
    reach = radius * (1 + 1e-9) + 1e-9
    high = lambda c: F.col(c) + reach >= (F.col(f"_g{c}") + 1) * width
    low = lambda c: F.col(c) - reach <= F.col(f"_g{c}") * width
    b = _cells(right, width).withColumn("_near", F.struct(*(F.struct(low(c).alias("low"), high(c).alias("high")).alias(c) for c in XYZ)))
    within = lambda o, c: (o[c] == 0) | ((o[c] == 1) & F.col("_near")[c]["high"]) | ((o[c] == -1) & F.col("_near")[c]["low"])
    b = b.withColumn("_o", F.explode(F.filter(offsets, lambda o: within(o, "x") & within(o, "y") & within(o, "z"))))
    own = (F.col("_o.x") == 0) & (F.col("_o.y") == 0) & (F.col("_o.z") == 0)
    b = b.select(*by, *((F.col(f"_g{c}") + F.col(f"_o.{c}")).alias(f"_g{c}") for c in XYZ), own.alias("_own"), *(F.col(c).alias(f"b_{c}") for c in names[1]))
    step = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in XYZ]
    d = F.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2])
    out = a.join(b, [*by, *cells]).withColumn("distance", d).where(F.col("distance") <= radius)
    if ordered:
        less = F.col(f"a_{key}") < F.col(f"b_{key}")
        out = out.where((~F.col("_own") & (F.col(f"a_{key}") != F.col(f"b_{key}"))) | less)
        turned = {f"{s}_{c}": F.when(less, F.col(f"{s}_{c}")).otherwise(F.col(f"{t}_{c}")) for c in names[0] for s, t in (("a", "b"), ("b", "a"))}
        out = out.withColumns(turned)
    out = out.drop(*cells, "_own")
    return out.where(extra) if extra else out


def atom_pairs(atoms: DataFrame, radius: float, by: str = "cath_domain", extra: str | None = None) -> DataFrame:
    return neighbours(atoms, atoms, radius, [by], extra=extra).select(by, F.col("a_serial_number").alias("a"), F.col("b_serial_number").alias("b"), "distance")


def residue_pairs(atoms: DataFrame, radius: float, by: str = "cath_domain") -> DataFrame:
    """Pairs of residues with any two atoms within the radius, and the least distance."""
    p = neighbours(atoms.select(by, "serial_number", "residue_id", *XYZ), atoms.select(by, "serial_number", "residue_id", *XYZ), radius, [by], extra="a_residue_id != b_residue_id")
    return p.groupBy(by, F.least("a_residue_id", "b_residue_id").alias("src"), F.greatest("a_residue_id", "b_residue_id").alias("dst")).agg(F.min("distance").alias("distance"))


def interface_contacts(atoms: DataFrame, radius: float = 5.5, by: str = "cath_domain") -> DataFrame:
    """Pairs of atoms of two chains."""
    return atom_pairs(atoms.select(by, "serial_number", "chain", *XYZ), radius, by, "a_chain != b_chain")


def lattice_points(points: DataFrame, radius: str | float = "vdw_radii", spacing: float = 1.0) -> DataFrame:
    """Each lattice point within a point's radius, as vx, vy, vz: a sequence along each axis, as long as the sphere is wide at
    the places on the axes before; the last condition decides what lies on its surface."""
    r = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    out = points
    off = lambda c: (F.col(f"v{c}") * spacing - F.col(c)) * (F.col(f"v{c}") * spacing - F.col(c))
    left = r * r
    for c in XYZ:
        half = F.sqrt(F.greatest(F.lit(0.0), left)) + 1e-9
        out = out.withColumn(f"v{c}", F.explode(F.sequence(F.ceil((F.col(c) - half) / spacing), F.floor((F.col(c) + half) / spacing))))
        left = left - off(c)
    return out.where(off("x") + off("y") + off("z") <= r * r)


def nearest_point(points: DataFrame, spacing: float = 1.0) -> DataFrame:
    return points.withColumns({f"v{c}": F.floor(F.col(c) / spacing + 0.5) for c in XYZ})


def voxel_atoms(voxels: DataFrame, atoms: DataFrame, radius: float = 2.75, by: str = "cath_domain") -> DataFrame:
    """Atoms within the radius of each voxel: atoms and voxels are neighbours, no lattice is laid round the atoms."""
    v = voxels.select(by, "vx", "vy", "vz").distinct().select(by, *(F.col(f"v{c}").cast("double").alias(c) for c in XYZ), "vx", "vy", "vz")
    near = neighbours(v, atoms.select(by, "serial_number", "residue_id", *XYZ), radius * (1 + 1e-9), [by], ordered=False)
    step = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in XYZ]
    near = near.where(step[0] * step[0] + step[1] * step[1] + step[2] * step[2] <= radius * radius)
    return near.select(by, *(F.col(f"a_v{c}").alias(f"v{c}") for c in XYZ), F.col("b_serial_number").alias("serial_number"), F.col("b_residue_id").alias("residue_id"))


def lattice_count(x: list[Column], radius: Column, inside=None) -> Column:
    """How many lattice points (spacing 1) ``lattice_points`` makes of a point, as a column; ``inside(v)``: only those."""
    square = lambda v: (v[0] - x[0]) * (v[0] - x[0]) + (v[1] - x[1]) * (v[1] - x[1]) + (v[2] - x[2]) * (v[2] - x[2])

    def along(left: Column, found: list[Column]) -> Column:
        if len(found) == 3:
            ok = square(found) <= radius * radius
            return F.when(ok if inside is None else ok & inside(found), 1).otherwise(0)
        c = x[len(found)]
        half = F.sqrt(F.greatest(F.lit(0.0), left)) + 1e-9
        return F.aggregate(F.sequence(F.ceil(c - half), F.floor(c + half)), F.lit(0), lambda n, v: n + along(left - (v - c) * (v - c), [*found, v]))

    return F.coalesce(along(radius * radius, []), F.lit(0))


def overlap_voxels(atoms: DataFrame, radius: float = 5.0, by: str = "cath_domain") -> DataFrame:
    """For each pair of atoms of two chains within the radius, how many voxels both, only the first, and only the second
    cover. Both places are at hand in a pair, so voxels are counted there; none is joined and no voxel list is built."""
    own = atoms.select(by, "serial_number", "chain", "vdw_radii", *XYZ)
    own = own.withColumn("n", lattice_count([F.col(c) for c in XYZ], F.col("vdw_radii")).cast("long"))
    pairs = neighbours(own, own, radius, [by], extra="a_chain != b_chain")
    a, b = ([F.col(f"{s}_{c}") for c in XYZ] for s in "ab")
    ra, rb = F.col("a_vdw_radii"), F.col("b_vdw_radii")
    in_b = lambda v: (v[0] - b[0]) * (v[0] - b[0]) + (v[1] - b[1]) * (v[1] - b[1]) + (v[2] - b[2]) * (v[2] - b[2]) <= rb * rb
    both = F.when(F.col("distance") <= ra + rb + 1e-9, lattice_count(a, ra, in_b)).otherwise(0).cast("long")
    out = pairs.select(by, F.col("a_serial_number").alias("a"), F.col("b_serial_number").alias("b"), both.alias("n_both"), "a_n", "b_n")
    return out.select(by, "a", "b", "n_both", (F.col("a_n") - F.col("n_both")).alias("only_a"), (F.col("b_n") - F.col("n_both")).alias("only_b"))
