"""Geometry of many structures at once, as column arithmetic; linear algebra needs Python in one place only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: Half a unit of the sixth place occurs in averages, and engines round it either way; this much more decides it.
NUDGE = 1.3e-8
#: Edge of the cubic volume that structures are placed in the middle of.
VOLUME = 264


def half_away(y: Column) -> Column:
    """The nearest whole number as a double, halves away from zero: no decimal text in between, as other engines do it."""
    r = F.rint(y)
    return r + F.when((y > 0) & (y - r == 0.5), 1.0).when((y < 0) & (y - r == -0.5), -1.0).otherwise(0.0)


def six(c: str | Column) -> Column:
    """Six places, ties and the sign of zero settled; by the same steps of double precision as in SQL."""
    return half_away(((F.col(c) if isinstance(c, str) else c) + NUDGE) * 1e6) / 1e6 + 0.0


def real(c: str) -> Column:
    """NaN as null, which aggregates leave out."""
    return F.when(~F.isnan(c), F.col(c))


def extent(atoms: DataFrame, by: str = "cath_domain") -> DataFrame:
    """Centre (four places), least and greatest coordinates of each structure."""
    return atoms.groupBy(by).agg(*(F.bround(F.avg(real(c)), 4).alias(f"c{c}") for c in XYZ), *(F.min(real(c)).alias(f"min_{c}") for c in XYZ), *(F.max(real(c)).alias(f"max_{c}") for c in XYZ))


def bounding_length(atoms: DataFrame, by: str = "cath_domain", buffer: float = 0.0, share: float | None = None) -> DataFrame:
    """Even length of a cube that holds the structure and a margin: so much, or such a share of it."""
    e = extent(atoms, by)
    size = F.sqrt(sum(((F.col(f"max_{c}") - F.col(f"min_{c}")) ** 2 for c in XYZ[1:]), (F.col("max_x") - F.col("min_x")) ** 2))
    length = F.ceil(size) + (F.lit(buffer) if share is None else F.ceil(F.ceil(size) * share))
    return e.select(by, (F.ceil(length / 2) * 2).cast("long").alias("length"))


def shift(atoms: DataFrame, to: tuple[float, float, float] | None = None, by: str = "cath_domain") -> DataFrame:
    """Structures moved with their centre to a point (None: the origin)."""
    w = Window.partitionBy(by)
    return atoms.withColumns({c: F.col(c) - F.bround(F.avg(real(c)).over(w), 4) + (0.0 if to is None else float(to[i])) for i, c in enumerate(XYZ)})


def rotate(atoms: DataFrame, matrix: list[list[float]], to: tuple[float, float, float] = (VOLUME / 2,) * 3, by: str = "cath_domain") -> DataFrame:
    """Row vectors times a matrix, about the centre; then moved to a point (None: they stay at the origin)."""
    own = shift(atoms, None, by)
    new = {c: F.bround(sum((F.col(XYZ[i]) * float(matrix[i][j]) for i in (1, 2)), F.col("x") * float(matrix[0][j])), 4) + (0.0 if to is None else float(to[j])) for j, c in enumerate(XYZ)}
    return own.withColumns(new)


def random_rotations(domains: DataFrame, n: int, by: str = "cath_domain", seed: int = 0) -> DataFrame:
    """``n`` uniform rotations of each key: unit quaternions from three uniform numbers hashed from key, number and seed."""
    rows = domains.select(by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rotation"))
    u = [F.pmod(F.xxhash64(by, "rotation", F.lit(k), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52) for k in range(3)]
    tau = 2 * np.pi
    a, b = F.sqrt(1 - u[0]), F.sqrt(u[0])
    q = {"qx": a * F.sin(tau * u[1]), "qy": a * F.cos(tau * u[1]), "qz": b * F.sin(tau * u[2]), "qw": b * F.cos(tau * u[2])}
    x, y, z, w = (F.col(c) for c in q)
    m = ((1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)))
    return rows.withColumns(q).select(by, "rotation", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))


def rotate_each(atoms: DataFrame, rotations: DataFrame, to: float = VOLUME / 2, by: str = "cath_domain") -> DataFrame:
    """Every structure under each of its rotations."""
    own = shift(atoms, None, by).join(rotations, by)
    new = {c: F.bround(F.col("x") * F.col(f"m0{j}") + F.col("y") * F.col(f"m1{j}") + F.col("z") * F.col(f"m2{j}"), 4) + to for j, c in enumerate(XYZ)}
    return own.withColumns(new).drop(*(f"m{i}{j}" for i in range(3) for j in range(3)))


def euler_matrix(theta: Column, phi: Column, z: Column) -> list[list[Column]]:
    """Rotation about the pole by theta, then a reflection that deflects it by phi and z."""
    r = F.sqrt(z)
    v = (F.sin(phi) * r, F.cos(phi) * r, F.sqrt(2.0 - z))
    st, ct = F.sin(theta), F.cos(theta)
    s = (v[0] * ct - v[1] * st, v[0] * st + v[1] * ct)
    return [[v[0] * s[0] - ct, v[0] * s[1] - st, v[0] * v[2]], [v[1] * s[0] + st, v[1] * s[1] - ct, v[1] * v[2]], [v[2] * s[0], v[2] * s[1], 1.0 - z]]


_AXES = "m00 double, m01 double, m02 double, m10 double, m11 double, m12 double, m20 double, m21 double, m22 double"


def principal_axes(atoms: DataFrame, by: str = "cath_domain") -> DataFrame:
    """Matrix of each structure's principal axes, the longest first; the largest component of an axis is positive.
    Covariances are aggregates; only the 3 x 3 eigenvectors, one small row a structure, are found in numpy."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    cov = atoms.groupBy(by).agg(*(F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in pairs))

    def eigen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {n: batch[n].to_numpy(zero_copy_only=False) for n in (f"v{a}{b}" for a, b in pairs)}
            m = np.array([[v["vxx"], v["vxy"], v["vxz"]], [v["vxy"], v["vyy"], v["vyz"]], [v["vxz"], v["vyz"], v["vzz"]]]).transpose(2, 0, 1)
            vec = np.linalg.eigh(m)[1][:, :, ::-1] if len(m) else np.zeros((0, 3, 3))
            sign = np.sign(np.take_along_axis(vec, np.abs(vec).argmax(1)[:, None, :], 1))
            vec = vec * np.where(sign == 0, 1, sign)
            yield pa.RecordBatch.from_arrays([batch[by], *(pa.array(vec[:, i, j]) for i in range(3) for j in range(3))], [by, *(f"m{i}{j}" for i in range(3) for j in range(3))])

    return cov.mapInArrow(eigen, f"{by} {dict(atoms.dtypes)[by]}, {_AXES}")


def transform(atoms: DataFrame, matrix: list[list[float]], move: tuple[float, float, float]) -> DataFrame:
    """Column vectors: x' = M x + t."""
    return atoms.withColumns({c: sum((F.col(XYZ[j]) * float(matrix[i][j]) for j in range(3)), F.lit(float(move[i]))) for i, c in enumerate(XYZ)})


def symmetry(text: str) -> tuple[list[list[float]], tuple[float, float, float]]:
    """Matrix and shift of an operator like ``-Y,X+1/2,Z``."""
    rows, move = [], []
    for part in text.upper().replace(" ", "").split(","):
        row, at, sign, number = [0.0, 0.0, 0.0], 0.0, 1.0, ""
        for ch in part + "+":
            if ch in "+-":
                if number:
                    a, _, b = number.partition("/")
                    at += sign * float(a) / (float(b) if b else 1.0)
                number, sign = "", 1.0 if ch == "+" else -1.0
            elif ch in "XYZ":
                row["XYZ".index(ch)] += sign
            else:
                number += ch
        rows.append(row)
        move.append(at)
    return rows, tuple(move)


def sub(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: list[Column], b: list[Column]) -> Column:
    """In radians; the cosine is held to -1..1. Null if a vector is zero."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def dihedral(p: list[list[Column]], degrees: bool = True) -> Column:
    """Torsion of four points about the middle two."""
    b0, b1, b2 = sub(p[0], p[1]), sub(p[2], p[1]), sub(p[3], p[2])
    n = norm(b1)
    b1 = [F.try_divide(c, n) for c in b1]
    v = sub(b0, [dot(b0, b1) * c for c in b1])
    w = sub(b2, [dot(b2, b1) * c for c in b1])
    out = F.atan2(dot(cross(b1, v), w), dot(v, w))
    return F.degrees(out) if degrees else out


def radius_of_gyration(atoms: DataFrame, by: str = "cath_domain", normalize: bool = True) -> DataFrame:
    """Root of the mean (or, without ``normalize``, of the summed) squared distance from the centre."""
    w = Window.partitionBy(by)
    d2 = sum(((F.col(c) - F.avg(c).over(w)) ** 2 for c in XYZ), F.lit(0.0))
    return atoms.withColumn("_d2", d2).groupBy(by).agg(F.sqrt((F.avg if normalize else F.sum)("_d2")).alias("rg"))


def rmsd(left: DataFrame, right: DataFrame, on: list[str], by: str = "cath_domain", normalize: bool = True) -> DataFrame:
    r = right.select(*on, *(F.col(c).alias(f"_{c}") for c in XYZ))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in XYZ), F.lit(0.0))
    return left.join(r, on).groupBy(by).agg(F.sqrt((F.avg if normalize else F.sum)(d2)).alias("rmsd"))


def seven_points(sites: DataFrame, by: str, step: float = 5.0) -> DataFrame:
    """The centroid of each site, and the points a step away along each axis."""
    c = sites.groupBy(by).agg(*(F.avg(x).alias(x) for x in XYZ))
    moves = F.array(*(F.array(*(F.lit(float(s) if i == k else 0.0) for i in range(3))) for k, s in [(0, 0), *((k, s) for k in range(3) for s in (step, -step))]))
    return c.select(by, F.posexplode(moves).alias("point", "d"), *XYZ).select(by, "point", *((F.col(x) + F.col("d")[i]).alias(x) for i, x in enumerate(XYZ)))


def compare_placements(reference: DataFrame, first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """How far two placements of an interface are from the reference, by the seven points of either side (columns side 1 or
    2, point, x, y, z): root mean squares over both sides under the placement that fits side 1 (rmsd_a) and the one that fits
    side 2 (rmsd_b), their mean and minimum, and that of the sides each under its own placement (best)."""
    side = lambda d, n: d.select(by, "side", "point", *(F.col(c).alias(f"{n}{c}") for c in XYZ))
    rows = reference.select(by, "side", "point", *XYZ).join(side(first, "a"), [by, "side", "point"]).join(side(second, "b"), [by, "side", "point"])
    d = lambda n: sum(((F.col(c) - F.col(f"{n}{c}")) ** 2 for c in XYZ), F.lit(0.0))
    own = F.when(F.col("side") == 1, d("a")).otherwise(d("b"))
    out = rows.groupBy(by).agg(*(F.sqrt(F.avg(x)).alias(n) for n, x in (("rmsd_a", d("a")), ("rmsd_b", d("b")), ("best", own))))
    return out.withColumns({"mean": (F.col("rmsd_a") + F.col("rmsd_b")) / 2, "least": F.least("rmsd_a", "rmsd_b")})


def random_flips(atoms: DataFrame, share: float = 0.5, by: str = "cath_domain", seed: int = 0) -> DataFrame:
    """Mirrors structures about their centre along each axis with that probability, drawn by a hash of key, axis and seed."""
    w = Window.partitionBy(by)
    cols = {}
    for c in XYZ:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(by).cast("string"), F.lit(c), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
        cols[c] = F.when(u < share, 2 * F.bround(F.avg(real(c)).over(w), 4) - F.col(c)).otherwise(F.col(c))
    return atoms.withColumns(cols)


def assembly(atoms: DataFrame, operators: DataFrame, by: str = "cath_domain") -> DataFrame:
    """Every structure under each of its operators: rows (key, copy, axis 1..3, a, b, c, t), three to a matrix."""
    m = operators.groupBy(by, "copy").agg(*(F.max(F.when(F.col("axis") == k + 1, F.col(c))).alias(f"o{c}{k}") for k in range(3) for c in "abct"))
    new = {f"_{x}": F.col("x") * F.col(f"oa{k}") + F.col("y") * F.col(f"ob{k}") + F.col("z") * F.col(f"oc{k}") + F.col(f"ot{k}") for k, x in enumerate(XYZ)}
    out = atoms.join(m, by).withColumns(new)
    return out.withColumns({x: F.col(f"_{x}") for x in XYZ}).drop(*(f"o{c}{k}" for k in range(3) for c in "abct"), *new)
