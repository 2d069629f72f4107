"""Queries on geometry, neighbours and voxels over the atom view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import spatial as S
from ..operators import voxel as V
from ..sources import structures as T
from .q_rows import plain
from .registry import digest, digest_sql, r6

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_LATTICE = """
SELECT * FROM (SELECT *, unnest(generate_series(CAST(ceil(z - r) AS BIGINT), CAST(floor(z + r) AS BIGINT))) AS vz
 FROM (SELECT *, unnest(generate_series(CAST(ceil(y - r) AS BIGINT), CAST(floor(y + r) AS BIGINT))) AS vy
  FROM (SELECT *, unnest(generate_series(CAST(ceil(x - r) AS BIGINT), CAST(floor(x + r) AS BIGINT))) AS vx FROM (SELECT *, {r} AS r FROM {t}))))
WHERE (vx - x) * (vx - x) + (vy - y) * (vy - y) + (vz - z) * (vz - z) <= r * r"""


def lattice(t: str = "atoms", r: str = "vdw_radii") -> str:
    return _LATTICE.format(t=t, r=r)


@plain("GE1_extent", """
SELECT cath_domain, round_even(avg(x), 4) AS cx, round_even(avg(y), 4) AS cy, round_even(avg(z), 4) AS cz, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x,
  max(y) AS max_y, max(z) AS max_z FROM atoms GROUP BY cath_domain""", "atoms")
def ge1(a):
    return G.extent(a)


@plain("GE2_bounding_length", "SELECT cath_domain, CAST(ceil((ceil(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2)) + 10) / 2) * 2 AS BIGINT) AS length FROM atoms GROUP BY cath_domain", "atoms")
def ge2(a):
    return G.bounding_length(a, buffer=10.0)


@plain("GE3_shift", """
SELECT cath_domain, serial_number, round(x - round_even(avg(x) OVER w, 4) + 132, 6) AS x, round(y - round_even(avg(y) OVER w, 4) + 132, 6) AS y, round(z - round_even(avg(z) OVER w,
  4) + 132, 6) AS z FROM atoms WINDOW w AS (PARTITION BY cath_domain)""", "atoms")
def ge3(a):
    return G.shift(a, (132.0,) * 3).select("cath_domain", "serial_number", *(r6(c).alias(c) for c in "xyz"))


@plain("GE4_rotate", """
WITH s AS (SELECT cath_domain, serial_number, x - round_even(avg(x) OVER w, 4) AS x, y - round_even(avg(y) OVER w, 4) AS y, z - round_even(avg(z) OVER w, 4) AS z FROM atoms
  WINDOW w AS (PARTITION BY cath_domain))
SELECT cath_domain, serial_number, round(132 - y, 6) AS x, round(132 + x, 6) AS y, round(132 + z, 6) AS z FROM s""", "atoms")
def ge4(a):
    return G.rotate(a, [[0, 1, 0], [-1, 0, 0], [0, 0, 1]]).select("cath_domain", "serial_number", *(r6(c).alias(c) for c in "xyz"))


@plain("GE5_random_rotations", None, "atoms")
def ge5(a):
    return G.rotate_each(a.select("cath_domain", "serial_number", "x", "y", "z"), G.random_rotations(a.select("cath_domain").distinct(), 2))


_EULER = (
    "d AS (SELECT cath_domain, avg(x) / 10 AS t, avg(y) / 10 AS p, avg(residue_rasa) AS u FROM atoms GROUP BY ALL), "
    "v AS (SELECT cath_domain, sin(t) AS st, cos(t) AS ct, sin(p) * sqrt(u) AS a, cos(p) * sqrt(u) AS b, sqrt(2 - u) AS c, u FROM d), s AS (SELECT *, a * ct - b * st AS sx, a * st + b * ct AS sy FROM v)"
)
_EULER_M = (("a * sx - ct", "a * sy - st", "a * c"), ("b * sx + st", "b * sy - ct", "b * c"), ("c * sx", "c * sy", "1 - u"))


@plain("GE6_legacy_rotation", f"WITH {_EULER} SELECT cath_domain, {', '.join(f'round({_EULER_M[i][j]}, 6) AS m{i}{j}' for i in range(3) for j in range(3))} FROM s", "atoms")
def ge6(a):
    d = a.groupBy("cath_domain").agg((F.avg("x") / 10).alias("theta"), (F.avg("y") / 10).alias("phi"), (F.avg("residue_rasa")).alias("u"))
    m = G.euler_matrix(F.col("theta"), F.col("phi"), F.col("u"))
    return d.select("cath_domain", *(r6(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


@plain("GE7_principal_axes", None, "atoms")
def ge7(a):
    return G.rotate_each(a.select("cath_domain", "serial_number", "x", "y", "z"), G.principal_axes(a), 0.0)


@plain("GE8_rigid_transform", "SELECT cath_domain, serial_number, round(-y + 0.5, 6) AS x, round(x, 6) AS y, round(z - 1, 6) AS z FROM atoms", "atoms")
def ge8(a):
    return G.transform(a, *G.symmetry("-Y+1/2,X,Z-1")).select("cath_domain", "serial_number", *(r6(c).alias(c) for c in "xyz"))


@plain("GE9_assembly", "SELECT cath_domain, serial_number, copy, round(CASE copy WHEN 1 THEN x ELSE -x + 10 END, 6) AS x, round(CASE copy WHEN 1 THEN y ELSE -y + 20 END, 6) AS y, round(z, 6) AS z FROM atoms, (VALUES (1), (2)) t(copy)", "atoms")
def ge9(a):
    rows = [(c, k + 1, *(float(v) for v in m), float(t)) for c, mat, mv in ((1, ((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0, 0, 0)), (2, ((-1, 0, 0), (0, -1, 0), (0, 0, 1)), (10, 20, 0))) for k, (m, t) in enumerate(zip(mat, mv, strict=True))]
    two = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("copy", "axis", "a", "b", "c", "t"), r, strict=True))) for r in rows)))
    ops = a.select("cath_domain").distinct().select("cath_domain", two.alias("o")).select("cath_domain", "o.*")
    return G.assembly(a, ops).select("cath_domain", "serial_number", "copy", *(r6(c).alias(c) for c in "xyz"))


@plain("GE10_angles", """
SELECT cath_domain, serial_number, CASE WHEN sqrt(x * x + y * y + z * z) * sqrt(px * px + py * py + pz * pz) <> 0 THEN round(acos(greatest(-1, least(1,
  (x * px + y * py + z * pz) / (sqrt(x * x + y * y + z * z) * sqrt(px * px + py * py + pz * pz))))), 6) END AS angle
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM atoms WINDOW w AS (PARTITION BY cath_domain ORDER BY serial_number))""", "atoms")
def ge10(a):
    from pyspark.sql import Window

    w = Window.partitionBy("cath_domain").orderBy("serial_number")
    b = a.withColumns({f"p{c}": F.lag(c).over(w) for c in "xyz"})
    return b.select("cath_domain", "serial_number", r6(G.angle([F.col(c) for c in "xyz"], [F.col(f"p{c}") for c in "xyz"])).alias("angle"))


@plain("GE11_radius_of_gyration", """
SELECT cath_domain, round(sqrt(avg(d)), 6) AS rg FROM (SELECT cath_domain, (x - avg(x) OVER w) ** 2 + (y - avg(y) OVER w) ** 2 + (z - avg(z) OVER w) ** 2 AS d FROM atoms
  WINDOW w AS (PARTITION BY cath_domain)) GROUP BY cath_domain""", "atoms")
def ge11(a):
    return G.radius_of_gyration(a).withColumn("rg", r6("rg"))


@plain("GE11b_rmsd", "SELECT cath_domain, round(sqrt(avg((x - z) ** 2 + (z - x) ** 2)), 6) AS rmsd FROM atoms GROUP BY cath_domain", "atoms")
def ge11b(a):
    by = ["cath_domain", "serial_number"]
    return G.rmsd(a.select(*by, "x", "y", "z"), a.select(*by, F.col("z").alias("x"), "y", F.col("x").alias("z")), by).withColumn("rmsd", r6("rmsd"))


@plain("GE12_seven_points", """
WITH c AS (SELECT cath_domain, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms WHERE chain = 'A' GROUP BY cath_domain)
SELECT cath_domain, p AS point, round(x + dx, 6) AS x, round(y + dy, 6) AS y, round(z + dz, 6) AS z
  FROM c, (VALUES (0, 0, 0, 0), (1, 5, 0, 0), (2, -5, 0, 0), (3, 0, 5, 0), (4, 0, -5, 0), (5, 0, 0, 5), (6, 0, 0, -5)) t(p, dx, dy, dz)""", "atoms")
def ge12(a):
    return G.seven_points(a.where("chain = 'A'"), "cath_domain").select("cath_domain", "point", *(r6(c).alias(c) for c in "xyz"))


@plain("J1_atom_pairs", f"SELECT a.cath_domain, a.serial_number AS a, b.serial_number AS b, round(sqrt({_D2}), 6) AS distance FROM atoms a JOIN atoms b ON a.cath_domain = b.cath_domain AND a.serial_number < b.serial_number WHERE sqrt({_D2}) <= 5", "atoms")
def j1(a):
    return S.atom_pairs(a.select("cath_domain", "serial_number", "x", "y", "z"), 5.0).withColumn("distance", r6("distance"))


@plain("J1b_residue_pairs", f"""
SELECT a.cath_domain, least(a.residue_id, b.residue_id) AS src, greatest(a.residue_id, b.residue_id) AS dst, round(min(sqrt({_D2})), 6) AS distance FROM atoms a JOIN atoms b
  ON a.cath_domain = b.cath_domain AND a.serial_number < b.serial_number AND a.residue_id <> b.residue_id WHERE sqrt({_D2}) <= 5 GROUP BY ALL""", "atoms")
def j1b(a):
    return S.residue_pairs(a, 5.0).withColumn("distance", r6("distance"))


@plain("J2_interface_contacts", f"""
SELECT a.cath_domain, a.serial_number AS a, b.serial_number AS b, round(sqrt({_D2}), 6) AS distance FROM atoms a JOIN atoms b ON a.cath_domain = b.cath_domain
  AND a.serial_number < b.serial_number AND a.chain <> b.chain WHERE sqrt({_D2}) <= 5.5""", "atoms")
def j2(a):
    return S.interface_contacts(a).withColumn("distance", r6("distance"))


_J3_D = (['cath_domain'], ['serial_number', 'vx', 'vy', 'vz'], ['vx', 'vy'])


@plain("J3_lattice_points", digest_sql(f"SELECT cath_domain, serial_number, vx, vy, vz FROM ({lattice()})", *_J3_D), "atoms")
def j3(a):
    return digest(S.lattice_points(a.select("cath_domain", "serial_number", "x", "y", "z", "vdw_radii")).select("cath_domain", "serial_number", "vx", "vy", "vz"), *_J3_D)


@plain("J3b_nearest_voxel", "SELECT cath_domain, serial_number, CAST(floor(x + 0.5) AS BIGINT) AS vx, CAST(floor(y + 0.5) AS BIGINT) AS vy, CAST(floor(z + 0.5) AS BIGINT) AS vz FROM atoms", "atoms")
def j3b(a):
    return S.nearest_point(a).select("cath_domain", "serial_number", "vx", "vy", "vz")


@plain("J4_voxel_atoms", f"""
WITH v AS (SELECT DISTINCT cath_domain, CAST(floor(x + 0.5) AS BIGINT) AS vx, CAST(floor(y + 0.5) AS BIGINT) AS vy, CAST(floor(z + 0.5) AS BIGINT) AS vz FROM atoms),
n AS ({lattice(r='2.75::DOUBLE')})
SELECT cath_domain, vx, vy, vz, serial_number, residue_id FROM v JOIN (SELECT cath_domain, serial_number, residue_id, vx, vy, vz FROM n) USING (cath_domain, vx, vy, vz)""", "atoms")
def j4(a):
    return S.voxel_atoms(S.nearest_point(a), a)


@plain("J5_overlap_voxels", f"""
WITH v AS (SELECT cath_domain AS d, serial_number AS s, vx, vy, vz FROM ({lattice()})),
p AS (SELECT a.cath_domain AS d, a.serial_number AS a, b.serial_number AS b FROM atoms a JOIN atoms b ON a.cath_domain = b.cath_domain AND a.serial_number < b.serial_number
  AND a.chain <> b.chain WHERE sqrt({_D2}) <= 5),
n AS (SELECT d, s, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT p.d, a, b, count(*) AS n FROM p JOIN v x ON x.d = p.d AND x.s = a JOIN v y ON y.d = p.d AND y.s = b AND x.vx = y.vx AND x.vy = y.vy AND x.vz = y.vz GROUP BY ALL)
SELECT p.d AS cath_domain, p.a, p.b, coalesce(o.n, 0) AS n_both, coalesce(x.n, 0) - coalesce(o.n, 0) AS only_a, coalesce(y.n, 0) - coalesce(o.n, 0) AS only_b FROM p LEFT JOIN o
  ON o.d = p.d AND o.a = p.a AND o.b = p.b LEFT JOIN n x ON x.d = p.d AND x.s = p.a LEFT JOIN n y ON y.d = p.d AND y.s = p.b""", "atoms")
def j5(a):
    return S.overlap_voxels(a)


_AG1_D = (['cath_domain'], ['vx', 'vy', 'vz'], ['charge', 'residue_rasa', 'n_atoms', 'bfactor'])


@plain("AG1_voxel_max", digest_sql(f"""
SELECT cath_domain, vx, vy, vz, greatest(0, max(charge)) AS charge, greatest(0, max(residue_rasa)) AS residue_rasa, count(*) AS n_atoms, greatest(0, max(bfactor)) AS bfactor
  FROM ({lattice()}) GROUP BY ALL""", *_AG1_D), "atoms")
def ag1(a):
    return digest(V.voxelize(a, ["charge", "residue_rasa"]), *_AG1_D)


_AG2_D = (['cath_domain'], ['vx', 'vy', 'vz'], ['charge', 'residue_rasa', 'n_atoms', 'bfactor'])


@plain("AG2_voxel_by_rule", digest_sql(f"SELECT cath_domain, vx, vy, vz, round(avg(charge), 6) AS charge, min(residue_rasa) AS residue_rasa, count(*) AS n_atoms, greatest(0, max(bfactor)) AS bfactor FROM ({lattice()}) GROUP BY ALL", *_AG2_D), "atoms")
def ag2(a):
    return digest(V.voxelize(a, ["charge", "residue_rasa"], rules={"charge": "mean", "residue_rasa": "min"}).withColumn("charge", r6("charge")), *_AG2_D)


@plain("AG3_occupancy", f"SELECT cath_domain, count(*) AS n_voxels FROM (SELECT DISTINCT cath_domain, vx, vy, vz FROM ({lattice()})) GROUP BY cath_domain", "atoms")
def ag3(a):
    return V.voxelize(a, []).groupBy("cath_domain").agg(F.count("*").alias("n_voxels"))


@plain("AG4_raw_sample", "SELECT cath_domain, round_even(x, 4) AS x, round_even(y, 4) AS y, round_even(z, 4) AS z, greatest(0, max(charge)) AS charge FROM atoms GROUP BY ALL", "atoms")
def ag4(a):
    return V.raw_sample(a, ["charge"])


@plain("SK8_sparse_samples", f"""
WITH v AS (SELECT cath_domain, vx, vy, vz, greatest(0, max(charge)) AS q FROM ({lattice()}) GROUP BY ALL)
SELECT cath_domain, count(*) AS n, sum(q) > 0 AS any_charge, md5(string_agg(concat(vx, ',', vy, ',', vz), ';' ORDER BY vx, vy, vz)) AS places FROM v GROUP BY cath_domain""", "atoms")
def sk8(a):
    s = V.sparse_samples(V.voxelize(a, ["charge"]), ["charge"])
    text = F.array_join(F.transform("coords", lambda c: F.array_join(c.cast("array<string>"), ",")), ";")
    return s.select("cath_domain", F.size("coords").cast("long").alias("n"), (F.aggregate("feats", F.lit(0.0), lambda t, f: t + f[0]) > 0).alias("any_charge"), F.md5(text).alias("places"))


@plain("GE7b_random_flips", "WITH u AS (SELECT *, " + ", ".join(f"CAST(concat('0x', substr(md5(concat(cath_domain, ':{c}:0')), 1, 8)) AS BIGINT) / 4294967296::DOUBLE AS u{c}, round_even(avg({c}) OVER (PARTITION BY cath_domain), 4) AS c{c}" for c in "xyz") + " FROM atoms) SELECT cath_domain, serial_number, " + ", ".join(f"round(CASE WHEN u{c} < 0.5 THEN 2 * c{c} - {c} ELSE {c} END, 6) AS {c}" for c in "xyz") + " FROM u", "atoms")
def ge7b(a):
    return G.random_flips(a).select("cath_domain", "serial_number", *(r6(c).alias(c) for c in "xyz"))


@plain("GE9b_read_assembly", """
SELECT cath_domain AS path, CAST(k AS INT) AS copy, CAST(r AS INT) AS axis, CASE WHEN r = 1 THEN k - 1.5::DOUBLE ELSE 0 END AS a, CASE WHEN r = 2 THEN 1.0::DOUBLE ELSE 0 END AS b,
  CASE WHEN r = 3 THEN 1.0::DOUBLE ELSE 0 END AS c, k * 10.0::DOUBLE AS t FROM (SELECT DISTINCT cath_domain FROM atoms), (VALUES (1), (2)) k(k), (VALUES (1), (2), (3)) r(r)""", "atoms")
def ge9b(a):
    """Remarks with two biological assemblies, of which the first is read."""
    rows = a.select(F.col("cath_domain").alias("path")).distinct().withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("r", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    factor = F.when(F.col("r") == 1, F.col("k") - 1.5).otherwise(0.0)
    line = F.format_string("REMARK 350   BIOMT%d%4d%10.6f%10.6f%10.6f%15.5f", "r", "k", factor, (F.col("r") == 2).cast("double"), (F.col("r") == 3).cast("double"), F.col("k") * 10.0 * F.col("m"))
    body = rows.select("path", (F.col("m") * 100 + F.col("k") * 10 + F.col("r")).cast("long").alias("line_no"), line.alias("line"))
    head = rows.select("path", "m").distinct().select("path", (F.col("m") * 100).cast("long").alias("line_no"), F.concat(F.lit("REMARK 350 BIOMOLECULE: "), F.col("m").cast("string")).alias("line"))
    return T.read_assembly(body.unionByName(head))


_SITES = """
s AS (SELECT cath_domain, CASE chain WHEN 'A' THEN 1 ELSE 2 END AS side, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms WHERE chain IN ('A', 'R') GROUP BY ALL),
p AS (SELECT cath_domain, side, p, x + dx AS x, y + dy AS y, z + dz AS z
  FROM s, (VALUES (0, 0, 0, 0), (1, 5, 0, 0), (2, -5, 0, 0), (3, 0, 5, 0), (4, 0, -5, 0), (5, 0, 0, 5), (6, 0, 0, -5)) t(p, dx, dy, dz))"""


@plain("GE12b_compare_placements", f"""
WITH {_SITES}, d AS (SELECT cath_domain, side, (side * 1.0) ** 2 + 4 AS da, (y - x) ** 2 + (x - y) ** 2 AS db FROM p),
r AS (SELECT cath_domain, sqrt(avg(da)) AS a, sqrt(avg(db)) AS b, sqrt(avg(CASE WHEN side = 1 THEN da ELSE db END)) AS best FROM d GROUP BY ALL)
SELECT cath_domain, round(a, 6) AS rmsd_a, round(b, 6) AS rmsd_b, round(best, 6) AS best, round((a + b) / 2, 6) AS mean, round(least(a, b), 6) AS least FROM r""", "atoms")
def ge12b(a):
    """One placement is shifted, by more on the second side; the other one swaps two axes."""
    side = lambda c, n: G.seven_points(a.where(F.col("chain") == c), "cath_domain").withColumn("side", F.lit(n))
    reference = side("A", 1).unionByName(side("R", 2))
    moved = reference.withColumns({"x": F.col("x") + F.col("side"), "z": F.col("z") - 2})
    swapped = reference.withColumns({"x": F.col("y"), "y": F.col("x")})
    out = G.compare_placements(reference, moved, swapped, "cath_domain")
    return out.select("cath_domain", *(r6(c).alias(c) for c in ("rmsd_a", "rmsd_b", "best", "mean", "least")))
