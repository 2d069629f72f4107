"""Rounding, distances and torsions by the same steps as in SQL; neighbours and voxels with few copies."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from helixlake.operators import clusters, geometry, spatial, voxel
from helixlake.plans.registry import digest, digest_sql, r6, settled

ATOM = "cath_domain long, serial_number long, residue_id string, atom_name string, x double, y double, z double, bfactor double"


def residues(*places):
    """Atoms of residues: for each (name, [points]) its atoms in order."""
    rows, n = [], 0
    for name, points in places:
        for p in points:
            n += 1
            rows.append((1, n, name, "CB", *map(float, p), 1.0))
    return rows


def test_six_places_as_in_sql(spark):
    r = random.Random(3)
    near = [(k + 0.5) / 1e6 - geometry.NUDGE for k in (r.randrange(10**6, 3 * 10**7) for _ in range(20_000))]
    values = [*near, *(-v for v in near), 0.0, -0.0, -1e-9, 2.5e-6, -2.5e-6, 1e12, -3.7e15, math.inf]
    got = [x.v for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").repartition(4).select("i", r6("x").alias("v")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("create table t (i int, x double)")
    con.executemany("insert into t values (?, ?)", [(i, v) for i, v in enumerate(values[:300] + values[-8:])])
    want = dict(con.execute(settled("select i, round(x, 6) from t")).fetchall())
    want = [want[i] for i in range(308)]
    assert got[:300] + got[-8:] == want
    # the product of doubles decides, not the shortest decimal text
    assert got[: 2 * len(near)] == [math.copysign(math.floor(abs((v + geometry.NUDGE) * 1e6) + 0.5) / 1e6, v) for v in [*near, *(-v for v in near)]]
    empty = spark.createDataFrame([(None,), (math.nan,)], "x double").select(r6("x").alias("v")).collect()
    assert empty[0].v is None and math.isnan(empty[1].v)


def test_contacts_dont_rest_on_the_order_of_sums(spark):
    # the plain mean of a thousand times 0.1 is 0.0999999999999986, which is more than 12 from 12.1
    rows = residues(("1", [(0.1, 0, 0)] * 1000), ("2", [(12.1, 0, 0)]))
    got = clusters.contact_graph(spark.createDataFrame(rows, ATOM), 12.0).collect()
    assert [(x.src, x.dst, x.distance) for x in got] == [("1", "2", 12.0)]


def test_chirality_counts_six_places_as_sql_does(spark):
    rows = residues(("1", [(0.0007, 0, 0)]), ("2", [(0, 0.0007, 0)]))
    assert [x.chirality for x in clusters.edge_kernels(spark.createDataFrame(rows, ATOM), 12.0).collect()] == [1]


def test_dihedral_divides_as_sql_does(spark):
    r = random.Random(5)
    points = [tuple(r.randrange(500) / 10 for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, " + ", ".join(f"c{k} double" for k in range(12)))
    cols = [[F.col(f"c{3 * k + j}") for j in range(3)] for k in range(4)]
    got = [x.t for x in df.select("i", geometry.dihedral(cols, False).alias("t")).orderBy("i").collect()]

    def plain(p):
        p = [p[3 * k : 3 * k + 3] for k in range(4)]
        sub = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
        dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        b0, b1, b2 = sub(p[0], p[1]), sub(p[2], p[1]), sub(p[3], p[2])
        u = [c / math.sqrt(dot(b1, b1)) for c in b1]
        v, w = sub(b0, [dot(b0, u) * c for c in u]), sub(b2, [dot(b2, u) * c for c in u])
        x = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return math.atan2(dot(x, w), dot(v, w))

    assert got == pytest.approx([plain(p) for p in points], abs=1e-15)


def test_digest_is_that_of_sql(spark):
    rows = [(k % 3, k, -k, k / 7 - 2, None if k % 5 == 0 else k / 1000) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, a long, b long, u double, v double")
    parts = ["g"], ["a", "b"], ["u", "v"]
    got = {(x.g, x.n, x.digest) for x in digest(df, *parts).collect()}
    con = duckdb.connect()
    con.execute("create table t (g int, a bigint, b bigint, u double, v double)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    assert got == set(con.execute(digest_sql("select * from t", *parts)).fetchall())


def test_few_copies_of_a_point(spark):
    """On a wide box a point goes to half of the cells that it is near, 4.5 on average (before: 14)."""
    r = random.Random(11)
    df = spark.createDataFrame([(1, k, *(r.uniform(-100, 100) for _ in range(3))) for k in range(3000)], "cath_domain long, serial_number long, x double, y double, z double")
    pairs = spatial.neighbours(df, df, 5.0, ["cath_domain"])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0
    want = 0
    rows = df.collect()
    for i, a in enumerate(rows):
        want += sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 25 for b in rows[i + 1 :])
    assert pairs.count() == want


def test_voxels_of_pairs_without_voxel_joins(spark):
    r = random.Random(2)
    rows = [(g, k, f"{k % 4}", "AB"[k % 2], *(round(r.uniform(-4, 4), 1) for _ in range(3)), r.choice([1.2, 1.7, 2.0])) for g in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "cath_domain long, serial_number long, residue_id string, chain string, x double, y double, z double, vdw_radii double")
    out = spatial.overlap_voxels(df, 5.0)
    assert "vx" not in out._jdf.queryExecution().optimizedPlan().toString()
    cover = lambda p, q: {(i, j, k) for i in range(-8, 9) for j in range(-8, 9) for k in range(-8, 9) if (i - p[0]) * (i - p[0]) + (j - p[1]) * (j - p[1]) + (k - p[2]) * (k - p[2]) <= q * q}
    voxels = {(x[0], x[1]): cover(x[4:7], x[7]) for x in rows}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and math.dist(a[4:7], b[4:7]) <= 5:
                p, q = voxels[a[0], a[1]], voxels[b[0], b[1]]
                want.add((a[0], a[1], b[1], len(p & q), len(p - q), len(q - p)))
    assert {tuple(x) for x in out.collect()} == want
    near = spatial.voxel_atoms(spatial.nearest_point(df), df)
    assert "sequence" not in near._jdf.queryExecution().optimizedPlan().toString()
    places = {(x[0], *(math.floor(c + 0.5) for c in x[4:7])) for x in rows}
    hit = lambda v, x: sum((i - c) * (i - c) for i, c in zip(v[1:], x[4:7], strict=True)) <= 2.75 * 2.75
    assert {tuple(x) for x in near.collect()} == {(*v, x[1], x[2]) for v in places for x in rows if v[0] == x[0] and hit(v, x)}


def test_voxels_are_gathered_where_their_structure_is(spark):
    r = random.Random(4)
    rows = [(g, k, *(r.uniform(-9, 9) for _ in range(3)), 1.7, r.random(), r.random()) for g in range(6) for k in range(30)]
    df = spark.createDataFrame(rows, "cath_domain long, serial_number long, x double, y double, z double, vdw_radii double, charge double, bfactor double")
    v = voxel.voxelize(df, ["charge"])
    plan = v.groupBy("cath_domain").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of atoms; before, voxels were shuffled
    assert {(x.cath_domain, x.vx, x.vy, x.vz, x.n_atoms) for x in v.collect()} == {tuple(x) for x in spatial.lattice_points(df).groupBy("cath_domain", "vx", "vy", "vz").count().collect()}
