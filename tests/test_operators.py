"""Edge cases and properties of the structure operators."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions.catalog import threshold
from helixlake.operators import aggregates, clusters, filters, geometry, hierarchy, interact, records, spatial, trees, voxel
from helixlake.sources import structures
from helixlake.streaming import incremental

ATOM = "cath_domain string, serial_number long, residue_id string, chain string, x double, y double, z double, vdw_radii double, bfactor double, charge double"


def atoms(spark, n=40, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([("d", i, str(i // 4), "AB"[i % 2], *map(float, r.uniform(-8, 8, 3)), 1.7, float(i), float(r.normal())) for i in range(n)], ATOM)


def test_threshold_treats_nan_as_false_and_null_as_null(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (float("nan"),), (None,)], "v double")
    got = [tuple(r) for r in df.select(threshold(F.col("v"), ((">", 0.0),)), threshold(F.col("v"), (("!=", 0.0),))).collect()]
    assert got == [(1.0, 1.0), (0.0, 1.0), (0.0, 1.0), (None, None)]
    with pytest.raises(ValueError):
        threshold(F.col("v"), (("~", 0.0),))


def test_neighbours_equal_brute_force_with_negative_coordinates(spark):
    df = atoms(spark)
    p = {r.serial_number: np.array([r.x, r.y, r.z]) for r in df.collect()}
    want = {(a, b) for a in p for b in p if a < b and np.linalg.norm(p[a] - p[b]) <= 4.0}
    assert {(r.a, r.b) for r in spatial.atom_pairs(df, 4.0).collect()} == want


def test_lattice_equals_brute_force(spark):
    df = atoms(spark, 10)
    want = set()
    for r in df.collect():
        for v in np.ndindex(24, 24, 24):
            v = np.array(v) - 12
            if ((v - [r.x, r.y, r.z]) ** 2).sum() <= 1.7**2:
                want.add((r.serial_number, *v.tolist()))
    assert {(r.serial_number, r.vx, r.vy, r.vz) for r in spatial.lattice_points(df).collect()} == want


def test_voxels_have_no_negative_features(spark):
    assert voxel.voxelize(atoms(spark), ["charge"]).where("charge < 0").isEmpty()


def test_rotations_keep_distances(spark):
    df = atoms(spark, 12)
    turned = geometry.rotate_each(df, geometry.random_rotations(df.select("cath_domain").distinct(), 2))
    base = np.array([(r.x, r.y, r.z) for r in df.orderBy("serial_number").collect()])
    for k in (0, 1):
        new = np.array([(r.x, r.y, r.z) for r in turned.where(f"rotation = {k}").orderBy("serial_number").collect()])
        d = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
        assert np.allclose(d(base), d(new), atol=1e-3)


def test_principal_axes_are_a_rotation_and_order_variance(spark):
    df = atoms(spark, 30)
    m = geometry.principal_axes(df).first()
    m = np.array([[m[f"m{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(m.T @ m, np.eye(3), atol=1e-9)
    p = np.array([(r.x, r.y, r.z) for r in df.collect()])
    v = ((p - p.mean(0)) @ m).var(0)
    assert v[0] >= v[1] >= v[2]


def test_symmetry_text():
    m, t = geometry.symmetry("-Y,X+1/2,Z-0.25")
    assert m == [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]] and t == (0.0, 0.5, -0.25)


def test_dihedral_of_a_right_angle(spark):
    pts = [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 1.0)]
    got = spark.range(1).select(geometry.dihedral([[F.lit(c) for c in p] for p in pts])).first()[0]
    assert abs(abs(got) - 90) < 1e-9


def loop_split(sizes, share, groups, total):
    """The rule as a loop over a cut that moves."""
    f = lambda k: sum(sizes[:k]) / total
    lo, hi, k, m = share - 0.01, share + 0.01, int(groups * share), len(sizes)
    if lo <= f(k) <= hi:
        return min(k, m)
    if f(k) > hi:
        if k > m:
            return m
        while k > 0 and f(k) > hi:
            k -= 1
        return k if f(k) >= lo else k + 1
    while k <= m and f(k) < lo:
        k += 1
    if k > m:
        return m
    return k if f(k) <= hi else k - 1


def test_split_follows_the_loop_and_leaks_nothing(spark):
    r = np.random.default_rng(3)
    for case in range(4):
        sizes = [int(x) for x in r.integers(1, 12 if case else 2, 30)]
        df = spark.createDataFrame([(c, i) for c, n in enumerate(sizes) for i in range(n)], "s int, i int")
        got = {x.s: x.split for x in hierarchy.cluster_split(df, [], ["s"]).collect()}
        total, groups = sum(sizes), len(sizes)
        a = loop_split(sizes, 0.8, groups, total)
        b = a + loop_split(sizes[a:], 0.1, groups, total)
        assert [got[i] for i in range(30)] == ["train"] * a + ["validation"] * (b - a) + ["test"] * (30 - b)


def test_split_leaves_null_keys_out(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "s int")
    assert hierarchy.cluster_split(df, [], ["s"]).count() == 2
    with pytest.raises(ValueError):
        hierarchy.cluster_split(df, [], ["s"], {"train": 0.5})


def test_oversampling_fills_classes(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)], "k int, c int")
    n = {r.c: r["count"] for r in hierarchy.oversample(df, "c", "k").groupBy("c").count().collect()}
    assert n == {0: 40, 1: 40}


def test_records_round_trip_and_read(spark, tmp_path):
    line = "ATOM      7  CA AALA A  12B     -1.250   2.500  10.000  0.50 20.25      SEG1 C1+"
    path = tmp_path / "one.pdb"
    path.write_text("MODEL        1\n" + line + "\nENDMDL\n")
    d = structures.read_structures(spark, str(path))
    r = d.where("record = 'ATOM'").first()
    assert (r.serial, r.atom_name, r.altloc, r.resname, r.chain, r.resseq, r.icode, r.x, r.occ, r.element, r.charge) == (7, " CA ", "A", "ALA", "A", 12, "B", -1.25, 0.5, "C", "1+")
    assert d.where("record = 'ATOM'").select(structures.render(d)).first()[0] == line
    assert structures.list_structures(spark, str(tmp_path)).count() == 1
    structures.write_structures(records.strip(d).where(records.is_coord()), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_delocc_settles_residues_before_atoms(spark):
    rows = [("p", i, "ATOM", a, alt, res, 1, "A", " ") for i, (a, alt, res) in enumerate([("N", "A", "SER"), ("N", "B", "THR"), ("CA", "B", "THR"), ("CA", "A", "SER")])]
    df = spark.createDataFrame(rows, "path string, line_no long, record string, atom_name string, altloc string, resname string, resseq int, chain string, icode string")
    assert sorted((r.line_no, r.altloc) for r in records.delocc(df).collect()) == [(0, " "), (3, " ")]


def test_domain_description(spark, tmp_path):
    f = tmp_path / "d.txt"
    f.write_text("FORMAT    CDDF1.0\nDOMAIN    1abcA00\nCATHCODE  1.10.8.10\nCLASS     Mainly\nCLASS     Alpha\nDLENGTH   48\nSRANGE    START=1  STOP=20\nENDSEG\nSRANGE    START=25  STOP=50\nENDSEG\n//\n")
    got = [(r.cath_domain, r.cath_code, r["class"], r.dlength, r.nseg, r.srange_start, r.srange_stop) for r in structures.read_domain_description(spark, str(f)).orderBy("nseg").collect()]
    assert got == [("1abcA00", "1.10.8.10", "MainlyAlpha", 48, 1, "1", "20"), ("1abcA00", "1.10.8.10", "MainlyAlpha", 48, 2, "25", "50")]


def test_annotation_readers(spark):
    text = ["INFO  : 2 Clusters @ Threshold 0.8", "INFO  : Item Cluster", "INFO  : ---", "INFO  : 1 : 3 1abcA00", "INFO  : 2 : 4 2abcA00", "INFO  : =====", "INFO  : Centroids", "INFO  : Cluster Size", "INFO  : ---", "INFO  : 3 : 1 5 0.25 1abcA00", "INFO  : =====", "INFO  : 9 : 3 9abcA00", "DIST : 1 2 0.5"]
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text)], "path string, line_no long, line string")
    found = structures.read_cluster_log(lines).collect()
    assert [(r.item, r.cluster, r.structure, r.centroid_item, r.spread, r.centroid) for r in found] == [(1, 3, "1abcA00", 1, 0.25, "1abcA00")]
    assert {(r.a, r.b) for r in structures.read_distances(lines).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        structures.read_annotation(lines, "none")


def test_components_and_trees(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 20)], "k long")
    assert {r.k: r.cluster for r in clusters.components(edges, nodes, "k").collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 20: 20}
    tree = spark.createDataFrame([(0, -1, -1), (1, 0, -1), (2, 1, 0)], "node long, left long, right long")
    assert {r.node: r.n_leaves for r in trees.tree_sizes(tree).collect()} == {0: 2, 1: 3, 2: 5}


def test_smoothing_joins_short_runs(spark):
    text = "H" * 6 + "T" * 2 + "H" * 5 + "E" * 2 + "T" * 3
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate(text)], "d string, i long, ss string")
    got = [(r.value, r.length) for r in clusters.smooth_runs(df, "ss", "d", "i", residue="i").orderBy("segment").collect()]
    assert got == [("H", 13), ("X", 5)]


def test_empty_tables_give_empty_results(spark):
    none = atoms(spark).where("false")
    for df in (spatial.atom_pairs(none, 3.0), voxel.voxelize(none, ["charge"]), aggregates.residue_centres(none), geometry.extent(none), filters.validate_structures(none)):
        assert df.isEmpty()


def test_one_atom_and_identical_atoms(spark):
    df = spark.createDataFrame([("d", 1, "1", "A", 1.0, 1.0, 1.0, 1.7, 2.0, 0.1), ("d", 2, "1", "A", 1.0, 1.0, 1.0, 1.7, 2.0, 0.1)], ATOM)
    assert spatial.atom_pairs(df, 1.0).first().distance == 0.0
    assert aggregates.min_max(df, ["x"]).first().x == 0.0
    assert math.isclose(geometry.radius_of_gyration(df).first().rg, 0.0)


def test_incremental(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, incremental.apply_changes(cur, cur.where("k = 2").withColumn("v", F.lit("c")), "k").collect())) == [(1, "a"), (2, "c")]
    done = spark.createDataFrame([(1, True), (2, False)], "k int, done boolean")
    assert [r.k for r in incremental.pending(cur, done, "k").collect()] == [2]
    assert incremental.pending(cur, done, "k", force=1).count() == 2


def test_streamed_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name in ("a.pdb", "b.pdb"):
        (tmp_path / "in" / name).write_text("END\n")
        incremental.ingest(incremental.stream_structures(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda d, _: seen.append(d.count()))
    assert sum(seen) == 2


def test_models_of_a_group_are_joined_where_its_rows_are(spark, monkeypatch):
    """Rows are dealt by group once, not for the models, their first and the shared atoms each; and they equal brute force."""
    plans = []

    def written(df, name, f=records.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, name)

    monkeypatch.setattr(records, "written", written)
    rows = [(g, 10 * g + p, n, f"A{(n * (p + 1) + g) % 7}") for g in range(5) for p in range(3) for n in range(6)]
    d = spark.createDataFrame([(*r, "ATOM", "ALA", "A", None if r[2] == 5 else 1, " ", " ") for r in rows], "family long, path long, line_no long, atom_name string, record string, resname string, chain string, resseq int, icode string, altloc string")
    sets = {}
    for g, p, n, a in rows:
        sets.setdefault((g, p), set()).add((a, n == 5))
    want = {(g, p): (p % 10 + 1, len(sets[g, 10 * g] - s), len(s - sets[g, 10 * g])) for (g, p), s in sets.items()}
    for dealt in (False, True):
        got = records.join_models(d.repartition("family") if dealt else d, "family", dealt=dealt)
        assert {(r.family, r.path): (r.model, r.n_missing, r.n_extra) for r in got.collect()} == want
    assert [p.count("Exchange") for p in plans] == [1, 1]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Spark would take a task for each folder, once to look, once to plan a batch, and again for a run that finds nothing."""
    for k in range(60):
        (tmp_path / f"in/{k}").mkdir(parents=True)
        (tmp_path / f"in/{k}/a.pdb").write_text("END\n")
    tracker = spark.sparkContext.statusTracker()
    before, seen = max(tracker.getJobIdsForGroup(None), default=-1), []
    stream = incremental.stream_structures(spark, f"{tmp_path}/in/*")
    for _ in range(2):
        incremental.ingest(stream, str(tmp_path / "cp"), lambda d, _: seen.append(d.count()))
    assert structures.list_structures(spark, f"{tmp_path}/in").count() == 60 and sum(seen) == 60
    stages = [tracker.getStageInfo(s) for j in range(before + 1, before + 200) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
    assert stages and max(s.numTasks for s in stages if s) < 60
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 10_000


def test_features_used_and_predicted_must_differ(spark):
    with pytest.raises(ValueError):
        filters.select_features(atoms(spark), ["charge"], ["charge"])
    with pytest.raises(ValueError):
        filters.surface(atoms(spark))


def test_kmer_pairs_and_clusters_equal_brute_force(spark):
    base = [" ".join(f"w{b}x{i}" for i in range(24)) for b in range(3)]
    texts = [base[0], base[0], base[0].upper(), base[0] + " tail", base[1], base[1] + " a b c d e f g h", base[2], " ".join(base[2].split()[:16]), "a b", "A  b", "", None, base[0] + " tail", "q " * 9, "q " * 12]
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string")
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0.0

    def joined(links):
        own = {i: i for i in sets}
        for _ in sets:
            for a, b in links:
                own[a] = own[b] = min(own[a], own[b])
        return own

    want = {x: joined([(a, b) for a in sets for b in sets if a < b and score(a, b) >= x]) for x in (1.0, 0.95, 0.8, 0.6, 0.35)}
    pairs = clusters.kmer_pairs(df, "id", "t").collect()
    assert all(abs(p.score - score(p.a, p.b)) < 1e-9 for p in pairs) and joined([(p.a, p.b) for p in pairs]) == want[0.8]
    got = clusters.kmer_clusters(df, "id", "t").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, want[1.0][i], want[1.0][i], want[0.95][i], want[0.6][i], want[0.35][i]) for i in sets)
    assert len({str(w) for w in want.values()}) > 2


# --- rules that the tables' own rows don't reach ----------------------------------------------------------------------


def coordinates(spark, rows):
    return spark.createDataFrame([(*r, "ATOM", "ALA", "A", 1, " ", " ", "") for r in rows], "family long, path long, line_no long, atom_name string, record string, resname string, chain string, resseq int, icode string, altloc string, line string")


def test_models_with_double_atoms_are_told_apart(spark):
    d = coordinates(spark, [(1, 1, 1, "CA"), (1, 1, 2, "CA"), (1, 1, 3, "N"), (1, 2, 1, "CB"), (1, 2, 2, "CB"), (1, 2, 3, "N"), (2, 3, 1, "N"), (2, 4, 1, "N"), (2, 4, 2, "N")])
    got = {r.path: (r.model, r.n_missing, r.n_extra, r.same_atoms) for r in records.join_models(d, "family").collect()}
    assert got == {1: (1, 0, 0, True), 2: (2, 1, 1, False), 3: (1, 0, 0, True), 4: (2, 0, 0, True)}
    with pytest.raises(Exception, match="Different atoms in model 2"):
        records.join_models(d, "family", strict=True).collect()
    records.join_models(d.where("family = 2"), "family", strict=True).collect()


def plain_smooth(letters, least=3, one_helix=False):
    """Runs of (kind, residues), rewritten one after the other."""
    runs = []
    for k in letters:
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    new, seen = [k for k, _ in runs], False
    for i in range(1, len(runs) - 1):
        this, n = runs[i]
        before, after, out = new[i - 1], runs[i + 1][0], this
        if n < 4 and this != "X":
            out = "X"
        if n < 3 and before == after and not one_helix:
            out = before
        elif n < 3 and after == "X" and this != before:
            out = "X"
        if this == "H" and before == after == "E" and n < 5:
            out = "X"
        if n < (5 if one_helix else least):
            if before == after:
                out = before
            if (this, before, after) in (("H", "E", "E"), ("E", "H", "H")):
                out = "X"
        if this == "X" and (n > 10 or (one_helix and not seen and n > 5)):
            out, seen = "H", True
        new[i] = out
    out = []
    for (_, n), k in zip(runs, new):
        if out and out[-1][0] == k:
            out[-1][1] += n
        else:
            out.append([k, n])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("one_helix", [False, True])
def test_smoothing_follows_the_rules(spark, one_helix):
    r = random.Random(7)
    rows, want = [], {}
    for d in range(40):
        letters = "".join(r.choice("HEX") * r.choice([1, 1, 2, 3, 4, 5, 6, 9, 11, 12]) for _ in range(r.randrange(1, 14)))
        want[d] = plain_smooth(letters, one_helix=one_helix)
        at = 0
        for i, k in enumerate(letters):
            for _ in range(1 + i % 3):  # a residue has one to three atoms: lengths are residues
                rows.append((d, at, f"{i}", {"H": "G", "E": "B", "X": "T"}[k]))
                at += 1
    df = spark.createDataFrame(rows, "cath_domain long, serial_number long, residue_id string, ss string")
    got = {}
    for x in clusters.smooth_runs(df, "ss", "cath_domain", "serial_number", one_helix=one_helix).orderBy("segment").collect():
        got.setdefault(x.cath_domain, []).append(x.value)
    assert got == {d: [k for k, _ in w] for d, w in want.items()}


def test_half_spheres_by_both_neighbours(spark):
    """The second alpha carbon of a bent chain: its bisector points away from both neighbours."""
    rows = [(1, 1, "CA", -1.0, -1.0, 0.0), (1, 2, "CA", 0.0, 0.0, 0.0), (1, 3, "CA", 1.0, -1.0, 0.0), (1, 4, "CA", 0.0, 5.0, 0.0), (1, 5, "CA", 0.0, 12.0, 0.0), (1, 6, "N", 0.0, 1.0, 0.0)]
    got = {r.serial_number: (r.up, r.down) for r in clusters.half_sphere(spark.createDataFrame(rows, "cath_domain long, serial_number long, atom_name string, x double, y double, z double")).collect()}
    assert sorted(got) == [2, 3, 4] and got[2] == (1, 2)  # the fifth is exactly at the radius


def test_pair_energies_are_matched_by_both_residues(spark):
    edges = spark.createDataFrame([(1, "1", "2"), (1, "1", "3"), (2, "1", "2")], "cath_domain long, src string, dst string")
    pairs = spark.createDataFrame([(1, "1", "2", 0.1, 0.2, 0.3, -2.0, "highly", "short"), (1, "3", "1", 0.1, 0.2, 0.3, 1.0, "minimally", "long")], "cath_domain long, res1 string, res2 string, native_energy double, decoy_energy double, sd_energy double, frustration_index double, state string, well string")
    got = {(r.cath_domain, r.src, r.dst): r for r in clusters.annotate_edges(edges, pairs).collect()}
    one, other = got[1, "1", "2"], got[1, "1", "3"]
    assert (one.frustration_index, one.is_highly_frustrated, one.is_short_welltype, one.is_long_welltype) == (-2.0, True, True, False)
    assert other.frustration_index is None and not other.is_minimally_frustrated and not got[2, "1", "2"].is_highly_frustrated


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 5.0, 5.0, 1.0], [0.1 * k for k in range(101)], [7.0] * 50 + [1e9, -1e9]])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    assert aggregates.median_of(df, "v").first().median == pytest.approx(statistics.median(values), abs=1e-12)


def test_running_totals_by_ranges(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), k, r.randrange(9)) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, k long, n long")
    got = hierarchy.by_ranges(df, ["g"], ["k"], {"total": "n", "place": ""}).collect()
    sums, places = {}, {}
    want = set()
    for g, k, n in sorted(rows):
        sums[g], places[g] = sums.get(g, 0) + n, places.get(g, 0) + 1
        want.add((g, k, sums[g], places[g]))
    assert {(x.g, x.k, x.total, x.place) for x in got} == want


def test_samples_are_balanced(spark):
    df = spark.createDataFrame([(k, "a" if k < 300 else "b" if k < 320 else "c") for k in range(350)], "id long, label string")
    count = lambda d: {x.label: x["count"] for x in d.groupBy("label").count().collect()}
    assert count(hierarchy.balance(df, "label", "id")) == {"a": 20, "b": 20, "c": 20}
    more = hierarchy.oversample(df, "label", "id")
    assert count(more) == {"a": 300, "b": 300, "c": 300} and more.distinct().count() == 350


def test_ranges_meet_across_bins(spark):
    seg = spark.createDataFrame([(1, "A", 10, -70, 200), (1, "A", 11, 64, 64), (1, "A", 12, 300, 301)], "pdb long, chain string, cath_domain long, nstart long, nstop long")
    res = spark.createDataFrame([(1, "A", n) for n in (-71, -70, -64, 0, 63, 64, 65, 128, 200, 201, 300)] + [(2, "A", 5)], "pdb long, chain string, res long")
    got = {(x.res, x.cath_domain) for x in interact.residues_in_domains(res, seg).collect()}
    assert got == {(n, 10) for n in (-70, -64, 0, 63, 64, 65, 128, 200)} | {(64, 11), (300, 12)}
    assert {x.res for x in interact.loop_residues(res, seg).collect()} == {-71, 201}
    near = sorted((x.res, x.cath_domain, x.distance, x.rank) for x in interact.nearest_domains(res, seg, ["pdb", "chain", "res"]).collect())
    assert (128, 11, 64, 1) in near and (-71, 10, 1, 1) in near and (65, 11, 1, 1) in near and not any(r == 5 for r, *_ in near)
    best = {x.cath_domain: (x.o_cath_domain, x.overlap) for x in interact.best_overlap(seg, seg.where("cath_domain != 11")).collect()}
    assert best == {10: (10, 271), 11: (10, 1), 12: (12, 2)}


def test_nearest_domains_join_nothing(spark):
    """Against all ranges of the chain, with ends in one place, on both sides and at the residue; in a plan without joins."""
    r = random.Random(5)
    ranges = {(r.randrange(2), "A", r.randrange(6), start := r.randrange(40), start + r.randrange(8)) for _ in range(60)}
    asked = {(p, "A", n) for p in range(3) for n in range(-2, 50)}
    seg = spark.createDataFrame(sorted(ranges), "pdb long, chain string, cath_domain long, nstart long, nstop long")
    res = spark.createDataFrame(sorted(asked), "pdb long, chain string, res long")
    df = interact.nearest_domains(res, seg, ["pdb", "chain", "res"])
    want = set()
    for p, c, n in asked:
        far = sorted((min(abs(s - n), abs(n - e)), d, s, e) for q, _, d, s, e in ranges if q == p)
        want |= {(p, c, n, x[1], x[0], k + 1) for k, x in enumerate(far[:2]) if x[0] == far[0][0]}
    assert sorted((x.pdb, x.chain, x.res, x.cath_domain, x.distance, x.rank) for x in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "unboundedfollowing" not in plan.lower()
