"""Further forms of operators: shares, chains, lookups, gates, pairs, progress and ordered samples."""

import math

import pytest
from pyspark.sql import functions as F

from helixlake.operators import aggregates, filters, hierarchy, interact, records

LINE = "path long, line_no long, record string, serial int, atom_name string, altloc string, resname string, chain string, resseq int, icode string, x double"


def lines(spark, rows):
    return spark.createDataFrame([(1, k, rec, k, f" {name:<3}", " ", "ALA", chain, n, icode, 0.0) for k, (rec, name, chain, n, icode) in enumerate(rows)], LINE)


def test_named_shares():
    assert hierarchy.named_shares(0.7) == hierarchy.named_shares([0.7]) == {"train": 0.7, "validation": pytest.approx(0.15), "test": pytest.approx(0.15)}
    assert hierarchy.named_shares([0.5, 0.5]) == {"split0": 0.5, "split1": 0.5} and hierarchy.named_shares({"a": 1.0}) == {"a": 1.0}
    for bad in (0, 1, 1.5, []):
        with pytest.raises(ValueError):
            hierarchy.named_shares(bad)


def test_split_by_one_number(spark):
    df = spark.range(100).select(F.lit(1).alias("c"), "id")
    got = {r.split: r["count"] for r in hierarchy.cluster_split(df, ["c"], ["id"], 0.6).groupBy("split").count().collect()}
    assert sum(got.values()) == 100 and abs(got["train"] - 60) <= 2 and abs(got["validation"] - 20) <= 2
    with pytest.raises(ValueError):
        hierarchy.cluster_split(df, ["c"], ["id"], [0.5, 0.2])


def test_chain_representatives(spark):
    chains = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C"), (3, "A")], "pdb long, chain string")
    entities = spark.createDataFrame([(1, "A", 1), (1, "B", 1), (2, "A", 1), (2, "C", 2)], "pdb long, chain string, entity long")
    clusters = spark.createDataFrame([(1, 1, 7, 5), (2, 1, 7, 3)], "pdb long, entity long, cluster long, rank long")
    got = {(r.pdb, r.chain): (r.cluster, r.representative_pdb, r.representative_chain, r.is_representative) for r in hierarchy.chain_representatives(chains, entities, clusters).collect()}
    assert got == {(1, "A"): (7, 2, "A", False), (1, "B"): (7, 2, "A", False), (2, "A"): (7, 2, "A", True), (2, "C"): (None, None, None, False), (3, "A"): (None, None, None, False)}


def test_truth_from_stored_list(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "10"), ("a", "10A"), ("b", "1"), ("c", "")], "cath_domain string, residue_id string")
    stored = spark.createDataFrame([("a", "10A, 1"), ("a", "7"), ("b", None), ("c", ",")], "cath_domain string, residues string")
    assert [r.truth for r in hierarchy.truth_from_list(rows, stored).orderBy("cath_domain", "residue_id").collect()] == [True, False, True, False, False]


def test_natural_keys(spark):
    df = spark.createDataFrame([("22A",), ("A 22",), ("-5",), ("x  y 1.5  z",), (".5b",), ("none",), ("1-2",), (None,)], "t string")
    got = {r.t: None if r.k is None else tuple(r.k) for r in df.select("t", hierarchy.natural_key("t").alias("k")).collect()}
    assert got == {"22A": ("", 22.0, "A"), "A 22": ("A", 22.0, ""), "-5": ("", 5.0, ""), "x  y 1.5  z": ("x y", 1.5, "z"), ".5b": ("", 0.5, "b"), "none": None, "1-2": None, None: None}


def test_residue_lookup(spark):
    d = lines(spark, [("HETATM", "O", "A", 5, " "), ("ATOM", "N", "A", 5, "B"), ("ATOM", "N", "A", 5, " "), ("ATOM", "CA", "A", 5, " "), ("ATOM", "N", "A", 6, "C"), ("ATOM", "CA", "A", 6, "D"), ("HETATM", "O", "A", 7, " "), ("TER", "", "A", 5, " ")])
    at = lambda label: [r.serial for r in filters.residue_of(d, label).orderBy("serial").collect()]
    assert at(5) == [2, 3] and at(6) == [4] and at(7) == [6] and at(8) == []
    assert at("5") == [2, 3] and at("5B") == [1] and at("6") == [] and at("x") == []
    assert at((" ", 6, "D")) == [5] and at(("H_O", 5, " ")) == [0]
    assert filters.residue_of(d, 5).columns == d.columns


def test_file_gate(spark):
    import gzip

    line = lambda c: f"{'ATOM':<6}{1:>5}  CA  ALA {c}   1"
    rows = [("one", "\n".join(line("A") for _ in range(3)).encode()), ("two", (line("A") + "\r\n" + line("B")).encode()), ("zip", gzip.compress(line("A").encode())), ("none", b""), ("null", None), ("text", b"no lines")]
    got = {r.path: tuple(r)[1:] for r in filters.validate_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"one": (False, False, 1, True), "two": (False, False, 2, False), "zip": (False, True, 0, False), "none": (True, False, 0, False), "null": (True, False, 0, False), "text": (False, False, 0, False)}


def test_prepare_records_its_steps(spark):
    d = lines(spark, [("ATOM", "N", " ", 1, " "), ("ATOM", "CA", " ", 1, " "), ("ATOM", "N", " ", 2, " "), ("HETATM", "O", " ", 2, " "), ("ATOM", "N", " ", 4, " "), ("ATOM", "N", "B", 4, " ")])
    d = d.withColumns({"occ": F.lit(1.0), "b": F.lit(1.0), "y": F.lit(0.0), "z": F.lit(0.0), "segid": F.lit(""), "element": F.lit("N"), "charge": F.lit(""), "line": F.lit("")})
    out = records.prepare(d, "A", slices=[(1, 2)], rename="Z", steps=True).where("record = 'ATOM'").orderBy("line_no").collect()
    assert [(r.line_no, r.chain) for r in out] == [(0, "Z"), (1, "Z"), (2, "Z")]
    assert out[0].prep_steps == ["model 1", "chain A", "delocc", "striphet", "slices 1-2", "tidy", "rename Z"]
    assert "prep_steps" not in records.prepare(d, "A").columns


def test_first_of_pairs(spark):
    df = spark.createDataFrame([(2, 1, 9), (1, 2, 5), (None, 3, 1), (3, None, 2), (4, 4, 7)], "a long, b long, n long")
    assert sorted(r.n for r in interact.first_of_pairs(df, "a", "b", ["n"]).collect()) == [1, 5, 7]


def test_class_counts_and_faces(spark):
    df = spark.createDataFrame([("o", "x")] * 3 + [("o", "y")] + [("i", "x")], "status string, cls string")
    assert {(r.status, r.cls): (r.n, r.share) for r in interact.class_counts(df, "cls", "status").collect()} == {("o", "x"): (3, 0.75), ("o", "y"): (1, 0.25), ("i", "x"): (1, 1.0)}
    kind = "pdb string, first_res long, second_res long"
    model, reference = spark.createDataFrame([("p", 1, 7), ("p", 2, 7), ("q", 1, 1)], kind), spark.createDataFrame([("p", 2, 8), ("p", 3, 7), ("r", None, 1)], kind)
    got = {r.pdb: (r.face1, r.face2) for r in interact.face_jaccard(model, reference, "pdb").collect()}
    assert got == {"p": (pytest.approx(1 / 3), 0.5), "q": (0.0, 0.0), "r": (None, 0.0)}


def test_progress_and_wide_pairs(spark):
    expected = spark.createDataFrame([("p", 2), ("q", 1), ("r", 0)], "pdb string, num_interfaces long")
    part = lambda *x: spark.createDataFrame(x, "pdb string, interface_id long")
    got = {r.pdb: (r.n_a, r.n_b, r.a_done, r.done) for r in aggregates.interface_progress(expected, {"a": part(("p", 1), ("p", 1), ("p", 2), ("q", 1)), "b": part(("p", 1), ("q", 1))}).collect()}
    assert got == {"p": (2, 1, True, False), "q": (1, 1, True, True), "r": (0, 0, True, True)}
    df = spark.createDataFrame([("p", "m", "x", 1.0), ("p", "m", "y", 2.0), ("p", "n", "x", 3.0)], "pdb string, moving string, ref string, v double")
    rows = {(r.pdb, r.moving): (r.x_v, r.y_v) for r in aggregates.wide_pairs(df, ["pdb", "moving"], "ref", ["v"], ["x", "y"]).collect()}
    assert rows == {("p", "m"): (1.0, 2.0), ("p", "n"): (3.0, None)}


def test_ordered_samples(spark):
    rows = [("d", 1, "9", "ALA", "N", 1.0), ("d", 2, "9", "ALA", "CA", 2.0), ("d", 3, "10", "GLY", "CA", 4.0), ("d", 4, "10A", "TRP", "CB", 8.0)]
    df = spark.createDataFrame([(*x, 0.0, 0.0, x[-1]) for x in rows], "cath_domain string, serial_number long, residue_id string, residue_name string, atom_name string, x double, y double, z double, bfactor double")
    one = aggregates.ordered_samples(df, ["bfactor"]).first()
    assert one.residues == ["9", "10", "10A"] and one.sequence == "AGW" and one.features == [[1.5], [4.0], [None]]
    assert one.coordinates[1][1] == [4.0, 0.0, 0.0] and all(math.isnan(v) for atom in one.coordinates[2] for v in atom)
    other = aggregates.ordered_samples(df, ["bfactor"], order="lexical").first()
    assert other.residues == ["10", "10A", "9"] and other.sequence == "AGW" and other.features[2] == [1.5]
    with pytest.raises(ValueError):
        aggregates.ordered_samples(df, ["bfactor"], order="random")


def test_datasets_and_keys(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string"), spark.createDataFrame([(2, 5), (None, 6)], "k long, w long")
    rows = {(r.part, r.k, r.v, r.w) for r in hierarchy.concatenate({"a": a, "b": b}).collect()}
    assert rows == {("a", 1, "x", None), ("a", 2, None, None), ("b", 2, None, 5), ("b", None, None, 6)}
    assert [r.k for r in hierarchy.common_keys(a, b, "k").collect()] == [2]
    one = hierarchy.same_keys(a, b, ["k"]).first()
    assert (one.only_left, one.only_right, one.same) == (1, 1, False) and hierarchy.same_keys(b, b.unionAll(b), ["k"]).first().same
    assert [r.k for r in hierarchy.search_union(a, [F.col("v") == "x", F.col("k") == 1], "k").collect()] == [1]
    assert hierarchy.drop_negatives(a, F.col("v") == "x").count() == 1
    with pytest.raises(ValueError):
        hierarchy.concatenate({})


def test_sites_and_neighbours(spark):
    c = spark.createDataFrame([("p", 1, 2), ("p", 1, 3), ("p", 3, 1)], "pdb string, first_res long, second_res long")
    assert {r.res: r.neighbours for r in interact.neighbour_lists(c).collect()} == {1: [2, 3], 2: [1], 3: [1]}
    listed = spark.createDataFrame([("p", "1,2,", "7"), ("p", "2, 3", None), ("q", "", "")], "pdb string, first_res string, second_res string")
    assert {r.pdb: (r.n_first, r.n_second) for r in interact.distinct_residues(listed.withColumn("first_res", F.replace("first_res", F.lit(" "), F.lit(""))), separator=",").collect()} == {"p": (3, 1), "q": (0, 0)}
    kinds = spark.createDataFrame([("bio", 1), ("bio", -1), ("xtal", 3)], "kind string, region long")
    assert interact.bio_interfaces(kinds, "kind").count() == 2 and interact.bio_interfaces(kinds, "kind", region="region").count() == 1


@pytest.mark.parametrize("name", ["PF15b_residue_of", "TR25_harmonize", "TR26_join_models"])
def test_records_are_parsed_once(name, spark):
    from helixlake.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan  # what is left reads the records written
