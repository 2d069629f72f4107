"""Overlays, laid-out tables, dense blocks, folders as hierarchies, and user functions with any result."""

import os
import pickle
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helixlake.functions import featurizers
from helixlake.operators import hierarchy, overlay, spatial
from helixlake.operators.scratch import scratch_path
from helixlake.sources import dense, layout


def test_overlay(spark):
    r = random.Random(3)
    runs, fixes, want = [], [], []
    for s in range(12):
        at, own = 1, {}
        for _ in range(r.randrange(1, 9)):
            at += r.choice([0, 0, 2])
            stop = at + r.randrange(4)
            value = r.choice("HEX")
            runs.append((s, at, stop, value))
            own |= dict.fromkeys(range(at, stop + 1), value)
            at = stop + 1
        mine = [(s, nr, start := r.randrange(-3, 25), start + r.randrange(-1, 9), r.choice("HEX")) for nr in range(r.choice([0, 1, 4]))]
        r.shuffle(mine)
        fixes += mine
        for _, _, start, stop, value in sorted(mine, key=lambda x: x[1]):
            own |= dict.fromkeys(range(start, stop + 1), value)
        for p in sorted(own):
            if want and want[-1][0] == s and want[-1][2] == p - 1 and want[-1][3] == own[p]:
                want[-1][2] = p
            else:
                want.append([s, p, p, own[p]])
    a = spark.createDataFrame(runs, "d long, start long, stop long, value string")
    b = spark.createDataFrame(fixes, "d long, nr long, start long, stop long, value string")
    got = overlay.overlay(a, b, "d").orderBy("d", "segment").select("d", "start", "stop", "value")
    assert [list(x) for x in got.collect()] == want
    assert overlay.overlay(a.where("false"), b.where("false"), "d").collect() == []


def test_overlay_makes_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(s, at, at + 4, "HEX"[at % 3]) for s in range(3) for at in range(0, 40, 5)], "d long, start long, stop long, value string")
    fixes = spark.createDataFrame([(1, 1, 3, 12, "H"), (2, 1, -4, 2, "E")], "d long, nr long, start long, stop long, value string")
    overlay.overlay(rows.mapInArrow(count, rows.schema), fixes, "d").collect()
    assert made.value == 24


def rows_read(df):
    """Rows that the scans of a query let through."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())))


def test_one_domain_is_read_alone(spark):
    path = scratch_path(spark, "levels")
    codes = F.concat_ws(".", (F.col("id") % 3 + 1).cast("string"), (F.col("id") % 7).cast("string"), F.lit("10"))
    domains = spark.range(600).select(F.concat(F.lit("d"), F.md5(F.col("id").cast("string"))).alias("cath_domain"), codes.alias("cath_code"))
    atoms = domains.withColumn("serial", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("x", F.rand(3))
    layout.write_level(atoms, path, "atom", row_group=20_000, files=6)
    one = domains.orderBy("cath_domain").collect()[77]
    whole = layout.scan(spark, path, "atom")
    assert whole.count() == 60_000 and "class" not in whole.columns
    found = layout.scan(spark, path, "atom", domain=one.cath_domain)
    assert sorted(x.serial for x in found.collect()) == list(range(1, 101))
    # of sixty thousand rows, those of the row groups that may hold the domain
    assert rows_read(found.select("x")) <= 6_000
    both = layout.scan(spark, path, "atom", one.cath_code, one.cath_domain)
    assert both.count() == 100 and rows_read(both.select("x")) <= 3_000
    folder = dense.local_path(f"{path}/atom/class={one.cath_code[0]}")
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")]
    place = pq.ParquetFile(files[0]).schema_arrow.names.index("cath_domain")
    groups = [m.row_group(i).column(place) for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    spans = sorted((g.statistics.min, g.statistics.max) for g in groups)
    assert len(groups) > 3 and sum(lo <= one.cath_domain <= hi for lo, hi in spans) < len(groups)


def test_scan_by_code(spark):
    path = scratch_path(spark, "levels")
    df = spark.createDataFrame([("1.1", "a"), ("1.10", "b"), ("1.10.8", "c"), ("1.100", "d"), ("2.10", "e"), ("11.10", "f")], "cath_code string, cath_domain string")
    layout.write_level(df, path, "edge")
    names = lambda *a: sorted(x.cath_domain for x in layout.scan(spark, path, "edge", *a).collect())
    assert names("1.10") == ["b", "c"] and names("1") == ["a", "b", "c", "d"] and names("2", "e") == ["e"] and names("2", "a") == [] and names("9") == []
    layout.write_level(df.where("cath_domain = 'e'").withColumn("cath_domain", F.lit("g")), path, "edge")  # one class anew
    assert names() == ["a", "b", "c", "d", "f", "g"]
    with pytest.raises(ValueError):
        layout.scan(spark, path, "atoms")
    with pytest.raises(Exception, match="without cath_code"):
        layout.write_level(spark.createDataFrame([(None, "x")], "cath_code string, cath_domain string"), path, "edge")


def test_dense_round_trip(spark):
    r = random.Random(2)
    rows = []
    for k in range(7):
        places = sorted({tuple(r.randrange(-4, 6) for _ in range(3)) for _ in range(r.randrange(1, 30))})
        rows.append((f"s{k}", [list(p) for p in places], [[r.random(), 0.0] for _ in places]))
    rows.append(("zero", [[0, 0, 0]], [[0.0, 0.0]]))
    path = scratch_path(spark, "dense")
    df = spark.createDataFrame(rows, "cath_domain string, coords array<array<long>>, feats array<array<double>>").repartition(3)
    dense.write_dense(df, path)
    back = {x["name"]: (x.coords, x.feats) for x in dense.read_dense(spark, path).collect()}
    assert back == {n: (c, f) for n, c, f in rows}
    assert sorted(os.listdir(dense.local_path(path))) == sorted(f"{n}.npz" for n, _, _ in rows)


def test_dense_rows_become_matrices_without_lists(tmp_path):
    kind = pa.list_(pa.list_(pa.float64()))
    got = dense.nested(pa.array([[[1, 2, 3], [4, 5, 6]], [], None, [[7, 8, 9]]], kind).slice(0, 4))
    assert [m.tolist() for m in got] == [[[1, 2, 3], [4, 5, 6]], [], [], [[7, 8, 9]]]
    with pytest.raises(ValueError):
        dense.nested(pa.array([[[1], [2, 3, 4]]], kind))
    dense.pack(tmp_path / "a.npz", name=np.array("a"), grid=np.eye(3))
    with np.load(tmp_path / "a.npz") as z:
        assert str(z["name"]) == "a" and (z["grid"] == np.eye(3)).all()


def test_lost_attempts_leave_no_file(spark, tmp_path):
    """A job with a failing task leaves nothing; what an attempt wrote that was not committed goes."""
    bad = spark.createDataFrame([("a", [[0, 0, 0]], [[1.0]]), ("b", [[0, 0, 0], [1, 1, 1]], [[1.0]])], "cath_domain string, coords array<array<long>>, feats array<array<double>>").repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        dense.write_dense(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []
    writer = dense.DenseWriter(str(tmp_path))
    lost = os.path.join(writer.job, "0-lost")
    kept = os.path.join(writer.job, "0-kept")
    for folder in (lost, kept):
        os.makedirs(folder)
        with open(os.path.join(folder, "0.npz"), "wb") as f:
            f.write(b"x")
    writer.commit([dense.Written([(os.path.join(kept, "0.npz"), "s.npz")]), None])
    assert os.listdir(tmp_path) == ["s.npz"]


def test_empty_block():
    origin, grid, taken = dense.block(np.zeros((0, 3), np.int64), np.zeros((0, 2)))
    assert origin.tolist() == [0, 0, 0] and grid.shape == (0, 0, 0, 2) and taken.size == 0


def test_folders_of_any_depth(spark):
    paths = ["in/a/x.pdb", "in/a/b/y.pdb", "in/a/b/z.pdb", "in/a/b/z.pdb", "in/c/d/e/f/w.pdb", "in/top.pdb", "other/a/q.pdb", "in//a/v.pdb"]
    names = spark.createDataFrame([("a", "first"), ("zz", "none")], "cath_code string, description string")
    got = {x.cath_code: (x.level, x.parent_code, x.h5_key, x.n_files, x.n_below, x.description) for x in hierarchy.directory_nodes(spark.createDataFrame([(p,) for p in paths], "path string"), "in/", names).collect()}
    assert got == {
        "a": (1, None, "/a", 2, 4, "first"), "a.b": (2, "a", "/a/b", 2, 2, None), "c": (1, None, "/c", 0, 1, None), "c.d": (2, "c", "/c/d", 0, 1, None),
        "c.d.e": (3, "c.d", "/c/d/e", 0, 1, None), "c.d.e.f": (4, "c.d.e", "/c/d/e/f", 1, 1, None),
    }


def test_function_runs_once_a_key(spark, tmp_path):
    calls = str(tmp_path)

    def work(rows: pd.DataFrame):
        key = int(rows["k"].iloc[0])
        with open(f"{calls}/{key}", "a") as f:
            f.write("x")
        if key == 1:
            raise ValueError("bad\nkey")
        return {2: None, 3: {"a": 5, "b": "text"}, 4: pd.DataFrame({"b": ["p", None], "a": [1, 2], "more": [0, 0]}), 5: {"a": 1}, 6: 7}.get(key, {"a": None, "b": None})

    df = spark.createDataFrame([(k, v) for k in range(1, 8) for v in range(3)], "k long, v long")
    done = featurizers.map_groups(df, work, "k", "a long, b string", "test")
    good = sorted((x.k, x.a, x.b) for x in featurizers.results(done, "k").where("a is not null").collect())
    assert good == [(3, 5, "text"), (4, 1, "p"), (4, 2, None)]
    assert {x.k for x in featurizers.failures(done, "k").where("stage = 'test'").collect()} == {1, 5, 6}
    assert done.count() == 7 and all(open(f"{calls}/{k}").read() == "x" for k in range(1, 8))


def plain_pairs(points, radius):
    return sorted((g, a, b) for g, a, *p in points for h, b, *q in points if g == h and a < b and sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) ** 0.5 <= radius)


@pytest.mark.parametrize("radius", [0.7, 3.0, 50.0])
def test_boxes_and_half_shells(spark, radius):
    r = random.Random(7)
    points = [(g, k, *(r.uniform(-6, 6) if g else float(r.randrange(-2, 3)) for _ in range(3))) for g in range(3) for k in r.sample(range(1000), 45)]
    df = spark.createDataFrame(points, "cath_domain long, serial_number long, x double, y double, z double")
    got = spatial.atom_pairs(df, radius).collect()
    assert sorted((x.cath_domain, x.a, x.b) for x in got) == plain_pairs(points, radius)
    one, other = df.where("serial_number % 2 = 0"), df.where("serial_number % 2 = 1")
    both = spatial.neighbours(one, other, radius, ["cath_domain"], ordered=False)
    want = sorted((g, a, b) if not a % 2 else (g, b, a) for g, a, b in plain_pairs(points, radius) if (a + b) % 2)
    assert sorted((x.cath_domain, x.a_serial_number, x.b_serial_number) for x in both.collect()) == want
    # a group that fits in the radius is one cell, of which no copy is made
    if radius == 50.0:
        assert both.select("a_x").count() == len(want)


def test_text_files_are_those_of_sparks_writer_and_need_no_stream_each(spark, tmp_path, monkeypatch):
    from helixlake.sources import textfiles

    parts = ["A", "", None, "a/b", "x=1", "50%", "[q]", "é"]
    rows = [(k, p, n, f"{k}{p}{n}" if n else None) for k in (1, 2, 30) for p in parts for n in (2, 0, 1)]
    df = spark.createDataFrame(rows, "path long, part string, line_no long, value string")
    read = lambda at: sorted(map(str, spark.read.schema("value string, path long, part string").text(at).collect()))
    names = lambda at: sorted(str(f.parent.relative_to(at)) for f in at.rglob("*.txt"))
    for _ in range(2):  # the second time in place of the first
        textfiles.write_text_files(df, f"file://{tmp_path}/own", ["path", "part"], "line_no")
    assert not any(n.startswith("_job") for n in map(lambda f: f.name, (tmp_path / "own").iterdir()))
    monkeypatch.setattr(textfiles, "is_mounted", lambda *_: False)
    textfiles.write_text_files(df, f"file://{tmp_path}/sparks", ["path", "part"], "line_no")
    assert read(f"{tmp_path}/own") == read(f"{tmp_path}/sparks") and names(tmp_path / "own") == names(tmp_path / "sparks")
    assert (tmp_path / "own/path=1/part=A/lines.txt").read_text() == "\n1A1\n1A2\n"
    monkeypatch.undo()
    assert not textfiles.is_mounted(spark, "s3a://store/at") and textfiles.is_mounted(spark, f"{tmp_path}")


def test_the_driver_hears_of_no_file(spark, tmp_path, monkeypatch):
    """What a task reports doesn't grow with its files, and reading them back lists none in the driver."""
    from helixlake.sources import textfiles

    sizes = []
    monkeypatch.setattr(textfiles, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    for n in (1, 300):
        writer = textfiles.TextWriter(str(tmp_path / f"{n}"), ["path"], [], True)
        message = writer.write(iter([pa.RecordBatch.from_pydict({"path": list(range(n)), "value": ["x"] * n})]))
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        assert sorted(f.name for f in (tmp_path / f"{n}").iterdir()) == sorted(f"path={k}" for k in range(n))
    assert sizes[1] <= sizes[0] + 4
    monkeypatch.setattr(textfiles, "HELD", 3)
    long = textfiles.TextWriter(str(tmp_path / "long"), ["path"], [], True)
    long.commit([long.write(iter([pa.RecordBatch.from_pydict({"path": [7] * 10, "value": list("abcdefghij")})]))])
    assert (tmp_path / "long/path=7/lines.txt").read_text().split() == list("abcdefghij")
    monkeypatch.undo()
    back = textfiles.read_text_files(spark, f"file://{tmp_path}/300", ["path"])
    assert back.count() == 300 and not back.inputFiles()


def test_splits_come_in_one_pass_and_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    from helixlake.sources import structures, textfiles

    parts = ["A", "", None, "a/b", "50%", "é", " B"]
    rows = [(k, p, str(n % 2), n, f"{k}{p}{n}\r{n}" if n else None) for k in range(40) for n, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "path long, chain string, model string, line_no long, line string")
    read = lambda at: sorted(map(str, structures.read_split_structures(spark, at).select("by", "path", "part", "value").collect()))
    names = lambda at: sorted(str(f.parent.relative_to(at)) for f in at.rglob("*.txt"))
    for _ in range(2):  # the second time in place of the first
        structures.split_structures(df, f"file://{tmp_path}/own", ("chain", "model"))
    own = read(f"file://{tmp_path}/own")
    monkeypatch.setattr(textfiles, "is_mounted", lambda *_: False)
    structures.split_structures(df, f"file://{tmp_path}/sparks", ("chain", "model"))
    assert own == read(f"file://{tmp_path}/sparks") and names(tmp_path / "own") == names(tmp_path / "sparks")
    assert (tmp_path / "own/by=model/path=1/part=0/lines.txt").read_bytes() == "\n1None2\r2\n150%4\r4\n1 B6\r6\n".encode()
