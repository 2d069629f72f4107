"""Clusters, links, trees and ranks that scale: against plain versions."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import aggregates, clusters, greedy, linkage, trees


def texts(seed=4):
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(n))
    shared = words(60)
    out = []
    for _ in range(12):
        base = words(r.randrange(20, 80)) if r.random() < 0.6 else shared
        for _ in range(r.randrange(1, 6)):
            w = base.split()
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = words(1)
            out.append(" ".join(w[: r.randrange(len(w) // 2, len(w) + 1)]))
    return [*out, out[0], out[3], out[3], "", None, " ", "one two", "one two"]


def kmers(text, k=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_greedy(rows, level, k=5):
    """One pass by rank over the classes of equal sets, with the links to the longest class of each k-mer."""
    sets = {i: kmers(t, k) for i, t in rows}
    classes = {}
    for i, s in sets.items():
        if s:
            classes[s] = min(classes.get(s, i), i)
    rank = sorted(classes, key=lambda s: (-len(s), classes[s]))
    tops = {}
    for s in rank:
        for g in s:
            tops.setdefault(g, s)
    head = {}
    for s in rank:
        near = {tops[g] for g in s} - {s}
        near = [c for c in rank if c in near and len(s & c) / len(s | c) >= level and head[c] == c]
        head[s] = near[0] if near else s
    return {i: classes[head[s]] if s else i for i, s in sets.items()}


def test_greedy_representatives(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (None, "no key")], "id long, text string")
    got = {r.id: r for r in greedy.greedy_representatives(df, "id", "text").collect()}
    assert len(got) == len(rows)
    merged = 0
    for level in greedy.LEVELS:
        want = plain_greedy(rows, level)
        assert {i: r[f"representative_{round(100 * level)}"] for i, r in got.items()} == want
        merged += sum(i != x for i, x in want.items())
    assert merged > 30
    assert greedy.greedy_representatives(df.where("false"), "id", "text").collect() == []


def test_links_of_a_frequent_kmer_are_linear(spark):
    """A passage that all share gives each of them one link, not one with every other."""
    n = 400
    rows = [(i, "the same five words here " + " ".join(f"w{i}x{j}" for j in range(5))) for i in range(n)]
    _, one = clusters.kmer_classes(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert greedy.centre_links(one, "id", 0.05).count() <= n


def test_settling_rounds_follow_links_only(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (7, 6)], "member long, centre long")
    nodes = spark.range(1, 9).withColumnRenamed("id", "node")
    got = {r.node: r.is_representative for r in greedy.settle(links, nodes).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: False, 8: True}


def test_frequent_kmers_are_joined_in_blocks(spark, monkeypatch):
    rows = list(enumerate(texts(9)))
    df = spark.createDataFrame(rows, "id long, text string")
    whole = sorted(map(tuple, clusters.kmer_pairs(df, "id", "text", least=0.4).collect()))
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, clusters.kmer_pairs(df, "id", "text", least=0.4).collect())) == whole and whole


def vectors(n, groups, spread, seed=1, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    return [(i, i % 2, (centres[i % groups] + spread * r.normal(size=d)).tolist()) for i in range(n)]


def plain_clusters(rows, least):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v and any(v)}
    label = {i: i for i, _, _ in rows}
    group = {i: g for i, g, _ in rows}
    keys = list(unit)
    for _ in range(len(keys)):
        moved = False
        for a in keys:
            for b in keys:
                if group[a] == group[b] and label[a] < label[b] and unit[a] @ unit[b] >= least:
                    label[b], moved = label[a], True
        if not moved:
            break
    return label


@pytest.mark.parametrize("spread", [0.05, 0.3, 1.0])
def test_single_linkage_by_pivots(spark, spread):
    rows = [*vectors(90, 9, spread), (900, 0, None), (901, 0, [0.0] * 16), (902, 1, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, family long, v array<double>")
    want = plain_clusters(rows, 0.9)
    for pivots in (None, linkage.pivots_of(df.where("id < 900"), "id", "v", 12, 5), np.zeros((0, 16))):
        got = linkage.single_linkage(df, "id", "family", "v", 0.9, pivots)
        assert {r.id: r.cluster for r in got.collect()} == want


def test_pairs_looked_at_on_clustered_vectors(spark):
    rows = vectors(600, 60, 0.02)
    df = spark.createDataFrame([(i, 0, v) for i, _, v in rows], "id long, family long, v array<double>")
    pivots = linkage.pivots_of(df, "id", "v", 64, 5)
    dealt = linkage.deal(df, "id", "family", "v", 0.9, pivots)
    looked = linkage.work(dealt, "family").agg(F.sum("pairs")).first()[0]
    assert looked < 0.1 * 600 * 599 / 2
    pairs = {(r.a, r.b) for r in linkage.close_pairs(dealt, "id", "family", 0.9, block_rows=7).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    assert pairs == {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9}


def test_central_members_need_no_pairs(spark):
    rows = [*vectors(40, 3, 0.5), (100, 7, [1.0] * 16), (101, 0, None)]
    df = spark.createDataFrame(rows, "id long, family long, v array<double>")
    got = {r.family: (r.centroid, r.distance, r.n) for r in linkage.central_members(df, "id", "family", "v").collect()}
    want = {}
    for g in (0, 1):
        unit = {i: np.array(v) / np.linalg.norm(v) for i, f, v in rows if f == g and v}
        mean = {i: round(float(np.mean([1 - u @ w for j, w in unit.items() if j != i])), 6) for i, u in unit.items()}
        best = min(mean, key=lambda i: (mean[i], i))
        want[g] = (best, mean[best], len(unit))
    assert got == want


def test_deep_tree_takes_few_rounds(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).otherwise(-1).alias("left"), F.lit(-2).cast("long").alias("right"))
    sums, rounds = trees.rank_list(trees.tour(chain))
    assert rounds <= 20
    assert trees.tree_sizes(chain).where("n_leaves <> node + 2").count() == 0 and sums.count() == 3 * n


def test_forest_sizes(spark):
    r = random.Random(2)
    edges, open_, node = [], list(range(-30, 0)), 0
    below = {x: 1 for x in open_}
    while len(open_) > 3:
        a, b = (open_.pop(r.randrange(len(open_))) for _ in range(2))
        edges.append((node, a, b))
        below[node] = below[a] + below[b]
        open_.append(node)
        node += 1
    got = {x.node: x.n_leaves for x in trees.tree_sizes(spark.createDataFrame(edges, "node long, left long, right long")).collect()}
    assert got == {n: below[n] for n, _, _ in edges}
    assert trees.tree_sizes(spark.createDataFrame([], "node long, left long, right long")).collect() == []


def test_selection_does_not_rest_on_the_spread(spark):
    r = random.Random(5)
    values = [r.choice([r.random(), -r.random(), r.random() * 1e-300, float(r.randrange(3))]) for _ in range(3001)] + [1e300, -1e300, 0.0, -0.0, math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    ordered = sorted(values)
    ranks = [0, 1, 17, len(values) // 2, len(values) - 1]
    assert aggregates.value_at(df, "v", ranks) == {k: ordered[k] for k in ranks}
    assert aggregates.median_of(df, "v").first().median == statistics.median(values)
    assert aggregates.median_of(df.where("false"), "v").first().median is None


def test_vectors_without_structure_are_not_copied_to_all_cells(spark):
    r = np.random.default_rng(8)
    rows = [(i, i % 2, [float(x) for x in r.normal(size=16)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, family long, v array<double>")
    pivots = linkage.pivots_of(df, "id", "v", 30, 5)
    dealt = linkage.deal(df, "id", "family", "v", 0.5, pivots)
    assert dealt.count() == 300  # before: one row for most of the 30 cells
    pairs = {(x.a, x.b) for x in linkage.close_pairs(dealt, "id", "family", 0.5, 0.2, block_rows=40).collect()}
    unit = {i: (g, np.array(v) / np.linalg.norm(v)) for i, g, v in rows}
    assert pairs == {(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.5}


def test_pairs_are_products_of_blocks_and_need_no_second_shuffle(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, 0, None), (61, 0, [0.0] * 4), (62, 0, [1.0, 2.0]), (63, 0, [2.0, None, 1.0, 1.0]), (64, None, [1.0] * 4), (None, 0, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, g int, embedding array<double>")
    scores = clusters.pair_scores(df, "id", "g", block_rows=7)
    got = {(r.g, r.a, r.b): r.score for r in scores.collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, v in rows[:60]}
    ids = [(i, g) for i, g, _ in rows if i is not None and g is not None]
    assert set(got) == {(g, i, j) for i, g in ids for j, h in ids if g == h and i < j} and len(got) == scores.count()
    for (_, i, j), s in got.items():
        want = sum(x * y for x, y in zip(unit[i], unit[j], strict=True)) if j < 60 else None
        assert s is None if want is None else abs(s - want) < 1e-12
    plain = sorted(map(str, clusters.score_matrix(scores).collect()))
    matrix = clusters.score_matrix(scores, once=True)
    assert len(plain) == 2 * len(got) and sorted(map(str, matrix.select("a", "b", "score").collect())) == plain
    assert "avg(" not in matrix._jdf.queryExecution().executedPlan().toString()


def test_vectors_go_to_so_many_tasks_whatever_the_size_of_their_group(spark, monkeypatch):
    df = lambda n: spark.range(n).selectExpr("id", "1 as g", "array(1d, double(id), 3d) as embedding")
    copies = lambda n: clusters.deal_pairs(df(n), "id", "g", block_rows=10).count() / n
    assert copies(5) == 2 and copies(100) == copies(400) == clusters.PAIR_BLOCKS + 1  # before: 11 and 41
    pairs = clusters.pair_scores(df(400), "id", "g", block_rows=10)
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 400 * 399 // 2 and pairs.where("a >= b or score is null").isEmpty()
    monkeypatch.setattr(clusters, "BLOCK_BYTES", 24 * 20)  # no block of more than about so much
    assert copies(400) == 21
    named = spark.createDataFrame([(x, "f", [1.0, float(i)]) for i, x in enumerate("zyxab")], "id string, g string, embedding array<float>")
    assert {(r.g, r.a, r.b) for r in clusters.pair_scores(named, "id", "g").collect()} == {("f", a, b) for a in "abxyz" for b in "abxyz" if a < b}


@pytest.mark.parametrize("run", [greedy.greedy_representatives, clusters.kmer_clusters, clusters.kmer_pairs])
def test_only_shared_kmers_are_carried(spark, monkeypatch, run):
    """Sets are written once, and of the k-mers only those that two classes have."""
    kept = []

    def written(df, name, f=clusters.written):
        kept.append((name, f(df, name)))
        return kept[-1][1]

    monkeypatch.setattr(clusters, "written", written)
    rows = [(i, " ".join(f"w{i // 2}x{j if j < 20 else (i, j)}" for j in range(30))) for i in range(10)]
    run(spark.createDataFrame([*rows, (10, rows[0][1]), (10, rows[0][1])], "id long, text string"), "id", "text").collect()
    assert [n for n, _ in kept].count("kmers") == 1
    tables = [df.count() for _, df in kept if "g" in df.columns and df.schema["g"].dataType.typeName() == "long"]
    assert tables == [10 * 16]


def test_both_places_of_a_pair_are_made_without_an_array_for_each(spark):
    scores = spark.createDataFrame([("x", "y", 0.5), ("x", "z", None)], "a string, b string, score double")
    matrix = clusters.score_matrix(scores, once=True)
    assert {tuple(r) for r in matrix.collect()} == {("x", "y", 0.5), ("y", "x", 0.5), ("x", "z", None), ("z", "x", None)}
    assert "struct" not in matrix._jdf.queryExecution().executedPlan().toString()
