"""Trees in logarithmic rounds, however deep they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


#: A list of 2 ** ROUNDS places has no end.
ROUNDS = 48


def tour(edges: DataFrame) -> DataFrame:
    """The Euler tour of merge trees (node, left, right; negative children are leaves) as a linked list: (at, next, leaves).

    A node has three places: 0 on the way in, 1 between its children, 2 on the way out. A leaf is passed on the step behind
    the place before it and counts there. A child that has no row of its own is passed without counting."""
    place = lambda node, k: F.col(node) * 3 + k
    nodes = edges.select(F.col("node").cast("long").alias("node"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    known = nodes.select(F.col("node").alias("kid"))
    kids = nodes.select("node", F.posexplode(F.array("left", "right")).alias("side", "kid"))
    inner = kids.where("kid >= 0").join(known, "kid", "left_semi")
    down = kids.join(inner.select("node", "side", F.lit(True).alias("inner")), ["node", "side"], "left")
    steps = down.select((F.col("node") * 3 + F.col("side")).alias("at"), F.when(F.col("inner"), place("kid", 0)).otherwise(F.col("node") * 3 + F.col("side") + 1).alias("next"), F.when(F.col("kid") < 0, 1).otherwise(0).cast("long").alias("leaves"))
    up = nodes.join(inner.select(F.col("kid").alias("node"), F.col("node").alias("parent"), "side"), "node", "left")
    return steps.unionByName(up.select(place("node", 2).alias("at"), (F.col("parent") * 3 + F.col("side") + 1).alias("next"), F.lit(0).cast("long").alias("leaves")))


def rank_list(steps: DataFrame, value: str = "leaves") -> tuple[DataFrame, int]:
    """For each place of linked lists (at, next) the sum of ``value`` from it to the end of its list, by pointer doubling, and
    the number of rounds: the logarithm of the longest list. A place is next to one other at most, so no join is skewed."""
    rows, rounds = written(steps.select("at", "next", value), "list"), 0
    while not rows.where("next is not null").isEmpty():
        ahead = rows.select(F.col("at").alias("next"), F.col("next").alias("beyond"), F.col(value).alias("more"))
        doubled = rows.where("next is not null").join(ahead, "next").select("at", F.col("beyond").alias("next"), (F.col(value) + F.col("more")).alias(value))
        rows, rounds = written(doubled.unionByName(rows.where("next is null")), "list"), rounds + 1
        if rounds > ROUNDS:
            raise ValueError("a list runs in a circle")
    return rows.select("at", value), rounds


def tree_sizes(edges: DataFrame) -> DataFrame:
    """Leaves below each node of merge trees: what the tour passes between the way in and the way out. Where a node has several
    parents it counts for each, and sums go up a level a round instead."""
    shared = edges.select(F.explode(F.array("left", "right")).alias("kid")).where("kid >= 0").groupBy("kid").count().where("count > 1")
    if not shared.isEmpty():
        return _by_levels(edges)
    sums, _ = rank_list(tour(edges))
    node = F.expr("at div 3").alias("node")
    return sums.where("at % 3 <> 1").groupBy(node).agg(F.sum(F.when(F.col("at") % 3 == 0, F.col("leaves")).otherwise(-F.col("leaves"))).alias("n_leaves"))


def _by_levels(edges: DataFrame) -> DataFrame:
    kids = edges.select("node", F.explode(F.array("left", "right")).alias("kid"))
    done = kids.where("kid < 0").groupBy("node").agg(F.count("*").alias("own"))
    inner = written(kids.where("kid >= 0"), "tree")
    own = F.coalesce("own", F.lit(0))
    size = written(edges.select("node").join(done, "node", "left").select("node", own.alias("n"), own.alias("front")), "tree")
    while True:
        up = inner.join(size.select(F.col("node").alias("kid"), "front"), "kid").groupBy("node").agg(F.sum("front").alias("add"))
        if up.where("add > 0").isEmpty():
            return size.select("node", F.col("n").alias("n_leaves"))
        more = F.coalesce("add", F.lit(0))
        size = written(size.join(up, "node", "left").select("node", (F.col("n") + more).alias("n"), more.alias("front")), "tree")
