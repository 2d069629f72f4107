"""Connected components by joins: smallest label of the neighbours, then pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) for each node of ``edges`` (a, b). Every round is a written table."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "m").alias("next"))
        jump = labels.select(F.col("node").alias("j"), F.col("comp").alias("jc"))
        moved = hooked.join(jump, hooked["next"] == jump["j"]).select("node", F.least("next", "jc").alias("comp"), (F.least("next", "jc") != F.col("comp")).alias("changed"))
        moved = materialize(moved, "labels")
        labels = moved.select("node", "comp")
        if moved.where("changed").isEmpty():
            return labels
