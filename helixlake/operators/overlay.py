"""Corrections of segments: ranges laid over runs, later ones winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def overlay(runs: DataFrame, corrections: DataFrame, by: str, nr: str = "nr") -> DataFrame:
    """Runs (by, start, stop, value), which don't overlap, with corrected ranges (by, nr, start, stop, value) spliced in: where
    corrections overlap, that of the greatest ``nr`` holds. Returns segments (by, segment, start, stop, value): neighbours of
    equal value are one, places that neither names stay empty. A correction may lie outside all runs; one whose stop is
    before its start says nothing.

    Places where anything begins or ends cut the axis into pieces, each piece takes the run that began last (along a window)
    and the corrections that cover it. Structures without corrections are only merged. Runs, corrections and pieces are written:
    all steps are dealt by structure, and one task would else hold the sorts of all of them, each with runs made anew."""
    runs = written(runs.select(by, "start", "stop", "value"), "runs")
    fixes = corrections.where(F.col("start") <= F.col("stop")).select(by, F.col(nr).alias("_nr"), F.col("start").alias("_from"), F.col("stop").alias("_to"), F.col("value").alias("_fix"))
    fixes = written(fixes, "fixes")
    named = fixes.select(by).distinct()
    ends = runs.join(named, by, "left_semi").select(by, F.explode(F.array("start", F.col("stop") + 1)).alias("at"))
    ends = ends.unionByName(fixes.select(by, F.explode(F.array("_from", F.col("_to") + 1)).alias("at")))
    begun = ends.distinct().join(runs.select(by, F.col("start").alias("at"), F.struct("stop", "value").alias("run")), [by, "at"], "left")
    along = Window.partitionBy(by).orderBy("at")
    last = F.last("run", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    pieces = begun.select(by, "at", (F.lead("at").over(along) - 1).alias("end"), last.alias("run")).where("end is not null")
    pieces = written(pieces, "pieces")
    covering = pieces.select(by, "at").join(fixes, by).where("at between _from and _to").groupBy(by, "at").agg(F.max_by("_fix", "_nr").alias("_fix"), F.lit(True).alias("_fixed"))
    pieces = pieces.join(covering, [by, "at"], "left")
    spliced = pieces.select(by, F.col("at").alias("start"), F.col("end").alias("stop"), F.when(F.col("_fixed"), F.col("_fix")).when(F.col("run.stop") >= F.col("at"), F.col("run.value")).alias("value"))
    rest = runs.join(named, by, "left_anti").select(by, "start", "stop", "value")
    rows = spliced.unionByName(rest).where("value is not null")
    order = Window.partitionBy(by).orderBy("start")
    fresh = ~(F.lag("value").over(order).eqNullSafe(F.col("value")) & F.lag("stop").over(order).eqNullSafe(F.col("start") - 1))
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("segment", F.sum("_new").over(order) - 1)
    return rows.groupBy(by, "segment").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("value").alias("value"))
