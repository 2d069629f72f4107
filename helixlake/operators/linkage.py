"""Links and centres of vectors without all pairs.

Vectors are dealt to the nearest of some pivots. Two within an angle are in one cell, or the plane between their pivots is no
farther from either than that angle, so a pair is found where one of the two is at home and the other visits. By the triangle
inequality, what is within half the angle of a pivot is linked with all else that is, without a look at the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clusters import components
from .scratch import written

#: Pivots at most, rows for each, and what an angle (in radians) may be off by.
PIVOTS, PIVOT_ROWS, SLIP = 256, 2_000, 1e-4
#: Rows of a block of vectors; a large block sends a vector to few others.
BLOCK_ROWS = 8_000
#: Rows of a block that are multiplied with the other block at once.
SLICE_ROWS = 500


def _units(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which rows have one (the others are missing, zero or hold what isn't finite)."""
    rows = [None if v is None else np.asarray(v, np.float64) for v in vectors]
    width = max((len(v) for v in rows if v is not None), default=0)
    flat = np.array([v if v is not None and len(v) == width else np.full(width, np.nan) for v in rows]).reshape(len(rows), width)
    norm = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    flat[~good] = 0
    return flat / np.where(good, norm, 1.0)[:, None], good


def pivots_of(df: DataFrame, key: str, vec: str, most: int = PIVOTS, rows: int = PIVOT_ROWS) -> np.ndarray:
    """One unit vector for ``rows`` rows, ``most`` at most: of four times as many, the first rows by hash, each time the one
    that is farthest from those taken. Results don't rest on the choice."""
    usable = df.where(F.col(vec).isNotNull())
    n = max(1, min(most, usable.count() // rows))
    found = usable.select(F.xxhash64(key).alias("h"), F.col(vec).alias("v")).orderBy("h").limit(4 * n).collect()
    unit, good = _units([r["v"] for r in found])
    unit = unit[good]
    taken, near = [], np.full(len(unit), -2.0)
    for _ in range(min(n, len(unit))):
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def deal(df: DataFrame, key: str, group: str, vec: str, least: float, pivots: np.ndarray) -> DataFrame:
    """Rows (group, key, unit, home, angle, cell): each vector in its own cell and in those that may hold a partner of it, at
    cosines of ``least``: where the plane between the two pivots is no farther than that angle. Missing and zero vectors
    have none."""
    reach = math.sin(min(math.pi / 2, math.acos(max(-1.0, min(1.0, least))) + SLIP))
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T)) if len(pivots) else np.zeros((1, 1))
    schema = T.StructType([df.schema[group], df.schema[key], T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("home", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit, good = _units(b["v"])
            b, unit = b[good], unit[good]
            near = np.clip(unit @ pivots.T, -1, 1) if len(pivots) else np.ones((len(b), 1))
            home = near.argmax(axis=1) if len(b) else np.zeros(0, int)
            own = near[np.arange(len(b)), home]
            cells = [np.flatnonzero(o - x <= reach * a + 1e-12).astype(np.int32) for x, o, a in zip(near, own, apart[home], strict=True)]
            own = np.arccos(own)
            yield pd.DataFrame({group: b[group], key: b[key], "unit": list(unit), "home": home.astype(np.int32), "angle": own, "cells": cells})

    dealt = df.select(group, key, F.col(vec).cast("array<double>").alias("v")).mapInPandas(run, schema)
    # a group whose rows would go to more cells than it has blocks stays in one cell: its vectors have no structure
    n = dealt.groupBy(group).agg(F.sum(F.size("cells")).alias("copies"), F.count("*").alias("n"))
    flat = n.select(F.col(group).alias("_flat")).where(F.col("copies") > F.col("n") * F.greatest(F.lit(2.0), F.ceil(F.col("n") / BLOCK_ROWS))) if len(pivots) else None
    if flat is not None:
        one = F.col("_flat").isNotNull()
        dealt = dealt.join(flat, F.col(group).eqNullSafe(F.col("_flat")), "left")
        dealt = dealt.withColumns({"home": F.when(one, -1).otherwise(F.col("home")), "angle": F.when(one, math.pi).otherwise(F.col("angle")), "cells": F.when(one, F.array(F.lit(-1))).otherwise(F.col("cells"))})
    return dealt.select(group, key, "unit", "home", "angle", F.explode("cells").alias("cell"))


def work(dealt: DataFrame, group: str) -> DataFrame:
    """How many pairs each cell has to look at: (group, cell, pairs)."""
    return dealt.groupBy(group, "cell").agg((F.count_if(F.col("home") == F.col("cell")) * F.count("*")).alias("pairs"))


def close_pairs(dealt: DataFrame, key: str, group: str, least: float, skip_within: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (group, a < b, score) of a cosine of ``least`` or more, each once, where a is at home. A cell is dealt to blocks as
    large as its size calls for; a block against a block is one product of matrices. ``skip_within``: pairs that are both at
    home and within this angle of the pivot are left out."""
    sizes = dealt.groupBy(group, "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    rows = dealt.join(sizes, [group, "cell"]).withColumns({"own": F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    core = (F.col("home") == F.col("cell")) & (F.col("angle") <= (-1.0 if skip_within is None else skip_within))
    # names anew on each side, as both come from one table
    side = lambda one, two: [*(F.col(c).alias(c) for c in (group, "cell", key, "unit")), F.col(one).alias("x"), F.col(two).alias("y"), core.alias("core")]
    a = rows.where(F.col("home") == F.col("cell")).select(*side("own", "other"))
    b = rows.select(*side("other", "own"))
    schema = T.StructType([dealt.schema[group], T.StructField("a", dealt.schema[key].dataType), T.StructField("b", dealt.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({f.name: pa.array([], pa.null()) for f in schema})
        u, v = (_matrix(t["unit"]) for t in (left, right))
        ka, kb = (t[key].to_numpy(zero_copy_only=False) for t in (left, right))
        ca, cb = (np.asarray(t["core"].to_numpy(zero_copy_only=False), bool) for t in (left, right))
        found = []
        for at in range(0, len(u), SLICE_ROWS):
            own = slice(at, at + SLICE_ROWS)
            score = u[own] @ v.T
            i, j = np.nonzero(score >= least)
            keep = (ka[own][i] < kb[j]) & ~(ca[own][i] & cb[j])
            i, j = i[keep], j[keep]
            found.append((i + at, j, score[i, j]))
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({group: left[group].take(pa.array(i)), "a": left[key].take(pa.array(i)), "b": right[key].take(pa.array(j)), "score": pa.array(score)})

    by = [group, "cell", "x", "y"]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(lambda x, y: product(x, y).cast(_arrow(schema)), schema)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def single_linkage(df: DataFrame, key: str, group: str, vec: str = "embedding", least: float = 0.9, pivots: np.ndarray | None = None) -> DataFrame:
    """Single-linkage clusters at a cosine of ``least`` inside each group: (key, cluster), the cluster's smallest key. Missing and
    zero vectors are alone. Only pairs that no pivot decides are looked at."""
    pivots = pivots_of(df, key, vec) if pivots is None else pivots
    dealt = written(deal(df, key, group, vec, least, pivots), "cells")
    near = math.acos(max(-1.0, min(1.0, least))) / 2 - SLIP
    pairs = close_pairs(dealt, key, group, least, near if len(pivots) else None).select("a", "b")
    if len(pivots):
        core = dealt.where((F.col("home") == F.col("cell")) & (F.col("angle") <= near)).select(group, "cell", key)
        firsts = core.groupBy(group, "cell").agg(F.min(key).alias("a"))
        pairs = pairs.unionByName(core.join(firsts, [group, "cell"]).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b")))
    return components(pairs, df, key)


def central_members(df: DataFrame, key: str, cluster: str, vec: str = "embedding") -> DataFrame:
    """The member of each cluster with the least mean distance (1 - cosine) to the others, the smallest key on ties: (cluster,
    centroid, distance, n). The mean is made with the sum S of the cluster's n unit vectors, 1 - (u . S - 1) / (n - 1), so each
    vector is looked at twice and no pair is. Missing and zero vectors, and clusters of one, take no part."""
    schema = T.StructType([df.schema[cluster], df.schema[key], T.StructField("unit", T.ArrayType(T.DoubleType()))])

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit, good = _units(b["v"])
            yield pd.DataFrame({cluster: b[cluster][good], key: b[key][good], "unit": list(unit[good])})

    u = written(df.select(cluster, key, F.col(vec).cast("array<double>").alias("v")).mapInPandas(units, schema), "units")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(c, len(g), np.sum(np.stack(g["unit"].to_numpy()), axis=0)) for c, g in b.groupby(cluster, dropna=False)]
            yield pd.DataFrame({cluster: [x[0] for x in own], "n": [x[1] for x in own], "total": [x[2] for x in own]})

    parts = u.mapInPandas(totals, T.StructType([df.schema[cluster], T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))]))
    parts = written(parts, "totals")
    sums = parts.select(cluster, F.posexplode("total").alias("place", "x")).groupBy(cluster, "place").agg(F.sum("x").alias("x"))
    sums = sums.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("total"))
    sums = sums.join(parts.groupBy(cluster).agg(F.sum("n").alias("n")), cluster).where("n > 1")
    dot = F.aggregate(F.zip_with("unit", "total", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    far = u.join(sums, cluster).select(cluster, key, "n", F.round(1 - (dot - 1) / (F.col("n") - 1), 6).alias("distance"))
    best = far.groupBy(cluster).agg(F.min(F.struct("distance", key)).alias("best"), F.first("n").alias("n"))
    return best.select(cluster, F.col(f"best.{key}").alias("centroid"), "best.distance", "n")
