"""Roll-ups of structure tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import one_letter

_RULES = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg}


def roll_up(atoms: DataFrame, rules: dict[str, str], by: tuple[str, ...] = ("cath_domain", "residue_id")) -> DataFrame:
    """Atoms to residues, each feature by its rule (sum, min, max, mean)."""
    unknown = set(rules.values()) - set(_RULES)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    return atoms.groupBy(*by).agg(*(_RULES[r](c).alias(c) for c, r in rules.items()))


def copy_down(atoms: DataFrame, residues: DataFrame, columns: list[str], by: tuple[str, ...] = ("cath_domain", "residue_id")) -> DataFrame:
    """A residue's values on all of its atoms."""
    return atoms.drop(*columns).join(residues.select(*by, *columns), list(by), "left")


def residue_centres(atoms: DataFrame, by: tuple[str, ...] = ("cath_domain", "residue_id")) -> DataFrame:
    return atoms.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("bfactor", "x", "y", "z")))


def run_ids(df: DataFrame, value: str, by: str, order: str, name: str = "run_id") -> DataFrame:
    """Numbers runs of equal values along the order, from 0."""
    w = Window.partitionBy(by).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(w) - 1).drop("_new")


def sequences(atoms: DataFrame, by: str = "cath_domain", order: str = "serial_number") -> DataFrame:
    """One letter each time the residue changes in file order."""
    w = Window.partitionBy(by).orderBy(order)
    changed = ~F.col("residue_id").eqNullSafe(F.lag("residue_id").over(w)) | (F.row_number().over(w) == 1)
    first = atoms.withColumn("_new", changed).where("_new").select(by, F.struct(F.col(order).alias("k"), one_letter(F.col("residue_name")).alias("v")).alias("s"))
    return first.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]), "").alias("sequence"))


def backbone(atoms: DataFrame, features: list[str], by: tuple[str, ...] = ("cath_domain", "residue_id"), names: tuple[str, ...] = ("N", "CA", "C", "O"), order: str = "serial_number") -> DataFrame:
    """For each residue the first coordinates of its backbone atoms (null where absent) and the means of features there."""
    own = atoms.where(F.col("atom_name").isin(*names))
    first = [F.min_by(F.struct("x", "y", "z"), F.when(F.col("atom_name") == n, F.col(order))).alias(n) for n in names]
    return own.groupBy(*by).agg(F.min(order).alias("first"), *first, *(F.avg(f).alias(f) for f in features))


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """The bits of doubles as numbers that are ordered as the doubles are."""
    bits = x.to_numpy(np.float64).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits))


def value_at(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values of some ranks (from 0) among those that aren't null, exactly, by radix selection: rows are counted by the
    upper 16 bits of their value, then those that share the upper bits of a rank by the next 16, four times at most. No pass
    returns more than 65,536 counts, and none depends on how the values are spread."""
    bits = df.where(F.col(col).isNotNull()).select(ordered_bits(F.col(col).cast("double")).alias("v"))
    # rank -> the upper bits that are known, and the rank among the values that have them
    state = {r: (None, r) for r in ranks}
    for shift in (48, 32, 16, 0):
        known = {p for p, _ in state.values()}
        rows = bits if None in known else bits.where(F.shiftright("v", shift + 16).isin(sorted(known)))
        counts = rows.groupBy(F.shiftright("v", shift).alias("p")).agg(F.count("*").alias("n"))
        of = {None: sorted((x["p"], x["n"]) for x in counts.collect())} if None in known else {}
        if None not in known:
            for p, n in sorted((x["p"], x["n"]) for x in counts.collect()):
                of.setdefault(p >> 16, []).append((p, n))
        for r, (p, left) in state.items():
            for digit, n in of[p]:
                if left < n:
                    state[r] = (digit, left)
                    break
                left -= n
    back = lambda v: float(np.array([v if v >= 0 else v ^ 0x7FFF_FFFF_FFFF_FFFF], np.int64).view(np.float64)[0])
    return {r: back(p) for r, (p, _) in state.items()}


def median_of(df: DataFrame, col: str) -> DataFrame:
    """One row with the exact ``median`` of the values that aren't null (null if there are none)."""
    n = df.where(F.col(col).isNotNull()).count()
    found = value_at(df, col, sorted({(n - 1) // 2, n // 2})) if n else {}
    median = (found[(n - 1) // 2] + found[n // 2]) / 2 if n else None
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"))


def robust_stats(df: DataFrame, col: str = "bfactor", limit: float = 3.5, mad_scale: float = 1.0) -> DataFrame:
    """Mean and population deviation of what is left when values far above the mean, by the median absolute deviation, go:
    one row. Values that are null don't count."""
    dev = df.select(F.col(col)).crossJoin(F.broadcast(df.agg(F.avg(col).alias("m"))))  # one row
    mad = median_of(dev.select(F.abs(F.col(col) - F.col("m")).alias("d")), "d").select((F.col("median") * mad_scale).alias("mad"))
    kept = dev.crossJoin(F.broadcast(mad)).where(0.6745 * (F.col(col) - F.col("m")) / F.col("mad") <= limit)  # one row
    return kept.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.count("*").alias("n"))


def min_max(df: DataFrame, columns: list[str], by: str = "cath_domain") -> DataFrame:
    """Features scaled to 0..1 in each domain; a constant one is 0."""
    w = Window.partitionBy(by)
    lo, hi = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    return df.withColumns({c: F.when(hi(c) == lo(c), 0.0).otherwise((F.col(c) - lo(c)) / (hi(c) - lo(c))) for c in columns})


def z_scores(df: DataFrame, columns: list[str], by: str = "cath_domain") -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w) for c in columns})


def completeness(parts: dict[str, DataFrame], key: str = "cath_domain") -> DataFrame:
    """Which keys have rows in every part."""
    names = sorted(parts)
    rows = None
    for n in names:
        own = parts[n].select(key, F.lit(n).alias("part")).distinct()
        rows = own if rows is None else rows.union(own)
    return rows.groupBy(key).agg(F.count("*").alias("n_parts"), (F.count("*") == len(names)).alias("complete"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def wide(df: DataFrame, by: str, method: str, values: list[str], methods: list[str]) -> DataFrame:
    """One row a key, each value's column prefixed with the method it is from."""
    return df.groupBy(by).agg(*(F.max(F.when(F.col(method) == m, F.col(v))).alias(f"{m}_{v}") for m in methods for v in values))


def wide_pairs(df: DataFrame, by: list[str], reference: str, metrics: list[str], references: list[str]) -> DataFrame:
    """One row a compared complex, each metric's column prefixed with the reference it was compared to; null where it wasn't."""
    return df.groupBy(*by).agg(*(F.max(F.when(F.col(reference) == r, F.col(m))).alias(f"{r}_{m}") for r in references for m in metrics))


def interface_progress(expected: DataFrame, parts: dict[str, DataFrame], key: str = "pdb", interface: str = "interface_id", number: str = "num_interfaces") -> DataFrame:
    """For each structure how many of its interfaces each part has rows for, whether that is all of them, and whether all parts
    are done. ``expected``: key and how many interfaces it has. A part that has more than expected isn't done."""
    out = expected.select(key, number)
    rows = None
    for name, df in parts.items():
        one = df.select(key, interface, F.lit(name).alias("_part")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy(key).agg(*(F.count_if(F.col("_part") == n).alias(f"n_{n}") for n in parts))
    out = out.join(counts, key, "left").na.fill(0, [f"n_{n}" for n in parts])
    done = {f"{n}_done": F.col(f"n_{n}") == F.col(number) for n in parts}
    every = F.lit(True)
    for n in parts:
        every = every & F.col(f"{n}_done")
    return out.withColumns(done).withColumn("done", every)


def ordered_samples(atoms: DataFrame, features: list[str], by: str = "cath_domain", residue: str = "residue_id", order: str = "file", names: tuple[str, ...] = ("N", "CA", "C", "O")) -> DataFrame:
    """One row a structure, as a model of sequences reads it: residues, their letters (``sequence``, always in file order), the
    coordinates of their backbone atoms (NaN where an atom is absent) and the features' means. Residues stand in file order,
    or, with ``order`` ``lexical``, as their labels sort as text. A structure is one sample by nature."""
    if order not in ("file", "lexical"):
        raise ValueError("order is file or lexical")
    nan = F.struct(*(F.lit(float("nan")).alias(c) for c in "xyz"))
    bare = backbone(atoms, features, (by, residue), names).drop("first")
    letters = atoms.groupBy(by, residue).agg(F.min("serial_number").alias("_at"), one_letter(F.min_by("residue_name", "serial_number")).alias("_letter"))
    rows = letters.join(bare, [by, residue], "left")
    point = lambda n: F.coalesce(F.col(n), nan)
    xyz = F.array(*(F.array(*(point(n)[c] for c in "xyz")) for n in names))
    place = F.col("_at") if order == "file" else F.col(residue).cast("string")
    own = rows.select(by, F.struct(place.alias("k"), F.col("_at"), F.col(residue).cast("string").alias("residue"), xyz.alias("xyz"), F.array(*(F.col(f) for f in features)).alias("f")).alias("s"), F.struct("_at", "_letter").alias("l"))
    all_ = own.groupBy(by).agg(F.sort_array(F.collect_list("s")).alias("s"), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["_letter"]), "").alias("sequence"))
    return all_.select(by, F.transform("s", lambda x: x["residue"]).alias("residues"), "sequence", F.transform("s", lambda x: x["xyz"]).alias("coordinates"), F.transform("s", lambda x: x["f"]).alias("features"))
