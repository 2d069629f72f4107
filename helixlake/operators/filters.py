"""Projections and filters over structure tables."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that identify an atom or residue, and are never features.
IDS = ("cath_domain", "serial_number", "atom_name", "residue_id", "residue_name", "chain")


def select_features(df: DataFrame, use: list[str], predict: list[str] = ()) -> DataFrame:
    """Id columns and the named features. What is predicted must not be used."""
    both = set(use) & set(predict)
    if both:
        raise ValueError(f"used and predicted: {sorted(both)}")
    names = [c for c in (*use, *predict) if c not in IDS]
    return df.select(*[c for c in IDS if c in df.columns], *names)


def filter_atoms(df: DataFrame, include: list | None = None, exclude: list | None = None, by: str = "serial_number", hetatms: bool = False) -> DataFrame:
    """Atoms in ``include``, else those not in ``exclude``; HETATM records only if asked for."""
    if not hetatms and "record" in df.columns:
        df = df.where(F.col("record") != "HETATM")
    if include is not None:
        return df.where(F.col(by).isin(list(include)))
    return df if exclude is None else df.where(~F.col(by).isin(list(exclude)))


def surface(df: DataFrame, buried: str = "residue_buried") -> DataFrame:
    if buried not in df.columns:
        raise ValueError(f"{buried} was never computed")
    return df.where(F.col(buried) == 0)


def filter_table(df: DataFrame, columns: list[str] | None = None, distinct: bool = False, **equal) -> DataFrame:
    """Rows whose columns equal the values given, and of them the columns asked for."""
    if equal:
        df = df.where(reduce(and_, (F.col(k) == F.lit(v) for k, v in equal.items())))
    df = df.select(*columns) if columns else df
    return df.distinct() if distinct else df


def under(code: Column, prefixes: list[str]) -> Column:
    """Whether a dotted code equals one of the prefixes or lies below it."""
    return reduce(or_, (F.concat(code, F.lit(".")).startswith(p + ".") for p in prefixes), F.lit(False))


def filter_codes(df: DataFrame, keep: list[str] | None = None, skip: list[str] | None = None, code: str = "cath_code") -> DataFrame:
    if keep:
        df = df.where(under(F.col(code), keep))
    return df.where(~under(F.col(code), skip)) if skip else df


def ancestors_of(nodes: DataFrame, codes: list[str], code: str = "cath_code") -> DataFrame:
    """Nodes that are one of the codes or above one."""
    own = F.concat(F.col(code), F.lit("."))
    return nodes.where(reduce(or_, (F.lit(c + ".").startswith(own) for c in codes), F.lit(False)))


def at_level(df: DataFrame, level: int, code: str = "cath_code") -> DataFrame:
    return df.where(F.size(F.split(code, r"\.")) == level)


def drop_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``: obsolete entries, finished work."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def unfold_residues(atoms: DataFrame, some: DataFrame, by: tuple[str, ...] = ("cath_domain", "residue_id")) -> DataFrame:
    """All atoms of each residue that ``some`` touches."""
    return atoms.join(some.select(*by).distinct(), list(by), "left_semi")


def is_ca_model(df: DataFrame, by: str = "cath_domain") -> DataFrame:
    return df.groupBy(by).agg(F.bool_and(F.col("atom_name") == "CA").alias("is_ca_model"))


def validate_structures(df: DataFrame, by: str = "cath_domain") -> DataFrame:
    """One row a structure: how many atoms and chains it has, and whether it can be used (one chain, some atoms)."""
    n = F.count_distinct("chain")
    return df.groupBy(by).agg(F.count("*").alias("n_atoms"), n.alias("n_chains"), ((n == 1) & (F.count("*") > 0)).alias("valid"))


def residue_of(df: DataFrame, label: int | str | tuple[str, int, str], by: tuple[str, ...] = ("path", "chain")) -> DataFrame:
    """The coordinate rows of one residue of each chain. A number takes the residue of that number without insertion code and
    not hetero, or else the first of that number in the file; a text (``22`` or ``22A``) number and insertion code, not hetero;
    a key names all three: what kind of hetero residue it is (``" "`` for none, ``H`` for any), number, insertion code."""
    hetero = F.col("record") == "HETATM"
    own = df.where(F.col("record").isin("ATOM", "HETATM"))
    if isinstance(label, tuple):
        kind, number, icode = label
        return own.where((hetero == F.lit(kind.strip() != "")) & (F.col("resseq") == number) & (F.col("icode") == icode.ljust(1)))
    if isinstance(label, str):
        found = re.fullmatch(r"\s*(-?\d+)\s*(\S?)\s*", label)
        return residue_of(df, (" ", int(found[1]), found[2].ljust(1)), by) if found else own.where(F.lit(False))
    numbered = own.where(F.col("resseq") == label)
    what = F.struct(hetero.alias("hetero"), "icode")
    plain = ~hetero & (F.col("icode") == " ")
    which = numbered.groupBy(*by).agg(F.coalesce(F.min_by(what, F.when(plain, F.col("line_no"))), F.min_by(what, "line_no")).alias("_which"))
    return numbered.join(which, list(by)).where(what == F.col("_which")).drop("_which").select(df.columns)


def validate_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a file (path and bytes, as Spark's reader of binary files gives them): whether it is empty, whether it is gzip
    data rather than text, how many chains its coordinate lines have, and whether it can be used."""
    raw = F.col(content)
    rows = files.select(path, raw, (F.coalesce(F.octet_length(raw), F.lit(0)) == 0).alias("empty"), F.coalesce(F.substring(raw, 1, 2) == F.unhex(F.lit("1F8B")), F.lit(False)).alias("gzipped"))
    lines = F.filter(F.split(F.decode(raw, "ISO-8859-1"), "\r?\n"), lambda x: x.startswith("ATOM") | x.startswith("HETATM"))
    chains = F.size(F.array_distinct(F.transform(lines, lambda x: F.substring(x, 22, 1))))
    n = F.when(F.col("empty") | F.col("gzipped"), 0).otherwise(chains)
    return rows.withColumn("n_chains", n).select(path, "empty", "gzipped", "n_chains", (F.col("n_chains") == 1).alias("valid"))
