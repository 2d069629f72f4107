"""Transforms of coordinate records (path, line_no and the parsed columns), over many structures at once.

Order is ``line_no`` within ``path``. A window is partitioned by path: a structure is the natural unit and stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import one_letter
from ..sources.structures import COORDS
from .scratch import written

KEPT = ("MODEL", "ATOM", "HETATM", "ANISOU", "ENDMDL", "END", "TER", "CONECT", "MASTER")


def _file():
    return Window.partitionBy("path").orderBy("line_no")


def is_coord() -> Column:
    return F.col("record").isin(*COORDS)


def set_field(df: DataFrame, field: str, value) -> DataFrame:
    """b-factor, occupancy, chain or segment of all coordinate records."""
    new = F.rpad(F.lit(value), 4, " ") if field == "segid" else F.lit(value)
    return df.withColumn(field, F.when(is_coord(), new).otherwise(F.col(field)))


def replace_chains(df: DataFrame, names: dict[str, str]) -> DataFrame:
    m = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    return df.withColumn("chain", F.when(is_coord(), F.coalesce(m[F.col("chain")], F.col("chain"))).otherwise(F.col("chain")))


def chain_to_segid(df: DataFrame) -> DataFrame:
    return df.withColumn("segid", F.when(is_coord(), F.rpad("chain", 4, " ")).otherwise(F.col("segid")))


def segid_to_chain(df: DataFrame) -> DataFrame:
    return df.withColumn("chain", F.when(is_coord(), F.substring(F.trim("segid"), 1, 1)).otherwise(F.col("chain")))


def select(df: DataFrame, field: str, values: list[str]) -> DataFrame:
    """Coordinate records of some chains or segments; other records stay."""
    return df.where(~is_coord() | F.trim(field).isin(*[v.strip() for v in values]))


def with_model(df: DataFrame) -> DataFrame:
    """The model that each record is in; 1 before any MODEL record."""
    number = F.when(F.col("record") == "MODEL", F.trim(F.substring("line", 11, 4)).try_cast("int"))
    return df.withColumn("model", F.coalesce(F.last(number, True).over(_file()), F.lit(1)))


def select_model(df: DataFrame, model: int) -> DataFrame:
    return with_model(df).where(F.col("model") == model).drop("model")


def delocc(df: DataFrame) -> DataFrame:
    """The first of several locations of an atom. A residue keeps the name it has first; that is settled before atoms."""
    residue = Window.partitionBy("path", "resseq", "chain", "icode").orderBy("line_no")
    atom = Window.partitionBy("path", "resseq", "chain", "icode", "atom_name").orderBy("line_no")
    named = df.where(is_coord()).withColumn("_first", F.first("resname").over(residue)).where("resname = _first").drop("_first")
    once = named.withColumn("_k", F.row_number().over(atom)).where("_k = 1").drop("_k").withColumn("altloc", F.lit(" "))
    return once.unionByName(df.where(~is_coord()))


def strip(df: DataFrame, hetero: bool = False) -> DataFrame:
    """Header records go; with ``hetero`` HETATM as well."""
    return df.where(F.col("record").isin(*[r for r in KEPT if not (hetero and r == "HETATM")]))


def residue_slices(df: DataFrame, slices: list[tuple[int, int]]) -> DataFrame:
    """Residues from a label to a label, both included, by where they stand in the file."""
    place = df.where(is_coord()).groupBy("path", "chain", "resseq").agg(F.min("line_no").alias("_at"), F.max("line_no").alias("_end"))
    bounds = None
    for lo, hi in slices:
        one = place.groupBy("path", "chain").agg(F.min(F.when(F.col("resseq") == lo, F.col("_at"))).alias("_lo"), F.max(F.when(F.col("resseq") == hi, F.col("_end"))).alias("_hi"))
        bounds = one if bounds is None else bounds.union(one)
    own = df.where(is_coord())
    b = bounds.where("_lo is not null and _hi is not null")
    return own.join(b, (own["path"] == b["path"]) & (own["chain"] == b["chain"]) & own["line_no"].between(b["_lo"], b["_hi"]), "left_semi")


def residue_list(df: DataFrame, residues: list[int]) -> DataFrame:
    return df.where(is_coord() & F.col("resseq").isin(*residues))


def shave(df: DataFrame, residues: list[int]) -> DataFrame:
    """Only the backbone of some residues; the rest as it is."""
    return df.where(~is_coord() | ~F.col("resseq").isin(*residues) | F.trim("atom_name").isin("CA", "N", "O", "C"))


def renumber_atoms(df: DataFrame, start: int = 1) -> DataFrame:
    atoms = df.where(is_coord()).withColumn("serial", F.row_number().over(_file()) + (start - 1))
    return atoms.unionByName(df.where(~is_coord()))


def renumber_residues(df: DataFrame, start: int = 1, chains: list[str] | None = None) -> DataFrame:
    """New numbers from ``start``, one more each time the number changes. ``chains``: start anew at each chain, and of
    the named ones (an empty list: all) change the numbers."""
    own = df.where(is_coord() | (F.col("record") == "TER"))
    changed = F.coalesce(~F.col("resseq").eqNullSafe(F.lag("resseq").over(_file())), F.lit(True)) | (F.row_number().over(_file()) == 1)
    turned = F.coalesce(F.col("chain") != F.lag("chain").over(_file()), F.lit(True))
    out = own.withColumns({"_new": changed.cast("int"), "_turn": turned.cast("int")}).withColumn("_run", F.sum("_turn").over(_file()))
    w = _file() if chains is None else Window.partitionBy("path", "_run").orderBy("line_no")
    number = F.sum("_new").over(w) + (start - 1)
    if chains:
        number = F.when(F.col("chain").isin(*chains), number).otherwise(F.col("resseq"))
    out = out.withColumn("resseq", number.cast("int")).drop("_new", "_turn", "_run")
    return out.unionByName(df.where(~(is_coord() | (F.col("record") == "TER"))))


def shift_residues(df: DataFrame, by: int, chains: list[str] | None = None) -> DataFrame:
    mine = is_coord() if not chains else is_coord() & F.col("chain").isin(*chains)
    return df.withColumn("resseq", F.when(mine, F.col("resseq") + by).otherwise(F.col("resseq")))


def tidy(df: DataFrame) -> DataFrame:
    """Coordinate records with TER after a change of chain, a jump in numbers, and the last one; then END.
    ``line_no`` is kept; ``sub`` orders what is added."""
    own = df.where(is_coord())
    nxt = F.lead(F.struct("chain", "resseq")).over(_file())
    ends = nxt.isNull() | (nxt["chain"] != F.col("chain")) | (nxt["resseq"] - F.col("resseq") > 1)
    ter = own.withColumns({"_last": nxt.isNull(), "_ter": ends}).where("_ter")
    blank = {c: F.lit(None).cast(t) for c, t in own.dtypes if c in ("x", "y", "z", "occ", "b")}
    rows = ter.withColumns({"record": F.lit("TER"), "serial": F.col("serial") + 1, "sub": F.lit(1), **blank}).drop("_ter")
    end = rows.where("_last").withColumns({"record": F.lit("END"), "sub": F.lit(2)}).drop("_last")
    return own.withColumn("sub", F.lit(0)).unionByName(rows.drop("_last")).unionByName(end)


def gaps(df: DataFrame, limit: float = 4.0) -> DataFrame:
    """Breaks between alpha carbons next to each other in a model's chain: farther than ``limit``, or numbers that skip."""
    ca = with_model(df).where(is_coord() & (F.col("atom_name") == " CA "))
    before = F.lag(F.struct("model", "chain", "resseq", "x", "y", "z")).over(_file())
    d = F.sqrt((F.col("x") - before["x"]) ** 2 + (F.col("y") - before["y"]) ** 2 + (F.col("z") - before["z"]) ** 2)
    rows = ca.withColumns({"_b": before, "distance": d}).where("_b.model = model and _b.chain = chain")
    kind = F.when(F.col("distance") > limit, "break").when(F.col("_b.resseq") + 1 != F.col("resseq"), "sequence")
    return rows.select("path", "model", "chain", F.col("_b.resseq").alias("before"), F.col("resseq").alias("after"), "distance", kind.alias("kind")).where("kind is not null")


def element_from_name(df: DataFrame, elements: tuple[str, ...]) -> DataFrame:
    """The element that an atom's name stands for, by where it begins; blank if there is none of that name."""
    raw, name = F.rpad("atom_name", 4, " "), F.trim("atom_name")
    whole = F.substring(raw, 1, 1).rlike("[A-Za-z]") & ~F.substring(raw, 3, 2).rlike("^[0-9]+$")
    guess = F.when(whole, name).when(F.substring(name, 1, 1).rlike("[0-9]"), F.substring(name, 2, 1)).otherwise(F.substring(name, 1, 1))
    return df.withColumn("element", F.when(is_coord(), F.when(guess.isin(*elements), guess).otherwise("")).otherwise(F.col("element")))


# Names of the fields that a format check looks at, their columns (from 1) and patterns.
FORMAT = (("serial", 7, 5, r"^[\d\s]+"), ("spacer1", 12, 1, r"^\s"), ("atom_name", 13, 4, r"^\s*[A-Z0-9]+\s*"), ("altloc", 17, 1, r"^[A-Z0-9 ]"), ("resname", 18, 3, r"^\s*[A-Z0-9]+\s*"), ("spacer2", 21, 1, r"^\s"), ("chain", 22, 1, r"^[A-Za-z0-9 ]"), ("resseq", 23, 4, r"^\s*[\d]+\s*"), ("icode", 27, 1, r"^[A-Z0-9 ]"), ("spacer3", 28, 3, r"^\s+"), ("x", 31, 8, r"^\s*[\d.-]+\s*"), ("y", 39, 8, r"^\s*[\d.-]+\s*"), ("z", 47, 8, r"^\s*[\d.-]+\s*"), ("occ", 55, 6, r"^\s*[\d.-]+\s*"), ("b", 61, 6, r"^\s*[\d.-]+\s*"), ("spacer4", 67, 6, r"^\s+"), ("segid", 73, 4, r"^[\sA-Z0-9+-]+"), ("element", 77, 2, r"^[\sA-Z0-9+-]+"), ("charge", 79, 2, r"^[\sA-Z0-9+-]+"))


def check_format(df: DataFrame) -> DataFrame:
    """Length of each line that isn't 80 columns, and the first field of a coordinate record that isn't well formed."""
    bad = F.lit(None).cast("string")
    for name, at, n, pattern in reversed(FORMAT):
        bad = F.when(~F.substring("line", at, n).rlike(pattern), name).otherwise(bad)
    out = df.select("path", "line_no", F.length("line").alias("length"), F.when(is_coord(), bad).alias("field"))
    return out.where("length != 80 or field is not null")


def pad_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.rpad("line", 80, " "))


def chain_sequences(df: DataFrame) -> DataFrame:
    """One letter for each residue of a chain, in the order they first occur."""
    first = df.where(is_coord()).groupBy("path", "chain", "resname", "resseq", "icode").agg(F.min("line_no").alias("at"))
    s = F.sort_array(F.collect_list(F.struct("at", one_letter(F.col("resname")).alias("c"))))
    return first.groupBy("path", "chain").agg(F.array_join(F.transform(s, lambda v: v["c"]), "").alias("sequence"))


def summarize(df: DataFrame) -> DataFrame:
    """Atoms, different atoms, residues, chains, models, and whether there are hetero records, gaps, double locations and
    insertions. Residues and chains count each time they start."""
    atom = F.col("record") == "ATOM"
    w = _file()
    own = df.where(atom)
    before = F.lag(F.struct("resname", "chain", "resseq")).over(w)
    new = before.isNull() | (before["resname"] != F.col("resname")) | (before["chain"] != F.col("chain")) | (before["resseq"] != F.col("resseq"))
    turn = before.isNull() | (before["chain"] != F.col("chain"))
    gap = new & (before["chain"] == F.col("chain")) & (F.col("resseq") - 1 != before["resseq"])
    a = own.withColumns({"_new": new, "_turn": turn, "_gap": F.coalesce(gap, F.lit(False))}).groupBy("path").agg(F.count("*").alias("n_atoms"), F.count_distinct("atom_name", "altloc", "resname", "chain", "resseq").alias("n_unique"), F.count_if("_new").alias("n_residues"), F.count_if("_turn").alias("n_chains"), F.bool_or("_gap").alias("has_gaps"), F.bool_or(F.col("altloc") != " ").alias("has_double"), F.bool_or(F.col("icode") != " ").alias("has_insert"))
    b = df.groupBy("path").agg(F.greatest(F.lit(1), F.count_if(F.col("record") == "MODEL")).alias("n_models"), F.bool_or(F.col("record") == "HETATM").alias("has_hetero"))
    return a.join(b, "path")


_ID = ["chain", "resname", "resseq", "icode", "atom_name", "altloc"]


def harmonize(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of ``left`` whose atom is in ``right`` too."""
    return left.where(is_coord()).join(right.where(is_coord()).select(*_ID).distinct(), _ID, "left_semi")


def join_models(df: DataFrame, group: str, strict: bool = False, dealt: bool = False) -> DataFrame:
    """Structures of a group as its models, numbered by path: how many atoms of the group's first model each lacks, and how
    many it has besides. An atom that is listed twice counts once. ``strict``: a model that lacks atoms is an error. Rows are
    dealt by group once, for all steps up to the counts, which are written. ``dealt``: those of a group are in one task already."""
    rows = df.where(is_coord() & F.col(group).isNotNull()).select(group, "path", *_ID)
    rows = rows if dealt else rows.repartition(group)
    holders = rows.groupBy(group, *_ID).agg(F.collect_set("path").alias("paths")).select(group, "paths")
    kinds = holders.groupBy(group, F.array_sort("paths").alias("paths")).agg(F.count("*").alias("c"))  # atoms of the same holders
    first = F.min(F.get("paths", F.lit(0))).over(Window.partitionBy(group))
    each = kinds.withColumn("first", first).select(group, "c", F.array_contains("paths", F.col("first")).alias("shared"), F.explode("paths").alias("path"))
    models = written(each.groupBy(group, "path").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("shared"), F.col("c")).otherwise(0)).alias("k")), "models")
    own = Window.partitionBy(group)
    out = models.withColumn("model", F.row_number().over(own.orderBy("path"))).withColumn("n_first", F.min_by("n", "path").over(own))
    missing = F.col("n_first") - F.col("k")
    if strict:
        missing = F.when(missing > 0, F.raise_error(F.concat(F.lit("Different atoms in model "), F.col("model").cast("string"))).cast("long")).otherwise(missing)
    return out.select(group, "path", "model", missing.alias("n_missing"), (F.col("n") - F.col("k")).alias("n_extra")).withColumn("same_atoms", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def copy_values(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Occupancy and b-factor of a reference structure by atom; 1.0 and 20.0 where it lacks the atom."""
    ref = reference.where(is_coord()).groupBy("path", *_ID).agg(F.min_by("occ", "line_no").alias("_occ"), F.min_by("b", "line_no").alias("_b"))
    out = df.where(is_coord()).join(ref, ["path", *_ID], "left")
    return out.withColumns({"occ": F.coalesce("_occ", F.lit(1.0)), "b": F.coalesce("_b", F.lit(20.0))}).drop("_occ", "_b")


def update_coordinates(df: DataFrame, other: DataFrame) -> DataFrame:
    """Coordinates of another structure, atom by atom in order."""
    k = lambda d: d.where(is_coord()).withColumn("_k", F.row_number().over(_file()))
    o = k(other).select("path", "_k", *(F.col(c).alias(f"_{c}") for c in "xyz"))
    return k(df).join(o, ["path", "_k"]).withColumns({c: F.col(f"_{c}") for c in "xyz"}).drop("_k", "_x", "_y", "_z")


def prepare(df: DataFrame, chain: str, model: int = 1, slices: list[tuple[int, int]] | None = None, rename: str | None = None, steps: bool = False) -> DataFrame:
    """The whole clean-up: one model, one chain (a blank one takes its name), one location, no hetero records, residues from a
    label to a label (``slices``) if any are named, tidied, and the chain renamed last. ``steps``: with the names of the steps
    that were taken, as ``prep_steps``."""
    named = select_model(df, model).withColumn("chain", F.when(is_coord() & (F.col("chain") == " "), chain).otherwise(F.col("chain")))
    taken = [f"model {model}", f"chain {chain}", "delocc", "striphet"]
    out = strip(delocc(select(named, "chain", [chain])), hetero=True)
    if slices:
        out = residue_slices(out, slices)
        taken.append("slices " + ",".join(f"{lo}-{hi}" for lo, hi in slices))
    out = tidy(out)
    taken.append("tidy")
    if rename is not None:
        # chain breaks have a chain too
        out = out.withColumn("chain", F.when(F.col("chain") == chain, F.lit(rename)).otherwise(F.col("chain")))
        taken.append(f"rename {rename}")
    return out.withColumn("prep_steps", F.array(*map(F.lit, taken))) if steps else out


def chain_list(df: DataFrame) -> DataFrame:
    own = df.where(is_coord())
    return own.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"), F.min_by("chain", "line_no").alias("first_chain"), F.count_distinct("resseq", "icode").alias("n_residues"))


def complexes(left: DataFrame, right: DataFrame, pair: str) -> DataFrame:
    """Two structures of a pair as one, their chains named M and I."""
    both = left.withColumn("chain", F.lit("M")).withColumn("_side", F.lit(0)).unionByName(right.withColumn("chain", F.lit("I")).withColumn("_side", F.lit(1)))
    w = Window.partitionBy(pair).orderBy("_side", "line_no")
    return both.withColumn("line_no", F.row_number().over(w).cast("long")).withColumn("path", F.col(pair)).drop("_side")


def split_complex(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a complex, as they were before they were put together but for the names of their chains."""
    return df.where(is_coord() & (F.col("chain") == "M")), df.where(is_coord() & (F.col("chain") == "I"))


def drop_ter(df: DataFrame) -> DataFrame:
    return df.where(F.col("record") != "TER")


def spaced_coordinates(df: DataFrame) -> DataFrame:
    """Coordinates with blanks between them, which wide numbers leave none of in the columns of a line."""
    return df.withColumn("xyz", F.when(is_coord(), F.concat_ws(" ", *(F.format_string("%.3f", F.col(c)) for c in "xyz"))))


def first_altloc(df: DataFrame) -> DataFrame:
    """The first location of every atom; other records stay."""
    w = Window.partitionBy("path", "model", "chain", "resseq", "icode", "atom_name").orderBy("line_no")
    own = with_model(df).where(is_coord()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "model")
    return own.unionByName(df.where(~is_coord()))


def first_insertion(df: DataFrame) -> DataFrame:
    """Of the residues that share a number, the one that comes first in the file; other records stay."""
    w = Window.partitionBy("path", "model", "chain", "resseq").orderBy("line_no")
    own = with_model(df).where(is_coord()).withColumn("_first", F.first("icode").over(w)).where("icode = _first").drop("_first", "model")
    return own.unionByName(df.where(~is_coord()))


def residue_labels(df: DataFrame, names: bool = False) -> DataFrame:
    """Every residue of a chain once, in file order, as number and insertion code; with its name if asked for."""
    label = F.concat(F.col("resseq").cast("string"), F.trim("icode"))
    keys = ["path", "chain", label.alias("label"), *(["resname"] if names else [])]
    return df.where(is_coord()).groupBy(*keys).agg(F.min("line_no").alias("first"))
