"""Derived atom and residue features: all of them compile into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import BIOLOGICAL, KD, OCTANAL, PHARMACOPHORE, RESIDUE_RADII, RESIDUES, THRESHOLDS, VDW_RADII, lookup, one_hot, one_letter, threshold

# The catalogue's atom types.
ATOM_TYPES = ("H", "HD", "HS", "C", "A", "N", "NA", "NS", "OA", "OS", "F", "MG", "P", "SA", "S", "CL", "CA", "MN", "FE", "ZN", "BR", "I")
# The catalogue's elements.
ELEMENTS = ("C", "N", "O", "S", "H", "F", "MG", "P", "CL", "CA", "MN", "FE", "ZN", "BR", "I")
NAN = float("nan")


def thresholds(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The catalogue's booleans whose source column is there."""
    return df.withColumns({n: threshold(F.col(c), rules) for n, (c, rules) in THRESHOLDS.items() if c in df.columns and (names is None or n in names)})


def fill_defaults(df: DataFrame, defaults: dict[str, float], replace_na: bool = False) -> DataFrame:
    """Columns that are missing get their default; with ``replace_na`` NaN and null do as well."""
    new = {c: F.lit(float(v)) for c, v in defaults.items() if c not in df.columns}
    if replace_na:
        new |= {c: F.coalesce(F.nanvl(c, F.lit(float(v))), F.lit(float(v))) for c, v in defaults.items() if c in df.columns}
    return df.withColumns(new) if new else df


def element_features(df: DataFrame) -> DataFrame:
    return df.withColumns(one_hot(F.col("element"), ELEMENTS, "_elem", "Unk_elem"))


def element_of(df: DataFrame) -> Column:
    """The element that one-hot columns stand for; of several the first of C, N, O, S, H."""
    out = F.lit(None).cast("string")
    for e in reversed([x for x in (*"CNOSH", *ELEMENTS) if f"{x}_elem" in df.columns]):
        out = F.when(F.col(f"{e}_elem") == 1, e).otherwise(out)
    return out


def radii(df: DataFrame) -> DataFrame:
    return df.withColumns({"vdw": lookup(VDW_RADII, F.col("element"), 1.7), "residue_radius": lookup(RESIDUE_RADII, F.col("residue_name"), 3.0)})


def hydrophobicity(df: DataFrame) -> DataFrame:
    code = one_letter(F.col("residue_name"))
    cols = {n: lookup(m, code, NAN) for n, m in (("kd", KD), ("biological", BIOLOGICAL), ("octanal", OCTANAL))}
    return df.withColumns(cols | {"is_hydrophobic": threshold(cols["kd"], THRESHOLDS["is_hydrophobic"][1])})


def residue_one_hot(df: DataFrame) -> DataFrame:
    return df.withColumns(one_hot(F.col("residue_name"), RESIDUES, "", "Unk_residue"))


def secondary_structure(df: DataFrame, ss: str = "ss") -> DataFrame:
    """Helix, sheet and unknown flags, and one for each letter."""
    flag = lambda *x: F.col(ss).isin(*x).cast("double")
    cols = {"is_helix": flag("G", "H"), "is_sheet": flag("B", "E"), "Unk_SS": 1.0 - flag("G", "H", "B", "E")}
    return df.withColumns(cols | {f"is_{n}": flag(x) for n, x in (("a", "H"), ("b", "B"), ("e", "E"), ("g", "G"), ("i", "I"), ("t", "T"), ("s", "S"))})


def pharmacophore(df: DataFrame, atom_type: str = "atom_type") -> DataFrame:
    return df.withColumns({n: F.col(atom_type).isin(*names).cast("double") for n, names in PHARMACOPHORE.items()})


def conservation(residues: DataFrame, entropy: DataFrame, by: list[str]) -> DataFrame:
    """Entropy from a table by residue; residues that it lacks have the largest, 1."""
    out = residues.join(entropy.select(*by, "entropy"), by, "left").withColumn("entropy", F.coalesce("entropy", F.lit(1.0)))
    return out.withColumn("is_conserved", threshold(F.col("entropy"), THRESHOLDS["is_conserved"][1]))


def conservation_grade(grade: Column) -> Column:
    """Grades 1 to 9 on a scale of 0 to 1; a dot (no grade) is NaN."""
    return F.when(F.trim(grade) == ".", F.lit(NAN)).otherwise((F.trim(grade).try_cast("double") - 1) / 8)


def electrostatics(atoms: DataFrame, annotation: DataFrame, by: list[str]) -> DataFrame:
    """Charge and potential from a table by atom (null where it lacks one), and their three booleans."""
    return charge_flags(atoms.join(annotation.select(*by, "charge", "electrostatic_potential"), by, "left"))


def charge_flags(df: DataFrame) -> DataFrame:
    return thresholds(df, ["neg_charge", "pos_charge", "is_electronegative"])


def angle_features(df: DataFrame, names: tuple[str, ...] = ("phi", "psi")) -> DataFrame:
    """Sine and cosine of angles in radians."""
    return df.withColumns({f"{n}_{f.__name__}": f(n) for n in names for f in (F.sin, F.cos)})


def docking_scores(df: DataFrame, ligand: bool = False) -> DataFrame:
    """Simple and zdock terms by burial (relative area under one half). A ligand's simple term is 1 throughout, and its charge
    doesn't count."""
    buried = F.col("residue_rasa") < 0.5
    simple = F.lit(1.0) if ligand else F.when(buried, -15.0).otherwise(1.0)
    return df.withColumns({"simple": simple, "zdock": F.when(buried, 3.5**2).otherwise(3.5), "zdock_charge": F.lit(0.0) if ligand else F.col("charge")})


def truth_vectors(df: DataFrame, positive: Column, n_classes: int = 2) -> DataFrame:
    yes = F.coalesce(positive, F.lit(False)).cast("double")
    return df.withColumn("truth", F.array(1.0 - yes, yes) if n_classes == 2 else F.array(yes))


def arithmetic(left: DataFrame, right: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Row-aligned sums, differences and quotients of two structures' features; x/0 is null."""
    r = right.select(*by, *(F.col(c).alias(f"_{c}") for c in columns))
    cols = []
    for c in columns:
        a, b = F.col(c), F.col(f"_{c}")
        cols += [(a + b).alias(f"{c}_sum"), (a - b).alias(f"{c}_diff"), F.try_divide(a, b).alias(f"{c}_ratio"), F.abs(a - b).alias(f"{c}_abs")]
    return left.join(r, by).select(*by, *cols)


def scalar_arithmetic(df: DataFrame, columns: list[str], value: float) -> DataFrame:
    """Features and a number: sums, differences, quotients (whole division is the true one), and absolute values."""
    cols = {}
    for c in columns:
        cols |= {f"{c}_sum": F.col(c) + value, f"{c}_diff": F.col(c) - value, f"{c}_ratio": F.try_divide(F.col(c), F.lit(float(value))), f"{c}_abs": F.abs(c)}
    return df.withColumns(cols)


def id_parts(df: DataFrame, domain: str = "cath_domain", residue: str = "residue_id") -> DataFrame:
    """pdb, chain and number of a seven-letter domain id; number and insertion code of a residue id."""
    d = F.col(domain).cast("string")
    seven = F.length(d) == 7
    cols = {"pdb": F.when(seven, F.substring(d, 1, 4)).otherwise(d), "pdb_chain": F.when(seven, F.substring(d, 5, 1)), "dom_no": F.when(seven, F.substring(d, 6, 2))}
    pattern = r"^(-?[0-9]+)([A-Za-z]?)$"
    return df.withColumns(cols | {"resseq": F.expr("try_cast(regexp_extract(%s, '%s', 1) as int)" % (residue, pattern)), "icode": F.regexp_extract(residue, pattern, 2)})


def normalised_bfactor(df: DataFrame, stats: DataFrame) -> DataFrame:
    """B-factors by the mean and deviation of a one-row table, as ``robust_stats`` gives it."""
    one = stats.select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return df.crossJoin(F.broadcast(one)).withColumn("bfactor_norm", F.try_divide(F.col("bfactor") - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def atom_types(df: DataFrame, atom_type: str = "atom_type") -> DataFrame:
    return df.withColumns(one_hot(F.col(atom_type), ATOM_TYPES, "_type", "Unk_atom"))


#: What each group of features adds; a preset is a list of groups.
GROUPS = {"element": element_features, "atom_type": atom_types, "radii": radii, "hydrophobicity": hydrophobicity, "residue": residue_one_hot, "structure": secondary_structure, "pharmacophore": pharmacophore, "thresholds": thresholds}
PRESETS = {"all": tuple(GROUPS), "only_aa": ("residue",), "only_atom": ("atom_type",), "non_geometric": ("radii", "hydrophobicity", "thresholds"), "pharmacophore": ("pharmacophore",)}
#: Columns of the groups that datasets choose from, and the named choices.
COLUMNS = {
    "element": (*(f"{e}_elem" for e in ELEMENTS), "Unk_elem"), "atom_type": (*(f"{t}_type" for t in ATOM_TYPES), "Unk_atom"), "residue": (*RESIDUES, "Unk_residue"), "deepsite": tuple(PHARMACOPHORE),
    "structure": ("is_helix", "is_sheet", "Unk_SS", "is_a", "is_b", "is_e", "is_g", "is_i", "is_t", "is_s"), "hydrophobicity": ("kd", "biological", "octanal", "is_hydrophobic"),
}
COLUMN_PRESETS = {"only_aa": ("residue",), "only_atom": ("atom_type",), "use_deepsite": ("deepsite",), "both": ("residue", "deepsite"), "coarse": ("residue", "structure", "hydrophobicity"), "all": tuple(COLUMNS)}


def preset_columns(name: str) -> list[str]:
    """The feature columns of a named choice."""
    return [c for group in COLUMN_PRESETS[name] for c in COLUMNS[group]]


def preset(df: DataFrame, name: str, update: tuple[str, ...] = ()) -> DataFrame:
    """The features of a preset, or of the groups or single features named in ``update`` alone; other columns pass through."""
    for group in update or PRESETS[name]:
        if group in GROUPS:
            df = GROUPS[group](df)
        else:
            home = next((g for g, names in COLUMNS.items() if group in names), "thresholds")
            df = _single(df, {"deepsite": "pharmacophore"}.get(home, home), group)
    return df


def _single(df: DataFrame, group: str, feature: str) -> DataFrame:
    """One feature of a group; the group's other columns stay as they were."""
    full = GROUPS[group](df)
    return full.select(*(c for c in df.columns if c != feature), feature)


def sequence_samples(residues: DataFrame, by: str, order: str, labels: list[Column], features: list[Column]) -> DataFrame:
    """One row a structure: its sequence, and matrices of labels and of features with a row for each residue in order."""
    row = F.struct(order, one_letter(F.col("residue_name")).alias("c"), F.array(*labels).alias("labels"), F.array(*features).alias("features"))
    s = residues.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("s"))
    return s.select(by, F.array_join(F.col("s.c"), "").alias("sequence"), F.col("s.labels").alias("labels"), F.col("s.features").alias("features"))


def with_label(truth: Column, label: Column) -> Column:
    """A truth vector with the domain's encoded label as one more entry."""
    return F.concat(truth, F.array(label.cast("double")))


def add_features(df: DataFrame, extra: DataFrame, by: list[str]) -> DataFrame:
    """Columns of another table by key; rows without one have null."""
    return df.join(extra, by, "left")


def node_mask(residue: Column) -> Column:
    """Twenty places, one of them 1; selenomethionine counts as methionine, unknown residues as none."""
    name = F.when(residue == "MSE", "MET").otherwise(residue)
    return F.array(*(F.coalesce((name == r).cast("int"), F.lit(0)) for r in RESIDUES))


def residue_from_atoms(residues: DataFrame, templates: DataFrame, key: list[str]) -> DataFrame:
    """Residue names by sets of atom names. ``residues``: key, atoms (sorted array), counts (a struct of element counts);
    ``templates``: name, atoms, counts. An equal set names the residue; else, of the templates with equal counts, the one
    that shares the most atom names (the first name on ties); else null. Templates are few: one a residue kind."""
    exact = residues.join(templates.groupBy("atoms").agg(F.min("name").alias("exact")), "atoms", "left")
    t = templates.select("counts", F.struct(F.size("atoms"), "name", "atoms").alias("t"))
    near = exact.where("exact is null").join(t, "counts")
    best = near.groupBy(*key).agg(F.min(F.struct((-F.size(F.array_intersect("atoms", "t.atoms"))).alias("k"), F.col("t.name").alias("name"))).alias("b"))
    return exact.join(best, key, "left").select(*key, F.coalesce("exact", "b.name").alias("residue"))
