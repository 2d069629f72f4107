"""Queries on filters, features, roll-ups and windows over the atom view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalog import BIOLOGICAL, KD, MODIFIED, OCTANAL, RESIDUE_RADII, RESIDUES, THREE_TO_ONE, one_letter
from ..operators import aggregates as A
from ..operators import features as X
from ..operators import filters as P
from ..operators import hierarchy as H
from ..operators import interact as I
from .registry import on, query, r6


def case(mapping: dict, col: str, other: str) -> str:
    """The same lookup as SQL."""
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items()) + f" ELSE {other} END"


ONE = case(THREE_TO_ONE | MODIFIED, "residue_name", "'X'")


def plain(name: str, sql: str, *views: str):
    def add(f):
        query(name, views, sql)(on(*views)(f))
        return f

    return add


@plain("SC2_scan_domain_prefix", "SELECT cath_domain, cath_code, domain_length FROM domains WHERE cath_code || '.' LIKE '2.%'", "domains")
def sc2(d):
    return P.filter_codes(d, ["2"]).select("cath_domain", "cath_code", "domain_length")


@plain("PF1_select_features", "SELECT cath_domain, serial_number, atom_name, residue_id, residue_name, chain, charge, vdw_radii, bfactor FROM atoms", "atoms")
def pf1(a):
    return P.select_features(a, ["charge", "vdw_radii"], ["bfactor"])


_FLAGS = {"hydrophobic_atom": "('C', 'A')", "aromatic_atom": "('A')", "hbond_acceptor": "('NA', 'NS', 'OA', 'OS', 'SA')", "hbond_donor": "('HS', 'HD')", "metal": "('MG', 'ZN', 'MN', 'CA', 'FE')"}
_TYPED = "(SELECT *, CASE element WHEN 'N' THEN 'NA' WHEN 'O' THEN 'OA' WHEN 'H' THEN 'HD' WHEN 'P' THEN 'ZN' ELSE element END AS t FROM atoms)"


def typed(a):
    kind = F.when(F.col("element") == "N", "NA").when(F.col("element") == "O", "OA").when(F.col("element") == "H", "HD").when(F.col("element") == "P", "ZN").otherwise(F.col("element"))
    return a.withColumn("atom_type", kind)


@plain("PF2_feature_preset", f"""
WITH d AS (SELECT cath_domain, count(*) AS n, {' + '.join(f'count(*) FILTER (t IN {v})' for v in _FLAGS.values())} AS deep, count(*) FILTER (ss IN ('H', 'B', 'E', 'G', 'I', 'T',
  'S')) AS letters FROM {_TYPED} GROUP BY ALL)
SELECT cath_domain, preset, CAST(CASE preset WHEN 'only_aa' THEN 21 WHEN 'only_atom' THEN 23 WHEN 'use_deepsite' THEN 5 WHEN 'both' THEN 26 WHEN 'structure' THEN 10 END AS INT) AS n_columns, CAST(CASE preset WHEN 'only_aa' THEN n WHEN 'only_atom' THEN n WHEN 'use_deepsite' THEN deep WHEN 'both' THEN n + deep WHEN 'structure' THEN n + letters END AS DOUBLE) AS total FROM d, (VALUES ('only_aa'), ('only_atom'), ('use_deepsite'), ('both'), ('structure')) t(preset)""", "atoms")
def pf2(a):
    """How many columns a choice has, and the sum of all their values in a structure."""
    full = X.pharmacophore(X.atom_types(X.residue_one_hot(X.secondary_structure(typed(a)))))
    choices = {n: X.preset_columns(n) for n in ("only_aa", "only_atom", "use_deepsite", "both")} | {"structure": [c for c in X.preset_columns("coarse") if c in X.COLUMNS["structure"]]}
    sums = full.groupBy("cath_domain").agg(*(F.sum(sum((F.col(c) for c in cols[1:]), F.col(cols[0]))).alias(n) for n, cols in choices.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("preset"), F.lit(len(cols)).alias("n_columns"), F.col(n).alias("total")) for n, cols in choices.items())))
    return sums.select("cath_domain", rows.alias("r")).select("cath_domain", "r.*")


@plain("PF3_filter_atoms", "SELECT cath_domain, serial_number, atom_name FROM atoms WHERE atom_name IN ('N', 'CA', 'C', 'O') AND serial_number NOT IN (2, 3)", "atoms")
def pf3(a):
    return P.filter_atoms(P.filter_atoms(a, include=["N", "CA", "C", "O"], by="atom_name"), exclude=[2, 3]).select("cath_domain", "serial_number", "atom_name")


@plain("PF4_surface_atoms", "SELECT cath_domain, serial_number, residue_rasa FROM atoms WHERE NOT residue_rasa < 0.2", "atoms")
def pf4(a):
    return P.surface(X.thresholds(a, ["residue_buried"])).select("cath_domain", "serial_number", "residue_rasa")


@plain("PF5_equality_query", "SELECT DISTINCT cath_domain, residue_id FROM atoms WHERE chain = 'A' AND element = 'C'", "atoms")
def pf5(a):
    return P.filter_table(a, ["cath_domain", "residue_id"], True, chain="A", element="C")


@plain("PF6_code_prefixes", "SELECT cath_domain, cath_code FROM domains WHERE (starts_with(cath_code || '.', '1.') OR starts_with(cath_code || '.', '2.2.')) AND NOT starts_with(cath_code || '.', '1.1.')", "domains")
def pf6(d):
    return P.filter_codes(d, ["1", "2.2"], ["1.1"]).select("cath_domain", "cath_code")


@plain("PF9_rows_at_level", "SELECT DISTINCT array_to_string(string_split(cath_code, '.')[1:3], '.') AS cath_code FROM domains", "domains")
def pf9(d):
    """Of the nodes of all levels those of the third."""
    return P.at_level(H.build_nodes(d), 3).select("cath_code")


@plain("PF10_bio_interfaces", "SELECT pdb, interface_id, first_res, second_res, score FROM contacts WHERE first_chain = 'A' AND score >= 0", "contacts")
def pf10(c):
    return I.bio_interfaces(c, "first_chain", "A", "score").select("pdb", "interface_id", "first_res", "second_res", "score")


@plain("PF11_drop_obsolete", "SELECT pdb, first_res, second_res FROM contacts WHERE pdb NOT IN (SELECT cath_domain FROM domains WHERE c = 0)", "contacts", "domains")
def pf11(c, d):
    return P.drop_keys(c, d.where("c = 0").select(F.col("cath_domain").alias("pdb")), "pdb").select("pdb", "first_res", "second_res")


@plain("PF13_ca_model", "SELECT cath_domain, bool_and(atom_name = 'CA') AS is_ca_model FROM atoms GROUP BY cath_domain", "atoms")
def pf13(a):
    return P.is_ca_model(a)


@plain("PF14_input_gate", "SELECT cath_domain, count(*) AS n_atoms, count(DISTINCT chain) AS n_chains, count(DISTINCT chain) = 1 AS valid FROM atoms GROUP BY cath_domain", "atoms")
def pf14(a):
    return P.validate_structures(a)


@plain("PF15_unfold_residues", "SELECT cath_domain, serial_number, residue_id FROM atoms WHERE (cath_domain, residue_id) IN (SELECT (cath_domain, residue_id) FROM atoms WHERE element = 'F' AND atom_name = 'CA')", "atoms")
def pf15(a):
    return P.unfold_residues(a, a.where("element = 'F' and atom_name = 'CA'")).select("cath_domain", "serial_number", "residue_id")


@plain("FD1_thresholds", "SELECT cath_domain, serial_number, CAST(charge < 0 AS DOUBLE) AS neg_charge, CAST(charge > 0 AS DOUBLE) AS pos_charge, CAST(residue_rasa < 0.2 AS DOUBLE) AS residue_buried FROM atoms", "atoms")
def fd1(a):
    return X.thresholds(a).select("cath_domain", "serial_number", "neg_charge", "pos_charge", "residue_buried")


@plain("FD2_default_fill", "SELECT cath_domain, serial_number, CASE WHEN element = 'F' THEN 9.0::DOUBLE ELSE charge END AS v, 2.5::DOUBLE AS cx FROM atoms", "atoms")
def fd2(a):
    holes = a.withColumn("v", F.when(F.col("element") == "F", F.lit(float("nan"))).otherwise(F.col("charge")))
    return X.fill_defaults(holes, {"v": 9.0, "cx": 2.5}, replace_na=True).select("cath_domain", "serial_number", "v", "cx")


_RARE = "CASE WHEN serial_number % 17 = 0 THEN 'ZN' WHEN serial_number % 19 = 0 THEN 'BR' WHEN serial_number % 23 = 0 THEN 'XX' ELSE element END"


@plain("FD4_element_one_hot", "SELECT cath_domain, serial_number, " + ", ".join(f"CAST(e = '{e}' AS DOUBLE) AS {e}_elem" for e in X.ELEMENTS) + f", CAST(e = 'XX' AS DOUBLE) AS Unk_elem, nullif(e, 'XX') AS back FROM (SELECT cath_domain, serial_number, {_RARE} AS e FROM atoms)", "atoms")
def fd4(a):
    hot = X.element_features(a.withColumn("element", F.expr(_RARE)))
    return hot.select("cath_domain", "serial_number", *(f"{e}_elem" for e in X.ELEMENTS), "Unk_elem", X.element_of(hot).alias("back"))


@plain("FD5_radii", f"SELECT cath_domain, serial_number, vdw_radii AS vdw, CAST({case(RESIDUE_RADII, 'residue_name', '3.0')} AS DOUBLE) AS residue_radius FROM atoms", "atoms")
def fd5(a):
    return X.radii(a).select("cath_domain", "serial_number", "vdw", "residue_radius")


@plain("FD6_charge_by_residue", """
WITH p AS (SELECT cath_domain, serial_number, charge * 2 AS q, residue_rasa - 0.3::DOUBLE AS e FROM atoms WHERE element <> 'F'),
r AS (SELECT cath_domain, residue_id, round(sum(q), 6) AS charge, round(sum(e), 6) AS electrostatic_potential FROM atoms LEFT JOIN p USING (cath_domain, serial_number)
  GROUP BY ALL)
SELECT *, CAST(charge < 0 AS DOUBLE) AS neg_charge, CAST(charge > 0 AS DOUBLE) AS pos_charge, CAST(electrostatic_potential < 0 AS DOUBLE) AS is_electronegative FROM r""", "atoms")
def fd6(a):
    by = ["cath_domain", "serial_number"]
    table = a.where("element != 'F'").select(*by, (F.col("charge") * 2).alias("charge"), (F.col("residue_rasa") - 0.3).alias("electrostatic_potential"))
    own = X.electrostatics(a.drop("charge"), table, by)
    out = A.roll_up(own, {"charge": "sum", "electrostatic_potential": "sum"})
    return X.charge_flags(out.withColumns({"charge": r6("charge"), "electrostatic_potential": r6("electrostatic_potential")}))


@plain("FD7_concavity_by_residue", "SELECT cath_domain, residue_id, round(avg(bfactor / 40), 6) AS cx, CAST(round(avg(bfactor / 40), 6) <= 2 AS DOUBLE) AS is_concave FROM atoms GROUP BY ALL", "atoms")
def fd7(a):
    out = A.roll_up(a.withColumn("cx", F.col("bfactor") / 40), {"cx": "mean"}).withColumn("cx", r6("cx"))
    return X.thresholds(out, ["is_concave"])


@plain("FD8_hydrophobicity", f"WITH k AS (SELECT cath_domain, serial_number, {ONE} AS o FROM atoms) SELECT cath_domain, serial_number, " + ", ".join(f"CAST({case(m, 'o', 'NULL')} AS DOUBLE) AS {n}" for n, m in (("kd", KD), ("biological", BIOLOGICAL), ("octanal", OCTANAL))) + f", CAST(coalesce({case(KD, 'o', 'NULL')} > 0, false) AS DOUBLE) AS is_hydrophobic FROM k", "atoms")
def fd8(a):
    out = X.hydrophobicity(a)
    plain_null = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("kd", "biological", "octanal")}
    return out.withColumns(plain_null).select("cath_domain", "serial_number", "kd", "biological", "octanal", "is_hydrophobic")


@plain("FD9_surface_area", "SELECT cath_domain, serial_number, residue_rasa * 100 AS atom_asa, residue_rasa, CAST(residue_rasa < 0.2 AS DOUBLE) AS residue_buried FROM atoms", "atoms")
def fd9(a):
    return X.thresholds(a.withColumn("atom_asa", F.col("residue_rasa") * 100), ["residue_buried"]).select("cath_domain", "serial_number", "atom_asa", "residue_rasa", "residue_buried")


@plain("FD10_residue_one_hot", "SELECT cath_domain, serial_number, " + ", ".join(f"CAST(residue_name = '{r}' AS DOUBLE) AS {r}" for r in RESIDUES) + ", CAST(residue_name = 'UNK' AS DOUBLE) AS Unk_residue FROM atoms", "atoms")
def fd10(a):
    return X.residue_one_hot(a).select("cath_domain", "serial_number", *RESIDUES, "Unk_residue")


_LETTERS = {"a": "H", "b": "B", "e": "E", "g": "G", "i": "I", "t": "T", "s": "S"}


@plain("FD11_secondary_structure", f"""
SELECT cath_domain, serial_number, CAST(ss IN ('G','H') AS DOUBLE) AS is_helix, CAST(ss IN ('B','E') AS DOUBLE) AS is_sheet, CAST(ss NOT IN ('G','H','B','E') AS DOUBLE) AS Unk_SS,
  {', '.join(f"CAST(ss = '{v}' AS DOUBLE) AS is_{k}" for k, v in _LETTERS.items())} FROM atoms""", "atoms")
def fd11(a):
    return X.secondary_structure(a).select("cath_domain", "serial_number", *X.COLUMNS["structure"])


@plain("FD12_pharmacophore", """
SELECT cath_domain, serial_number, CAST(t IN ('C','A') AS DOUBLE) AS hydrophobic_atom, CAST(t = 'A' AS DOUBLE) AS aromatic_atom,
  CAST(t IN ('NA','NS','OA','OS','SA') AS DOUBLE) AS hbond_acceptor, CAST(t IN ('HS','HD') AS DOUBLE) AS hbond_donor, CAST(t IN ('MG','ZN','MN','CA','FE') AS DOUBLE) AS metal
  FROM (SELECT *, CASE element WHEN 'N' THEN 'NA' WHEN 'O' THEN 'OA' WHEN 'H' THEN 'HD' WHEN 'P' THEN 'ZN' ELSE element END AS t FROM atoms)""", "atoms")
def fd12(a):
    kind = F.when(F.col("element") == "N", "NA").when(F.col("element") == "O", "OA").when(F.col("element") == "H", "HD").when(F.col("element") == "P", "ZN").otherwise(F.col("element"))
    return X.pharmacophore(a.withColumn("atom_type", kind)).select("cath_domain", "serial_number", "hydrophobic_atom", "aromatic_atom", "hbond_acceptor", "hbond_donor", "metal")


@plain("FD13_conservation", """
WITH e AS (SELECT cath_domain, residue_id, max(residue_rasa) AS entropy FROM atoms WHERE element = 'C' GROUP BY ALL),
r AS (SELECT DISTINCT cath_domain, residue_id FROM atoms)
SELECT cath_domain, residue_id, coalesce(entropy, 1.0) AS entropy, CAST(coalesce(entropy, 1.0) < 0.5 AS DOUBLE) AS is_conserved FROM r LEFT JOIN e USING (cath_domain, residue_id)""", "atoms")
def fd13(a):
    by = ["cath_domain", "residue_id"]
    e = a.where("element = 'C'").groupBy(*by).agg(F.max("residue_rasa").alias("entropy"))
    return X.conservation(a.select(*by).distinct(), e, by)


@plain("FD14_frustration", """
SELECT cath_domain, serial_number, f AS frustration_index, CAST(f <= -1 AS DOUBLE) AS is_highly_frustrated, CAST(f >= 0.78 AS DOUBLE) AS is_minimally_frustrated, CAST(f >= -1
  AND f <= 0.78 AS DOUBLE) AS has_neutral_frustration FROM (SELECT *, charge * 40 AS f FROM atoms)""", "atoms")
def fd14(a):
    return X.thresholds(a.withColumn("frustration_index", F.col("charge") * 40)).select("cath_domain", "serial_number", "frustration_index", "is_highly_frustrated", "is_minimally_frustrated", "has_neutral_frustration")


@plain("FD16_docking_scores", """
SELECT cath_domain, serial_number, CASE WHEN l THEN 1.0::DOUBLE WHEN residue_rasa < 0.5 THEN -15.0 ELSE 1.0 END AS simple,
  CASE WHEN residue_rasa < 0.5 THEN 12.25::DOUBLE ELSE 3.5 END AS zdock, CASE WHEN l THEN 0.0::DOUBLE ELSE charge END AS zdock_charge FROM (SELECT *, cath_domain % 2 = 1 AS l
  FROM atoms)""", "atoms")
def fd16(a):
    """Every second structure is a ligand."""
    both = X.docking_scores(a.where("cath_domain % 2 = 0")).unionByName(X.docking_scores(a.where("cath_domain % 2 = 1"), ligand=True))
    return both.select("cath_domain", "serial_number", "simple", "zdock", "zdock_charge")


@plain("FD17_truth_vectors", "SELECT cath_domain, serial_number, CASE WHEN residue_id IN ('3', '7', '11') THEN '0.0,1.0' ELSE '1.0,0.0' END AS truth FROM atoms", "atoms")
def fd17(a):
    return X.truth_vectors(a, F.col("residue_id").isin("3", "7", "11")).select("cath_domain", "serial_number", F.array_join(F.col("truth").cast("array<string>"), ",").alias("truth"))


@plain("FD18_structure_arithmetic", "SELECT cath_domain, serial_number, round(x + bfactor, 6) AS x_sum, round(x - bfactor, 6) AS x_diff, round(x / bfactor, 6) AS x_ratio, round(abs(x - bfactor), 6) AS x_abs FROM atoms", "atoms")
def fd18(a):
    by = ["cath_domain", "serial_number"]
    out = X.arithmetic(a.select(*by, "x"), a.select(*by, F.col("bfactor").alias("x")), by, ["x"])
    return out.select(*by, *(r6(c).alias(c) for c in ("x_sum", "x_diff", "x_ratio", "x_abs")))


@plain("FD20_one_letter", f"SELECT residue_name, {ONE} AS code, count(*) AS n FROM atoms GROUP BY ALL", "atoms")
def fd20(a):
    return a.groupBy("residue_name").agg(F.first(one_letter(F.col("residue_name"))).alias("code"), F.count("*").alias("n"))


_ROBUST = "m AS (SELECT avg(bfactor) AS m FROM atoms), d AS (SELECT median(abs(bfactor - m)) AS mad FROM atoms, m), r AS (SELECT avg(bfactor) AS mean, stddev_pop(bfactor) AS std FROM atoms, m, d WHERE 0.6745 * (bfactor - m) / mad <= 3.5)"


@plain("FD22_normalised_bfactor", f"WITH {_ROBUST} SELECT cath_domain, serial_number, round((bfactor - mean) / std, 6) AS bfactor_norm FROM atoms, r", "atoms")
def fd22(a):
    return X.normalised_bfactor(a, A.robust_stats(a)).select("cath_domain", "serial_number", r6("bfactor_norm").alias("bfactor_norm"))


@plain("FD24_id_parts", "SELECT cath_domain, serial_number, CAST(cath_domain AS VARCHAR) AS pdb, CAST(residue_id AS INT) AS resseq, '' AS icode FROM atoms", "atoms")
def fd24(a):
    return X.id_parts(a).select("cath_domain", "serial_number", "pdb", "resseq", "icode")


@plain("AG5_residue_centres", "SELECT cath_domain, residue_id, round(avg(bfactor), 6) AS bfactor, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM atoms GROUP BY ALL", "atoms")
def ag5(a):
    out = A.residue_centres(a)
    return out.select("cath_domain", "residue_id", *(r6(c).alias(c) for c in ("bfactor", "x", "y", "z")))


@plain("AG6_roll_up_by_rule", "SELECT cath_domain, residue_id, round(sum(charge), 6) AS charge, max(vdw_radii) AS vdw_radii, min(residue_rasa) AS residue_rasa, round(avg(bfactor), 6) AS bfactor FROM atoms GROUP BY ALL", "atoms")
def ag6(a):
    out = A.roll_up(a, {"charge": "sum", "vdw_radii": "max", "residue_rasa": "min", "bfactor": "mean"})
    return out.withColumns({"charge": r6("charge"), "bfactor": r6("bfactor")})


@plain("AG6b_copy_down", "SELECT cath_domain, serial_number, max(vdw_radii) OVER (PARTITION BY cath_domain, residue_id) AS vdw_radii FROM atoms", "atoms")
def ag6b(a):
    return A.copy_down(a, A.roll_up(a, {"vdw_radii": "max"}), ["vdw_radii"]).select("cath_domain", "serial_number", "vdw_radii")


@plain("AG7_sequence", f"""
WITH k AS (SELECT cath_domain, serial_number, {ONE} AS o, residue_id, lag(residue_id) OVER (PARTITION BY cath_domain ORDER BY serial_number) AS p FROM atoms)
SELECT cath_domain, string_agg(o, '' ORDER BY serial_number) AS sequence FROM k WHERE p IS NULL OR p <> residue_id GROUP BY cath_domain""", "atoms")
def ag7(a):
    return A.sequences(a)


@plain("AG8_backbone", "WITH b AS (SELECT * FROM atoms WHERE atom_name IN ('N','CA','C','O')) SELECT cath_domain, residue_id, min(serial_number) AS first, " + ", ".join(f"arg_min({c}, serial_number) FILTER (atom_name = '{n}') AS {n.lower()}_{c}" for n in ("N", "CA", "C", "O") for c in "xyz") + ", round(avg(bfactor), 6) AS bfactor FROM b GROUP BY ALL", "atoms")
def ag8(a):
    out = A.backbone(a, ["bfactor"])
    return out.select("cath_domain", "residue_id", "first", *(F.col(f"{n}.{c}").alias(f"{n.lower()}_{c}") for n in ("N", "CA", "C", "O") for c in "xyz"), r6("bfactor").alias("bfactor"))


@plain("AG9_robust_bfactor", """
WITH m AS (SELECT avg(bfactor) AS m FROM atoms),
d AS (SELECT median(abs(bfactor - m)) AS mad FROM atoms, m)
SELECT round(avg(bfactor), 6) AS mean, round(stddev_pop(bfactor), 6) AS std, count(*) AS n FROM atoms, m, d WHERE 0.6745 * (bfactor - m) / mad <= 3.5""", "atoms")
def ag9(a):
    return A.robust_stats(a).select(r6("mean").alias("mean"), r6("std").alias("std"), "n")


@plain("AG10_min_max", "SELECT cath_domain, serial_number, round(CASE WHEN max(x) OVER w = min(x) OVER w THEN 0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS x FROM atoms WINDOW w AS (PARTITION BY cath_domain)", "atoms")
def ag10(a):
    return A.min_max(a, ["x"]).select("cath_domain", "serial_number", r6("x").alias("x"))


@plain("AG11_z_scores", "SELECT cath_domain, serial_number, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 5) AS x_z FROM atoms WINDOW w AS (PARTITION BY cath_domain)", "atoms")
def ag11(a):
    return A.z_scores(a, ["x"]).select("cath_domain", "serial_number", F.round("x_z", 5).alias("x_z"))


@plain("AG18_completeness", """
WITH p AS (SELECT DISTINCT cath_domain, 'a' AS part FROM atoms
UNION SELECT DISTINCT cath_domain, 'b' FROM atoms WHERE element = 'C'
UNION SELECT DISTINCT cath_domain, 'c' FROM atoms WHERE bfactor > 104)
SELECT cath_domain, count(*) AS n_parts, count(*) = 3 AS complete FROM p GROUP BY ALL""", "atoms")
def ag18(a):
    return A.completeness({"atom": a, "residue": a.where("element = 'C'"), "edge": a.where("bfactor > 104")})


@plain("W1_run_ids", """
SELECT cath_domain, serial_number, CAST(sum(n) OVER (PARTITION BY cath_domain ORDER BY serial_number) - 1 AS BIGINT) AS run_id FROM (SELECT *,
  CASE WHEN ss = lag(ss) OVER (PARTITION BY cath_domain ORDER BY serial_number) THEN 0 ELSE 1 END AS n FROM atoms)""", "atoms")
def w1(a):
    return A.run_ids(a, "ss", "cath_domain", "serial_number").select("cath_domain", "serial_number", "run_id")


@plain("W5_first_per_key", "SELECT cath_domain, residue_id, serial_number, element FROM atoms QUALIFY row_number() OVER (PARTITION BY cath_domain, residue_id ORDER BY serial_number) = 1", "atoms")
def w5(a):
    return A.first_per_key(a, ["cath_domain", "residue_id"], ["serial_number"]).select("cath_domain", "residue_id", "serial_number", "element")


@plain("AG24_wide_metrics", "SELECT cath_domain, max(CASE WHEN chain = 'A' THEN bfactor END) AS A_bfactor, max(CASE WHEN chain = 'N' THEN bfactor END) AS N_bfactor, max(CASE WHEN chain = 'R' THEN bfactor END) AS R_bfactor FROM atoms GROUP BY ALL", "atoms")
def ag24(a):
    return A.wide(a, "cath_domain", "chain", ["bfactor"], ["A", "N", "R"])


@plain("FD13b_conservation_grades", "SELECT cath_domain, residue_id, CASE WHEN g % 10 <> 0 THEN (g % 10 - 1) / 8.0::DOUBLE END AS score FROM (SELECT DISTINCT cath_domain, residue_id, CAST(residue_id AS INT) AS g FROM atoms)", "atoms")
def fd13b(a):
    g = F.col("residue_id").cast("int") % 10
    rows = a.select("cath_domain", "residue_id").distinct().withColumn("grade", F.when(g == 0, " .").otherwise(g.cast("string")))
    score = X.conservation_grade(F.col("grade"))
    return rows.select("cath_domain", "residue_id", F.when(~F.isnan(score), score).alias("score"))


@plain("FD18b_scalar_arithmetic", "SELECT cath_domain, serial_number, round(charge + 2.5, 6) AS charge_sum, round(charge - 2.5, 6) AS charge_diff, round(charge / 2.5, 6) AS charge_ratio, round(abs(charge), 6) AS charge_abs FROM atoms", "atoms")
def fd18b(a):
    out = X.scalar_arithmetic(a, ["charge"], 2.5)
    return out.select("cath_domain", "serial_number", *(r6(f"charge_{n}").alias(f"charge_{n}") for n in ("sum", "diff", "ratio", "abs")))


@plain("FD15b_pharmacophore_preset", f"SELECT cath_domain, serial_number, {', '.join(f'CAST(t IN {v} AS DOUBLE) AS {k}' for k, v in _FLAGS.items())}, CAST(residue_name = 'ALA' AS DOUBLE) AS ALA FROM {_TYPED}", "atoms")
def fd15b(a):
    """A preset, and then one feature of another group."""
    return X.preset(X.preset(typed(a), "pharmacophore"), "all", update=("ALA",)).select("cath_domain", "serial_number", *_FLAGS, "ALA")
