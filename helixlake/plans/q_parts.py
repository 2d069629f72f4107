"""Queries on the further forms of operators: shares, slices, lookups, pairs, progress and ordered samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import geometry as G
from ..operators import hierarchy as H
from ..operators import interact as I
from ..operators import records as R
from ..operators.scratch import written
from ..sources import structures as T
from .q_hierarchy import split_sql
from .q_interact import _BSA
from .q_records import CO
from .q_rows import ONE, plain
from .registry import on, query, r6

_NUMBER, _LIST = H.named_shares(0.7), H.named_shares([0.5, 0.3, 0.2])


@plain("W8b_split_by_number", split_sql("c", "s", list(_NUMBER.items())), "domains")
def w8b(d):
    return H.cluster_split(d, ["c"], ["s"], 0.7)


@plain("W8c_split_by_list", split_sql("c", "s", list(_LIST.items())), "domains")
def w8c(d):
    return H.cluster_split(d, ["c"], ["s"], [0.5, 0.3, 0.2])


@plain("J16b_chain_representatives", """
WITH c AS (SELECT pdb, first_chain AS chain, min(interface_id) AS least FROM contacts GROUP BY ALL),
e AS (SELECT pdb, chain, CAST(least % 3 AS BIGINT) AS entity FROM c WHERE least < 6),
k AS (SELECT DISTINCT pdb, entity, CAST((pdb + entity) % 400 AS BIGINT) AS cluster, pdb * 10 + entity AS rank FROM e WHERE (pdb + entity) % 17 > 0),
p AS (SELECT c.pdb, c.chain, e.entity, k.cluster, k.rank FROM c LEFT JOIN e USING (pdb, chain) LEFT JOIN k ON k.pdb = c.pdb AND k.entity = e.entity),
h AS (SELECT cluster, pdb AS rp, chain AS rc FROM p WHERE cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY rank, pdb, entity, chain) = 1)
SELECT pdb, chain, entity, p.cluster, rp AS representative_pdb, rc AS representative_chain, coalesce(pdb = rp AND chain = rc, false) AS is_representative
FROM p LEFT JOIN h ON h.cluster = p.cluster""", "contacts")
def j16b(c):
    chains = c.groupBy("pdb", F.col("first_chain").alias("chain")).agg(F.min("interface_id").alias("least"))
    entities = chains.where("least < 6").select("pdb", "chain", (F.col("least") % 3).cast("long").alias("entity"))
    both = F.col("pdb") + F.col("entity")
    clusters = entities.where(both % 17 > 0).select("pdb", "entity", (both % 400).cast("long").alias("cluster"), (F.col("pdb") * 10 + F.col("entity")).alias("rank")).distinct()
    return H.chain_representatives(chains, entities, clusters)


@plain("HI5b_stored_residues", """
WITH s AS (SELECT cath_domain, residue_id FROM atoms WHERE element = 'F' AND atom_name = 'CA')
SELECT cath_domain, serial_number, (cath_domain, residue_id) IN (SELECT (cath_domain, residue_id) FROM s) AS truth FROM atoms""", "atoms")
def hi5b(a):
    """The residues of a structure's sites are stored as one text, and read from there."""
    sites = a.where("element = 'F' and atom_name = 'CA'").groupBy("cath_domain").agg(F.array_join(F.array_sort(F.collect_set("residue_id")), ", ").alias("residues"))
    return H.truth_from_list(a, sites).select("cath_domain", "serial_number", "truth")


@plain("ST1b_natural_keys", """
SELECT cath_domain, serial_number, chain AS prefix, CAST(residue_id AS DOUBLE) AS number, concat(element, ' ', ss) AS suffix FROM atoms
""", "atoms")
def st1b(a):
    text = F.concat(F.lit("  "), "chain", F.lit("  -"), "residue_id", F.lit(" "), "element", F.lit("   "), F.col("ss"))
    k = H.natural_key("text")
    return a.withColumn("text", text).select("cath_domain", "serial_number", k["prefix"].alias("prefix"), k["number"].alias("number"), k["suffix"].alias("suffix"))


@query("PF15b_residue_of", ("records",), f"""
WITH r AS (SELECT * FROM records WHERE {CO}),
n AS (SELECT path, chain, coalesce(
   arg_min(struct_pack(h := record = 'HETATM', i := icode), line_no) FILTER (record = 'ATOM' AND icode = ' '), arg_min(struct_pack(h := record = 'HETATM', i := icode), line_no)) AS w FROM r WHERE resseq = 22 GROUP BY ALL)
SELECT 'number' AS asked, r.path, line_no FROM r JOIN n ON n.path = r.path AND n.chain = r.chain WHERE resseq = 22 AND (record = 'HETATM') = w.h AND icode = w.i
UNION ALL SELECT 'text', path, line_no FROM r WHERE record = 'ATOM' AND resseq = 22 AND icode = 'A'
UNION ALL SELECT 'key', path, line_no FROM r WHERE record = 'HETATM' AND resseq = 22 AND icode = ' '""")
@on("lines")
def pf15b(lines):
    d = written(T.parse_records(lines).select("path", "chain", "record", "resseq", "icode", "line_no"), "records")  # parsed once for all labels
    one = lambda asked, label: P.residue_of(d, label).select(F.lit(asked).alias("asked"), "path", "line_no")
    return one("number", 22).unionByName(one("text", "22A")).unionByName(one("key", ("H", 22, " ")))


@query("PF14b_file_gate", ("lines",), """
WITH c AS (SELECT path, count(DISTINCT substr(line, 22, 1)) AS n FROM lines WHERE line LIKE 'ATOM%' OR line LIKE 'HETATM%' GROUP BY path)
SELECT path, path % 10 = 5 AS empty, path % 10 = 4 AS gzipped, CAST(CASE WHEN path % 10 IN (4, 5) THEN 0 ELSE n END AS INTEGER) AS n_chains,
 path % 10 NOT IN (4, 5) AND n = 1 AS valid FROM c""")
@on("lines")
def pf14b(lines):
    """Whole files as bytes: some empty, some that begin as gzip data does."""
    text = lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").cast("binary").alias("content"))
    kind = F.col("path") % 10
    return P.validate_files(text.withColumn("content", F.when(kind == 5, F.lit(b"")).when(kind == 4, F.concat(F.unhex(F.lit("1F8B08")), "content")).otherwise(F.col("content"))))


_SLICES = [(3, 12), (20, 41)]


@query("TR31b_prepare_slices", ("records",), f"""
WITH m AS (SELECT * FROM records WHERE line_no < 1202 AND {CO} AND chain = 'A'),
r AS (SELECT * FROM m QUALIFY resname = first_value(resname) OVER (PARTITION BY path, resseq, chain, icode ORDER BY line_no)),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path, resseq, chain, icode, atom_name ORDER BY line_no) = 1),
h AS (SELECT * FROM a WHERE record <> 'HETATM'),
b AS (SELECT path, {", ".join(f"min(line_no) FILTER (resseq = {lo}) AS lo{k}, max(line_no) FILTER (resseq = {hi}) AS hi{k}" for k, (lo, hi) in enumerate(_SLICES))} FROM h GROUP BY path),
c AS (SELECT h.* FROM h JOIN b USING (path) WHERE {" OR ".join(f"coalesce(line_no BETWEEN lo{k} AND hi{k}, false)" for k in range(len(_SLICES)))}),
s AS (SELECT *, lead(resseq) OVER (PARTITION BY path ORDER BY line_no) AS nr FROM c),
o AS (SELECT path, line_no, record, serial, 0 AS sub FROM s UNION ALL SELECT path, line_no, 'TER', serial + 1, 1 FROM s WHERE nr IS NULL OR nr - resseq > 1
 UNION ALL SELECT path, line_no, 'END', serial + 1, 2 FROM s WHERE nr IS NULL)
SELECT *, 'model 1;chain A;delocc;striphet;slices 3-12,20-41;tidy;rename Q' AS steps FROM o""")
@on("lines")
def tr31b(lines):
    d = R.prepare(T.parse_records(lines.repartition("path")), "A", slices=_SLICES, rename="Q", steps=True)
    return d.select("path", "line_no", "record", "serial", "sub", F.array_join("prep_steps", ";").alias("steps"))


@plain("AG16b_first_of_pairs", """
WITH f AS (SELECT CASE WHEN first_res % 7 = 0 THEN NULL ELSE first_res % 7 END AS a, second_res % 7 AS b, count(*) AS n FROM contacts GROUP BY ALL)
SELECT a, b, n FROM f QUALIFY row_number() OVER (PARTITION BY least(coalesce(a, -1), b), greatest(coalesce(a, -1), b) ORDER BY a NULLS FIRST, b) = 1""", "contacts")
def ag16b(c):
    """Counts of ordered pairs of families, of which each unordered pair keeps the first."""
    f = c.groupBy(F.when(F.col("first_res") % 7 != 0, F.col("first_res") % 7).alias("a"), (F.col("second_res") % 7).alias("b")).agg(F.count("*").alias("n"))
    return I.first_of_pairs(f, "a", "b", ["a", "b"])


@plain("AG17b_class_counts", f"""
WITH s AS (SELECT 'observed' AS status, {_BSA} AS cls FROM (SELECT c2_asa AS b FROM contacts) UNION ALL SELECT 'inferred', {_BSA} FROM (SELECT c2_asa / 2 AS b FROM contacts)),
c AS (SELECT status, cls, count(*) AS n FROM s GROUP BY ALL)
SELECT status, cls, n, round(n / sum(n) OVER (PARTITION BY status), 6) AS share FROM c""", "contacts")
def ag17b(c):
    both = c.select(F.lit("observed").alias("status"), F.col("c2_asa").alias("area")).unionByName(c.select(F.lit("inferred").alias("status"), (F.col("c2_asa") / 2).alias("area")))
    return I.class_counts(both.withColumn("cls", I.interaction_class(F.col("area"))), "cls", "status").withColumn("share", r6("share"))


@plain("J19b_face_jaccard", "WITH " + ", ".join(f"""
f{k} AS (SELECT pdb, round(count(*) FILTER (m AND r) / count(*), 6) AS face{k} FROM (SELECT pdb, {c}, bool_or(distance < 0.05) AS m, bool_or(distance > 0.02) AS r FROM contacts
  WHERE distance < 0.05 OR distance > 0.02 GROUP BY ALL) GROUP BY pdb)""" for k, c in ((1, "first_res"), (2, "second_res"))) + " SELECT pdb, face1, face2 FROM f1 FULL JOIN f2 USING (pdb)", "contacts")
def j19b(c):
    return I.face_jaccard(c.where("distance < 0.05"), c.where("distance > 0.02"), "pdb").select("pdb", r6("face1").alias("face1"), r6("face2").alias("face2"))


@plain("AG18b_interface_progress", """
WITH e AS (SELECT pdb, count(DISTINCT interface_id) AS num_interfaces FROM contacts GROUP BY pdb),
p AS (SELECT pdb, count(DISTINCT interface_id) FILTER (first_chain <> 'A') AS n_ddi, count(DISTINCT interface_id) FILTER (distance < 0.08) AS n_lli, count(DISTINCT interface_id) FILTER (score < 0.06) AS n_residues FROM contacts GROUP BY pdb)
SELECT pdb, num_interfaces, n_ddi, n_lli, n_residues, n_ddi = num_interfaces AS ddi_done, n_lli = num_interfaces AS lli_done, n_residues = num_interfaces AS residues_done,
 n_ddi = num_interfaces AND n_lli = num_interfaces AND n_residues = num_interfaces AS done FROM e JOIN p USING (pdb)""", "contacts")
def ag18b(c):
    expected = c.groupBy("pdb").agg(F.count_distinct("interface_id").alias("num_interfaces"))
    return A.interface_progress(expected, {"ddi": c.where("first_chain <> 'A'"), "lli": c.where("distance < 0.08"), "residues": c.where("score < 0.06")})


@plain("AG24b_pairwise_metrics", """
SELECT pdb, second_chain, """ + ", ".join(f"max({m}) FILTER (first_chain = '{r}') AS {r}_{m}" for r in "ANR" for m in ("distance", "score")) + " FROM contacts GROUP BY ALL", "contacts")
def ag24b(c):
    return A.wide_pairs(c, ["pdb", "second_chain"], "first_chain", ["distance", "score"], ["A", "N", "R"])


def _sample_sql(order: str) -> str:
    place = "first" if order == "file" else "residue_id"
    return f"""
SELECT '{order}' AS residue_order, cath_domain, string_agg(residue_id, ',' ORDER BY {place}) AS residues, string_agg(letter, '' ORDER BY first) AS sequence,
 round(sum(cx), 6) AS x, count(cx) AS n_ca, round(sum(b), 6) AS bfactor FROM r GROUP BY cath_domain"""


@plain("AG8b_ordered_samples", f"""
WITH r AS (SELECT cath_domain, residue_id, min(serial_number) AS first, arg_min({ONE}, serial_number) AS letter, arg_min(x, serial_number) FILTER (atom_name = 'CA') AS cx,
  avg(bfactor) FILTER (atom_name IN ('N', 'CA', 'C', 'O')) AS b FROM atoms GROUP BY ALL)
{_sample_sql("file")} UNION ALL {_sample_sql("lexical")}""", "atoms")
def ag8b(a):
    out = None
    for order in ("file", "lexical"):
        s = A.ordered_samples(a, ["bfactor"], order=order)
        ca = F.filter(F.transform("coordinates", lambda x: x[1][0]), lambda v: ~F.isnan(v))
        add = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
        b = F.filter(F.transform("features", lambda f: f[0]), lambda v: v.isNotNull())
        one = s.select(F.lit(order).alias("residue_order"), "cath_domain", F.array_join("residues", ",").alias("residues"), "sequence", r6(add(ca)).alias("x"), F.size(ca).cast("long").alias("n_ca"), r6(add(b)).alias("bfactor"))
        out = one if out is None else out.unionByName(one)
    return out


def _square():
    return sum(((F.col(c) - 132.0) ** 2 for c in "xyz"), F.lit(0.0))


@plain("GE5b_rotations_keep_shape", """
SELECT cath_domain, k AS rotation, count(*) AS n, true AS same_norms, true AS proper, true AS turned FROM atoms, range(2) r(k) GROUP BY ALL""", "atoms")
def ge5b(a):
    """What a rotation must keep: the mean square from the centre of each structure, and the sense of its axes."""
    turns = G.random_rotations(a.select("cath_domain").distinct(), 2)
    still = G.rotate_each(a.select("cath_domain", "x", "y", "z"), turns.select("cath_domain", "rotation", *(F.lit(float(i == j)).alias(f"m{i}{j}") for i in range(3) for j in range(3))))
    moved = G.rotate_each(a.select("cath_domain", "x", "y", "z"), turns)
    mean = lambda df, n: df.groupBy("cath_domain", "rotation").agg(F.count("*").alias("n"), F.avg(_square()).alias(n))
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    out = mean(moved, "after").join(mean(still, "before").drop("n"), ["cath_domain", "rotation"]).join(turns, ["cath_domain", "rotation"])
    return out.select("cath_domain", F.col("rotation").cast("long").alias("rotation"), "n", (F.abs(F.col("after") - F.col("before")) < 1e-2).alias("same_norms"), (F.abs(det - 1) < 1e-6).alias("proper"), (F.abs(m[0][0] + m[1][1] + m[2][2] - 3) > 1e-6).alias("turned"))


@plain("GE7c_axes_properties", """
SELECT cath_domain, count(*) AS n, true AS same_variance, true AS longest_first, true AS uncorrelated FROM atoms GROUP BY cath_domain""", "atoms")
def ge7c(a):
    """What principal axes must do: the variances fall from axis to axis, add up to those before, and axes are uncorrelated."""
    turned = G.rotate_each(a.select("cath_domain", "x", "y", "z"), G.principal_axes(a), 0.0)
    after = turned.groupBy("cath_domain").agg(F.count("*").alias("n"), *(F.var_pop(c).alias(f"v{c}") for c in "xyz"), *(F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in ("xy", "xz", "yz")))
    before = a.groupBy("cath_domain").agg(sum((F.var_pop(c) for c in "xyz"), F.lit(0.0)).alias("total"))
    near = lambda x, y: F.abs(x - y) < 1e-2
    falling = (F.col("vx") >= F.col("vy") - 1e-2) & (F.col("vy") >= F.col("vz") - 1e-2)
    apart = near(F.col("cxy"), F.lit(0.0)) & near(F.col("cxz"), F.lit(0.0)) & near(F.col("cyz"), F.lit(0.0))
    return after.join(before, "cath_domain").select("cath_domain", "n", near(F.col("vx") + F.col("vy") + F.col("vz"), F.col("total")).alias("same_variance"), falling.alias("longest_first"), apart.alias("uncorrelated"))
