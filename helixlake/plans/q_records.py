"""Queries on coordinate text: it is rendered from the atom view, parsed, and transformed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators.scratch import scratch_path, written
from ..sources import structures as T
from .q_rows import ONE, plain
from .registry import on, query, r6

KEY = ("path", "line_no")
CO = "record IN ('ATOM', 'HETATM')"
COLS = "path, line_no, record, serial, atom_name, altloc, resname, chain, resseq, icode, x, y, z, occ, b, segid, element, charge"


def rec(name: str, sql: str | None, *columns: str):
    """A query on parsed records, dealt by structure once, which all windows reuse; a bare column list is completed."""

    def add(f):
        text = None if sql is None else sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {', '.join(KEY)}, {sql} FROM records"
        query(name, ("records",) if text else (), text)(on("lines")(lambda lines: (lambda d: d.select(*KEY, *columns) if columns else d)(f(T.parse_records(lines.repartition("path"))))))
        return f

    return add


@rec("SC1_parse_records", f"SELECT {COLS} FROM records WHERE {CO}")
def sc1(d):
    return d.where(R.is_coord()).select(*COLS.split(", "))


@rec("SK3_render_records", f"SELECT path, line_no, line FROM records WHERE {CO}")
def sk3(d):
    return d.where(R.is_coord()).select(*KEY, T.render(d).alias("line"))


@rec("SK4_feature_to_bfactor", f"SELECT path, line_no, f AS feature, substr(line, 1, 60) || lpad(printf('%.2f', CASE f WHEN 'fx' THEN occ * 50 ELSE occ * 25 END), 6, ' ') || substr(line, 67) AS line FROM records, (VALUES ('fx'), ('fy')) t(f) WHERE {CO}")
def sk4(d):
    own = T.feature_to_bfactor(d.where(R.is_coord()).withColumns({"fx": F.col("occ") / 2, "fy": F.col("occ") / 4}), ["fx", "fy"])
    return own.select(*KEY, "feature", T.render(own).alias("line"))


@rec("TR1_set_bfactor", f"CASE WHEN {CO} THEN 10.0::DOUBLE ELSE b END AS b", "b")
def tr1(d):
    return R.set_field(d, "b", 10.0)


@rec("TR2_set_occupancy", f"CASE WHEN {CO} THEN 0.5::DOUBLE ELSE occ END AS occ", "occ")
def tr2(d):
    return R.set_field(d, "occ", 0.5)


@rec("TR3_set_chain", f"CASE WHEN {CO} THEN 'Z' ELSE chain END AS chain", "chain")
def tr3(d):
    return R.set_field(d, "chain", "Z")


@rec("TR4_replace_chains", f"CASE WHEN {CO} AND chain = 'A' THEN 'X' WHEN {CO} AND chain = 'N' THEN 'Y' ELSE chain END AS chain", "chain")
def tr4(d):
    return R.replace_chains(d, {"A": "X", "N": "Y"})


@rec("TR5_chain_to_segid", f"CASE WHEN {CO} THEN rpad(chain, 4, ' ') ELSE segid END AS segid", "segid")
def tr5(d):
    return R.chain_to_segid(d)


@rec("TR5b_segid_to_chain", f"CASE WHEN {CO} THEN substr(trim(segid), 1, 1) ELSE chain END AS chain", "chain")
def tr5b(d):
    return R.segid_to_chain(d)


@rec("TR6_set_segid", f"CASE WHEN {CO} THEN 'PR  ' ELSE segid END AS segid", "segid")
def tr6(d):
    return R.set_field(d, "segid", "PR")


@rec("TR7_select_chain", f"SELECT path, line_no, record FROM records WHERE NOT {CO} OR chain = 'A'", "record")
def tr7(d):
    return R.select(d, "chain", ["A"])


@rec("TR8_select_model", """
WITH m AS (SELECT *, coalesce(last_value(CASE WHEN record = 'MODEL' THEN TRY_CAST(trim(substr(line, 11, 4)) AS INT) END IGNORE NULLS) OVER (PARTITION BY path
  ORDER BY line_no), 1) AS model FROM records)
SELECT path, line_no, record FROM m WHERE model = 2""", "record")
def tr8(d):
    return R.select_model(d, 2)


@rec("TR9_delocc", f"""
WITH r AS (SELECT * FROM records WHERE {CO} QUALIFY resname = first_value(resname) OVER (PARTITION BY path, resseq, chain, icode ORDER BY line_no)),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path, resseq, chain, icode, atom_name ORDER BY line_no) = 1)
SELECT path, line_no, ' ' AS altloc, resname FROM a
UNION ALL SELECT path, line_no, altloc, resname FROM records WHERE NOT {CO}""", "altloc", "resname")
def tr9(d):
    return R.delocc(d)


@rec("TR10_strip_header", "SELECT path, line_no, record FROM records WHERE record IN ('MODEL','ATOM','HETATM','ANISOU','ENDMDL','END','TER','CONECT','MASTER')", "record")
def tr10(d):
    return R.strip(d)


@rec("TR11_strip_hetero", """
SELECT path, line_no, record FROM (SELECT path, line_no, record FROM records
UNION ALL SELECT path, line_no + 1, CASE serial % 3 WHEN 0 THEN 'REMARK' WHEN 1 THEN 'ANISOU' ELSE 'SEQRES' END FROM records WHERE serial % 20 < 3)
  WHERE record IN ('MODEL', 'ATOM', 'ANISOU', 'ENDMDL', 'END', 'TER', 'CONECT', 'MASTER')""", "record")
def tr11(d):
    """Some records of other kinds stand between the lines."""
    kind = F.when(F.col("serial") % 3 == 0, "REMARK").when(F.col("serial") % 3 == 1, "ANISOU").otherwise("SEQRES")
    more = d.where("serial % 20 < 3").withColumns({"record": kind, "line_no": F.col("line_no") + 1})
    return R.strip(d.unionByName(more), hetero=True)


@rec("TR12_residue_slices", f"""
WITH p AS (SELECT path, chain, min(line_no) FILTER (resseq = 5) AS lo, max(line_no) FILTER (resseq = 9) AS hi FROM records WHERE {CO} GROUP BY ALL)
SELECT path, line_no, resseq FROM records JOIN p USING (path, chain) WHERE {CO} AND line_no BETWEEN lo AND hi""", "resseq")
def tr12(d):
    return R.residue_slices(d, [(5, 9)])


@rec("TR12b_residue_list", f"SELECT path, line_no, resseq FROM records WHERE {CO} AND resseq IN (3, 5, 8)", "resseq")
def tr12b(d):
    return R.residue_list(d, [3, 5, 8])


@rec("TR13_shave", f"SELECT path, line_no, atom_name FROM records WHERE NOT {CO} OR resseq NOT IN (1, 2, 3) OR trim(atom_name) IN ('CA', 'N', 'O', 'C')", "atom_name")
def tr13(d):
    return R.shave(d, [1, 2, 3])


@rec("TR14_renumber_atoms", f"SELECT path, line_no, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) + 99 AS INT) AS serial FROM records WHERE {CO}", "serial")
def tr14(d):
    return R.renumber_atoms(d, 100).where(R.is_coord())


@rec("TR15_renumber_residues", f"""
WITH r AS (SELECT *, CASE WHEN resseq = lag(resseq) OVER w THEN 0 ELSE 1 END AS n, CASE WHEN chain = lag(chain) OVER w THEN 0 ELSE 1 END AS t FROM records WHERE {CO}
  WINDOW w AS (PARTITION BY path ORDER BY line_no)),
q AS (SELECT *, sum(t) OVER (PARTITION BY path ORDER BY line_no) AS run FROM r)
SELECT path, line_no, CAST(sum(n) OVER (PARTITION BY path, run ORDER BY line_no) AS INT) AS resseq FROM q""", "resseq")
def tr15(d):
    return R.renumber_residues(d, 1, []).where(R.is_coord())


@rec("TR16_shift_residues", f"SELECT path, line_no, CASE WHEN chain IN ('A', 'R') THEN resseq + 10 ELSE resseq END AS resseq FROM records WHERE {CO}", "resseq")
def tr16(d):
    return R.shift_residues(d, 10, ["A", "R"]).where(R.is_coord())


@rec("TR17_tidy", f"""
WITH r AS (SELECT *, lead(chain) OVER w AS nc, lead(resseq) OVER w AS nr FROM records WHERE {CO} WINDOW w AS (PARTITION BY path ORDER BY line_no))
SELECT path, line_no, record, serial, 0 AS sub FROM r
UNION ALL SELECT path, line_no, 'TER', serial + 1, 1 FROM r WHERE nc IS NULL OR nc <> chain OR nr - resseq > 1
UNION ALL SELECT path, line_no, 'END', serial + 1, 2 FROM r WHERE nc IS NULL""", "record", "serial", "sub")
def tr17(d):
    return R.tidy(d)


@rec("TR18_gaps", f"""
WITH m AS (SELECT *, CASE WHEN line_no < 1202 THEN 1 ELSE 2 END AS model FROM records WHERE {CO} AND atom_name = ' CA '),
l AS (SELECT *, lag(model) OVER w AS pm, lag(chain) OVER w AS pc, lag(resseq) OVER w AS pr,
  sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d FROM m WINDOW w AS (PARTITION BY path ORDER BY line_no))
SELECT path, model, chain, pr AS before, resseq AS after, round(d, 6) AS distance, CASE WHEN d > 4 THEN 'break' ELSE 'sequence' END AS kind FROM l WHERE pm = model AND pc = chain
  AND (d > 4 OR pr + 1 <> resseq)""")
def tr18(d):
    return R.gaps(d).withColumn("distance", r6("distance"))


_NAMES = "CASE serial % 9 WHEN 0 THEN '1HB ' WHEN 1 THEN 'HG11' WHEN 2 THEN 'FE  ' WHEN 3 THEN 'CA  ' WHEN 4 THEN ' CA ' WHEN 5 THEN 'ZN  ' WHEN 6 THEN '2HG1' WHEN 7 THEN ' XE ' ELSE atom_name END"
_ELEMENTS = ("H", "C", "N", "O", "S", "P", "F", "FE", "ZN", "MG", "CA")


@rec("TR20_element_from_name", f"""
WITH n AS (SELECT path, line_no, record, element, {_NAMES} AS a FROM records),
g AS (SELECT *, CASE WHEN regexp_matches(substr(a, 1, 1), '[A-Za-z]')
  AND NOT regexp_matches(substr(a, 3, 2), '^[0-9]+$') THEN trim(a) WHEN regexp_matches(substr(trim(a), 1, 1), '[0-9]') THEN substr(trim(a), 2, 1) ELSE substr(trim(a), 1,
  1) END AS e FROM n)
SELECT path, line_no, CASE WHEN NOT {CO} THEN element WHEN e IN {_ELEMENTS} THEN e ELSE '' END AS element FROM g""", "element")
def tr20(d):
    return R.element_from_name(d.withColumn("atom_name", F.expr(_NAMES)), _ELEMENTS)


@rec("TR21_check_format", f"""
SELECT path, line_no, CAST(length(line) AS INT) AS length, 'altloc' AS field FROM (SELECT path, line_no, {CO} AS c, CASE WHEN {CO}
  AND altloc = 'B' THEN substr(line, 1, 16) || '#' || substr(line, 18) ELSE line END AS line FROM records) WHERE c AND substr(line, 17, 1) = '#'""")
def tr21(d):
    broken = d.withColumn("line", F.when(R.is_coord() & (F.col("altloc") == "B"), F.concat(F.substring("line", 1, 16), F.lit("#"), F.substring("line", 18, 63))).otherwise(F.col("line")))
    return R.check_format(broken)


@rec("TR22_pad_lines", "SELECT path, line_no, rpad(rtrim(line), 80, ' ') AS line FROM records", "line")
def tr22(d):
    return R.pad_lines(d.withColumn("line", F.rtrim("line")))


@rec("TR23_chain_sequences", f"""
WITH f AS (SELECT path, chain, resname, resseq, icode, min(line_no) AS k0 FROM records WHERE {CO} GROUP BY ALL),
k AS (SELECT *, {ONE.replace('residue_name', 'resname')} AS o FROM f)
SELECT path, chain, string_agg(o, '' ORDER BY k0) AS sequence FROM k GROUP BY ALL""")
def tr23(d):
    return R.chain_sequences(d)


@rec("TR24_summary", """
WITH a AS (SELECT *, lag(resname) OVER w AS pn, lag(chain) OVER w AS pc, lag(resseq) OVER w AS pr FROM records WHERE record = 'ATOM' WINDOW w AS (PARTITION BY path
  ORDER BY line_no)),
s AS (SELECT path, count(*) AS n_atoms, count(DISTINCT (atom_name, altloc, resname, chain, resseq)) AS n_unique, count(*) FILTER (pn IS NULL OR pn <> resname OR pc <> chain
  OR pr <> resseq) AS n_residues, count(*) FILTER (pc IS NULL OR pc <> chain) AS n_chains, coalesce(bool_or((pn <> resname OR pr <> resseq) AND pc = chain
  AND resseq - 1 <> pr), false) AS has_gaps, bool_or(altloc <> ' ') AS has_double, bool_or(icode <> ' ') AS has_insert FROM a GROUP BY path)
SELECT s.*, n_models, has_hetero FROM s JOIN (SELECT path, count(*) FILTER (record = 'MODEL') AS n_models, bool_or(record = 'HETATM') AS has_hetero FROM records
  GROUP BY path) USING (path)""")
def tr24(d):
    return R.summarize(d)


@rec("TR25_harmonize", f"""
SELECT path, line_no, serial FROM records l WHERE {CO} AND path % 2 = 0 AND EXISTS (SELECT 1 FROM records r WHERE r.path % 2 = 1 AND r.record IN ('ATOM', 'HETATM')
  AND r.chain = l.chain AND r.resname = l.resname AND r.resseq = l.resseq AND r.icode = l.icode AND r.atom_name = l.atom_name AND r.altloc = l.altloc)""", "serial")
def tr25(d):
    d = written(d.where(R.is_coord()).select(*KEY, "record", "serial", *_ATOM.split(", ")), "records")  # parsed once for both sides
    return R.harmonize(d.where("path % 2 = 0"), d.where("path % 2 = 1"))


_ATOM = "chain, resname, resseq, icode, atom_name, altloc"


@rec("TR26_join_models", f"""
WITH a AS (SELECT DISTINCT path AS family, path, {_ATOM} FROM records WHERE {CO}
UNION SELECT path, path + 100000, {_ATOM} FROM records WHERE {CO} AND (path % 2 = 1 OR serial % 50 <> 0)
UNION SELECT path, path + 200000, {_ATOM.replace('chain', "CASE WHEN path % 3 = 0 AND serial % 70 = 0 THEN '#' ELSE chain END")} FROM records WHERE {CO}),
m AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY path) AS model FROM (SELECT family, path, count(*) AS n FROM a GROUP BY ALL)),
r AS (SELECT family, {_ATOM} FROM a SEMI JOIN (SELECT * FROM m WHERE model = 1) USING (family, path)),
s AS (SELECT family, path, count(*) AS k FROM a SEMI JOIN r USING (family, {_ATOM}) GROUP BY ALL)
SELECT family, m.path, CAST(m.model AS INT) AS model, f.n - coalesce(k, 0) AS n_missing, m.n - coalesce(k, 0) AS n_extra, f.n = coalesce(k, 0)
  AND m.n = coalesce(k, 0) AS same_atoms FROM m JOIN (SELECT family, n FROM m WHERE model = 1) f USING (family) LEFT JOIN s USING (family, path)""")
def tr26(d):
    """Each structure with two copies of it: one without some atoms, one with some in another chain."""
    moved = F.when((F.col("path") % 3 == 0) & (F.col("serial") % 70 == 0), "#").otherwise(F.col("chain"))
    fewer = (F.col("path") % 2 == 1) | (F.col("serial") % 50 != 0)
    one = lambda more, chain: F.struct((F.col("path") + more).alias("path"), chain.alias("chain"))
    own = d.where(R.is_coord()).select(F.col("path").alias("family"), "record", *(c for c in _ATOM.split(", ") if c != "chain"), F.array_compact(F.array(one(0, F.col("chain")), F.when(fewer, one(100000, F.col("chain"))), one(200000, moved))).alias("_m"))
    return R.join_models(own.select("*", F.explode("_m").alias("_c")).select("*", "_c.*").drop("_m", "_c"), "family", dealt=True)


@rec("TR28_drop_ter", f"SELECT path, line_no, record, CASE WHEN {CO} THEN concat_ws(' ', printf('%.3f', x), printf('%.3f', y), printf('%.3f', z)) END AS xyz FROM records")
def tr28(d):
    """Each chain's last record is followed by TER; these go again."""
    ends = d.where(R.is_coord() & (F.col("serial") % 50 == 0)).withColumns({"record": F.lit("TER"), "line_no": F.col("line_no") + 1})
    return R.spaced_coordinates(R.drop_ter(d.unionByName(ends))).select(*KEY, "record", "xyz")


@rec("TR29_copy_values", f"""
WITH k AS (SELECT path, chain, resname, resseq, icode, atom_name, altloc, arg_min(b, line_no) AS rb FROM records WHERE {CO} AND serial % 3 = 0 GROUP BY ALL)
SELECT path, line_no, CASE WHEN rb IS NULL THEN 1.0::DOUBLE ELSE 1.0 END AS occ, coalesce(rb, 20.0) AS b FROM records LEFT
  JOIN k USING (path, chain, resname, resseq, icode, atom_name, altloc) WHERE {CO}""", "occ", "b")
def tr29(d):
    return R.copy_values(d, d.where("serial % 3 = 0"))


@rec("TR30_update_coordinates", f"SELECT path, line_no, -x AS x, y + 1 AS y, z AS z FROM records WHERE {CO}", "x", "y", "z")
def tr30(d):
    return R.update_coordinates(d, d.withColumns({"x": -F.col("x"), "y": F.col("y") + 1}))


@rec("TR31_prepare", f"""
WITH m AS (SELECT * FROM records WHERE line_no < 1202 AND {CO} AND chain = 'A'),
r AS (SELECT * FROM m QUALIFY resname = first_value(resname) OVER (PARTITION BY path, resseq, chain, icode ORDER BY line_no)),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path, resseq, chain, icode, atom_name ORDER BY line_no) = 1),
s AS (SELECT *, lead(resseq) OVER (PARTITION BY path ORDER BY line_no) AS nr FROM a WHERE record <> 'HETATM')
SELECT path, line_no, record, serial, 0 AS sub FROM s
UNION ALL SELECT path, line_no, 'TER', serial + 1, 1 FROM s WHERE nr IS NULL OR nr - resseq > 1
UNION ALL SELECT path, line_no, 'END', serial + 1, 2 FROM s WHERE nr IS NULL""", "record", "serial", "sub")
def tr31(d):
    return R.prepare(d, "A")


@rec("TR32_chain_list", f"SELECT path, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains, arg_min(chain, line_no) AS first_chain, count(DISTINCT (resseq, icode)) AS n_residues FROM records WHERE {CO} GROUP BY path")
def tr32(d):
    return R.chain_list(d)


@rec("TR33_complexes", f"""
WITH p AS (SELECT path // 2 AS pair, line_no, serial, CASE WHEN path % 2 = 0 THEN 'M' ELSE 'I' END AS chain, path % 2 AS side FROM records WHERE {CO})
SELECT pair AS path, CAST(row_number() OVER (PARTITION BY pair ORDER BY side, line_no) AS BIGINT) AS line_no, chain, serial FROM p""")
def tr33(d):
    own = d.where(R.is_coord()).withColumn("pair", F.expr("path div 2"))
    return R.complexes(own.where("path % 2 = 0"), own.where("path % 2 = 1"), "pair").select("path", "line_no", "chain", "serial")


@rec("TR27_split_chains", f"""
WITH m AS (SELECT *, CASE WHEN line_no < 1202 THEN '1' ELSE '2' END AS model FROM records WHERE {CO})
SELECT 'chain' AS by, path, chain AS part, count(*) AS n, max(line) AS last FROM m GROUP BY ALL
UNION ALL SELECT 'model', path, model, count(*),
max(line) FROM m GROUP BY ALL
UNION ALL SELECT 'segid', path, trim(segid),
count(*),
max(line) FROM m GROUP BY ALL""")
def tr27(d):
    """Files of chains, models and segments, read back."""
    path = scratch_path(d.sparkSession, "split")
    T.split_structures(R.with_model(d).where(R.is_coord()), path, ("chain", "model", "segid"), dealt=True)
    back = T.read_split_structures(d.sparkSession, path)
    return back.groupBy("by", F.col("path").cast("long").alias("path"), "part").agg(F.count("*").alias("n"), F.max("value").alias("last"))


_MODEL = "CASE WHEN line_no < 1202 THEN 1 ELSE 2 END"


@rec("TR32b_first_altloc", f"SELECT path, line_no, altloc FROM records WHERE {CO} QUALIFY row_number() OVER (PARTITION BY path, {_MODEL}, chain, resseq, icode, atom_name ORDER BY line_no) = 1")
def tr32b(d):
    return R.first_altloc(d).where(R.is_coord()).select(*KEY, "altloc")


@rec("TR32c_first_insertion", f"SELECT path, line_no, icode FROM records WHERE {CO} QUALIFY icode = first_value(icode) OVER (PARTITION BY path, {_MODEL}, chain, resseq ORDER BY line_no)")
def tr32c(d):
    return R.first_insertion(d).where(R.is_coord()).select(*KEY, "icode")


@rec("TR32d_residue_labels", f"SELECT path, chain, concat(resseq, trim(icode)) AS label, resname, min(line_no) AS first FROM records WHERE {CO} GROUP BY ALL")
def tr32d(d):
    return R.residue_labels(d, names=True)


@rec("TR33b_tidy_and_split", f"""
WITH p AS (SELECT path // 2 AS pair, path, path % 2 AS side, line_no, serial, resseq FROM records WHERE {CO}),
o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY side, line_no) AS k FROM p),
n AS (SELECT *, lead(side) OVER w AS ns, lead(resseq) OVER w AS nr FROM o WINDOW w AS (PARTITION BY pair ORDER BY k))
SELECT pair AS path, count(*) FILTER (side = 0) AS n_m, count(*) FILTER (side = 1) AS n_i, count(*) FILTER (ns IS NULL OR ns <> side OR nr - resseq > 1) AS n_ter FROM n
  GROUP BY ALL""")
def tr33b(d):
    """Complexes are tidied, and split into their sides again."""
    own = d.where(R.is_coord()).withColumn("pair", F.expr("path div 2"))
    tidy = R.tidy(R.complexes(own.where("path % 2 = 0"), own.where("path % 2 = 1"), "pair"))
    m, i = (side.groupBy("path").agg(F.count("*").alias(n)) for side, n in zip(R.split_complex(tidy), ("n_m", "n_i"), strict=True))
    ter = tidy.groupBy("path").agg(F.count_if(F.col("record") == "TER").alias("n_ter"))
    return ter.join(m, "path", "left").join(i, "path", "left").select("path", F.coalesce("n_m", F.lit(0)).alias("n_m"), F.coalesce("n_i", F.lit(0)).alias("n_i"), "n_ter")
