"""Queries on interaction tables over the contact, segment and atom views, and on payloads made of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import interact as I
from .q_rows import ONE, plain
from .registry import digest, digest_sql, query, r6
from .views import tables

_SITES = "residues AS (SELECT DISTINCT pdb, chain, nstart + 3 AS res FROM segments UNION SELECT DISTINCT pdb, chain, nstop + 7 FROM segments)"


def residues(s):
    return s.select("pdb", "chain", (F.col("nstart") + 3).alias("res")).union(s.select("pdb", "chain", F.col("nstop") + 7)).distinct()


@plain("J7_map_numbers", """
WITH n AS (SELECT DISTINCT pdb, chain, nstart AS label, nstart * 2 AS number FROM segments)
SELECT s.pdb, s.chain, s.nstart AS start_label, s.nstop AS stop_label, s.cath_domain, a.number AS start_number, b.number AS stop_number FROM segments s JOIN n a ON a.pdb = s.pdb
  AND a.chain = s.chain AND a.label = s.nstart JOIN n b ON b.pdb = s.pdb AND b.chain = s.chain AND b.label = s.nstop""", "segments")
def j7(s):
    n = s.select("pdb", "chain", F.col("nstart").alias("label"), (F.col("nstart") * 2).alias("number")).distinct()
    return I.map_ranges(s.select("pdb", "chain", F.col("nstart").alias("start_label"), F.col("nstop").alias("stop_label"), "cath_domain"), n)


_J8_D = (["pdb", "chain"], ["res", "cath_domain"], ["res"])


@plain("J8_residues_in_domains", f"WITH {_SITES} {digest_sql('SELECT r.pdb, r.chain, r.res, s.cath_domain FROM residues r JOIN segments s ON r.pdb = s.pdb AND r.chain = s.chain AND r.res BETWEEN s.nstart AND s.nstop', *_J8_D)}", "segments")
def j8(s):
    return digest(I.residues_in_domains(residues(s), s), *_J8_D)


@plain("J8b_loop_residues", f"WITH {_SITES} SELECT pdb, chain, res FROM residues r WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE r.pdb = s.pdb AND r.chain = s.chain AND r.res BETWEEN s.nstart AND s.nstop)", "segments")
def j8b(s):
    return I.loop_residues(residues(s), s)


_MEMBERS = "members AS (SELECT DISTINCT pdb, first_res AS res, first_res % 9 AS dom FROM contacts UNION SELECT DISTINCT pdb, second_res, second_res % 9 FROM contacts)"


@plain("J9_contact_domains", f"""
WITH {_MEMBERS} SELECT c.pdb, c.first_res, c.second_res, c.distance, a.dom AS first_dom, b.dom AS second_dom FROM contacts c JOIN members a ON a.pdb = c.pdb AND a.res = c.first_res
  JOIN members b ON b.pdb = c.pdb AND b.res = c.second_res""", "contacts")
def j9(c):
    m = c.select("pdb", F.col("first_res").alias("res")).union(c.select("pdb", "second_res")).distinct().withColumn("dom", F.col("res") % 9)
    return I.contact_domains(c.select("pdb", "first_res", "second_res", "distance"), m)


@plain("J10_loop_domain_contacts", f"""
WITH {_MEMBERS} SELECT c.pdb, c.first_res, c.second_res, a.dom AS first_dom, b.dom AS second_dom FROM contacts c JOIN members a ON a.pdb = c.pdb AND a.res = c.first_res
  JOIN members b ON b.pdb = c.pdb AND b.res = c.second_res WHERE (a.dom = 0) <> (b.dom = 0)""", "contacts")
def j10(c):
    return j9(c).where("(first_dom = 0) != (second_dom = 0)").select("pdb", "first_res", "second_res", "first_dom", "second_dom")


@plain("J11_nearest_domains", f"""
WITH {_SITES}, d AS (SELECT r.pdb, r.chain, r.res, s.cath_domain, least(abs(s.nstart - r.res),
abs(r.res - s.nstop)) AS distance, s.nstart, s.nstop FROM residues r JOIN segments s ON r.pdb = s.pdb AND r.chain = s.chain),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY pdb, chain, res
  ORDER BY distance, cath_domain, nstart, nstop) AS INT) AS rank, min(distance) OVER (PARTITION BY pdb, chain, res) AS m FROM d)
SELECT pdb, chain, res, cath_domain, distance, rank FROM k WHERE rank = 1 OR (rank = 2 AND distance = m)""", "segments")
def j11(s):
    return I.nearest_domains(residues(s), s, ["pdb", "chain", "res"])


@plain("J12_expand_members", """
WITH r AS (SELECT DISTINCT pdb, chain, nstart AS number, concat('L', nstart) AS label FROM segments WHERE chain IN ('A', 'N')),
m AS (SELECT DISTINCT pdb FROM segments),
e AS (SELECT pdb, unnest(['A', 'R', 'N']) AS chain FROM m)
SELECT e.pdb, e.chain, a.number, coalesce(b.label, a.label) AS label FROM e JOIN r a ON a.pdb = e.pdb AND a.chain = 'A' LEFT JOIN r b ON b.pdb = e.pdb AND b.chain = e.chain
  AND b.number = a.number""", "segments")
def j12(s):
    r = s.where("chain in ('A', 'N')").select("pdb", "chain", F.col("nstart").alias("number"), F.concat(F.lit("L"), F.col("nstart").cast("string")).alias("label")).distinct()
    return I.expand_members(r, s.select("pdb", F.lit("A").alias("rep_chain"), F.lit("A,R,N").alias("member_chains")).distinct())


@plain("J13_best_overlap", """
WITH o AS (SELECT pdb, chain, cath_domain AS o_cath_domain, nstart + 5 AS o_nstart, nstop + 5 AS o_nstop FROM segments WHERE nseg <= 3),
l AS (SELECT pdb, chain, cath_domain, nstart, nstop FROM segments),
k AS (SELECT *, least(nstop, o_nstop) - greatest(nstart, o_nstart) + 1 AS overlap FROM l JOIN o USING (pdb, chain))
SELECT pdb, chain, cath_domain, nstart, nstop, o_cath_domain, o_nstart, o_nstop, overlap, round(overlap / (least(nstop - nstart, o_nstop - o_nstart) + 1), 6) AS share FROM k
  WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY pdb, chain, cath_domain, nstart, nstop ORDER BY overlap DESC, o_cath_domain, o_nstart, o_nstop) = 1""", "segments")
def j13(s):
    o = s.where("nseg <= 3").withColumns({"nstart": F.col("nstart") + 5, "nstop": F.col("nstop") + 5})
    return I.best_overlap(s.select("pdb", "chain", "cath_domain", "nstart", "nstop"), o).withColumn("share", r6("share"))


_BSA = "CASE WHEN b >= 0 AND b < 1500 THEN 'weak transient' WHEN b >= 1500 AND b < 2500 THEN 'transient' WHEN b >= 2500 THEN 'permanent' ELSE 'unknown' END"


@plain("AG14_buried_area", f"SELECT pdb, interface_id, first_res, second_res, round(b, 6) AS bsa, {_BSA} AS ppi_type FROM (SELECT *, c1_asa + c2_asa - complex_asa AS b FROM contacts)", "contacts")
def ag14(c):
    return I.buried_area(c).select("pdb", "interface_id", "first_res", "second_res", r6("bsa").alias("bsa"), "ppi_type")


@plain("J14_AG15_inferred_area", f"""
WITH o AS (SELECT second_res, avg(c1_asa) AS face1_obs, avg(c2_asa) AS bsa_obs FROM contacts WHERE score > 0.02 GROUP BY ALL),
j AS (SELECT c.pdb, c.interface_id, c.first_res, c.second_res, c2_asa, face1_obs, bsa_obs, c1_asa AS face1, c2_asa AS face2, complex_asa AS mol_asa FROM contacts c LEFT
  JOIN o USING (second_res)),
r AS (SELECT *, CASE WHEN face1_obs + face2 > 0 THEN (face1 + face2) / (face1_obs + face2) ELSE 0 END AS ratio FROM j),
q AS (SELECT *, bsa_obs * ratio AS b FROM r)
SELECT pdb, interface_id, first_res, second_res, round(ratio, 6) AS ratio, round(b, 6) AS bsa, {_BSA} AS ppi_type FROM q""", "contacts")
def ag15(c):
    o = c.where("score > 0.02").groupBy("second_res").agg(F.avg("c1_asa").alias("face1_obs"), F.avg("c2_asa").alias("bsa_obs"))
    j = c.join(o, "second_res", "left").withColumns({"face1": F.col("c1_asa"), "face2": F.col("c2_asa"), "mol_asa": F.col("complex_asa")})
    return I.inferred_area(j).select("pdb", "interface_id", "first_res", "second_res", r6("ratio").alias("ratio"), r6("bsa").alias("bsa"), "ppi_type")


@plain("AG12_binding_sites", """
WITH l AS (SELECT pdb, first_res % 20 AS first_dom, second_res % 20 AS second_dom, string_agg(DISTINCT CAST(first_res AS VARCHAR), ','
  ORDER BY CAST(first_res AS VARCHAR)) AS first_resi, string_agg(DISTINCT CAST(second_res AS VARCHAR), ',' ORDER BY CAST(second_res AS VARCHAR)) AS second_resi FROM contacts
  GROUP BY ALL)
SELECT *, false AS reverse FROM l
UNION ALL SELECT pdb, second_dom, first_dom, second_resi, first_resi, true FROM l""", "contacts")
def ag12(c):
    own = c.select("pdb", (F.col("first_res") % 20).alias("first_dom"), (F.col("second_res") % 20).alias("second_dom"), F.col("first_res").cast("string").alias("first_res"), F.col("second_res").cast("string").alias("second_res"))
    return I.binding_sites(own, ["pdb", "first_dom", "second_dom"])


@plain("AG13_merge_ranges", """
SELECT pdb, chain, string_agg(CAST(nstart AS VARCHAR), ',' ORDER BY cath_domain, nstart, nstop) AS starts, string_agg(CAST(nstop AS VARCHAR), ','
  ORDER BY cath_domain, nstart, nstop) AS stops FROM segments GROUP BY ALL""", "segments")
def ag13(s):
    return I.merge_ranges(s, ["pdb", "chain"], "nstart", "nstop", "cath_domain")


@plain("AG16_family_sizes", "WITH f AS (SELECT CASE WHEN first_res % 7 = 0 THEN -1 ELSE first_res % 7 END AS a, second_res % 7 AS b FROM contacts) SELECT least(a, b) AS family1, greatest(a, b) AS family2, count(*) AS n FROM f GROUP BY ALL", "contacts")
def ag16(c):
    f = c.select(F.when(F.col("first_res") % 7 != 0, F.col("first_res") % 7).alias("a"), (F.col("second_res") % 7).alias("b"))
    return I.family_sizes(f, "a", "b")


@plain("AG17_class_transitions", f"""
WITH t AS (SELECT {_BSA.replace('b ', 'x ')} AS o, {_BSA.replace('b ', 'y ')} AS i FROM (SELECT c2_asa AS x, c2_asa / 2 AS y FROM contacts))
SELECT concat(o, '->', i) AS transition, count(*) AS n FROM t GROUP BY ALL""", "contacts")
def ag17(c):
    t = c.withColumns({"o": I.interaction_class(F.col("c2_asa")), "i": I.interaction_class(F.col("c2_asa") / 2)})
    return I.class_transitions(t, "o", "i")


@plain("AG19_cluster_metrics", "SELECT first_chain, count(DISTINCT (first_res, second_res)) AS n_pairs, count(DISTINCT second_res) AS n_families FROM contacts GROUP BY ALL", "contacts")
def ag19(c):
    return I.cluster_metrics(c, ["first_chain"], "first_res", "second_res")


@plain("AG22_distinct_residues", "SELECT pdb, count(DISTINCT first_res) AS n_first, count(DISTINCT second_res) AS n_second FROM contacts GROUP BY ALL", "contacts")
def ag22(c):
    return I.distinct_residues(c)


@plain("AG23_site_sequences", f"WITH s AS (SELECT cath_domain, chain, string_agg({ONE}, '' ORDER BY serial_number) AS sequence FROM atoms WHERE atom_name = 'CA' GROUP BY ALL) SELECT * FROM s", "atoms")
def ag23(a):
    names = F.transform(F.sort_array(F.collect_list(F.struct("serial_number", "residue_name"))), lambda v: v["residue_name"])
    return I.site_sequences(a.where("atom_name = 'CA'").groupBy("cath_domain", "chain").agg(F.array_join(names, ",").alias("resn"))).select("cath_domain", "chain", "sequence")


@plain("J18_faces_covered", """
WITH f1 AS (SELECT DISTINCT second_chain AS pair, first_res FROM contacts WHERE first_res % 2 = 0),
f2 AS (SELECT DISTINCT second_chain AS pair, second_res FROM contacts WHERE second_res % 2 = 0),
c AS (SELECT second_chain AS pair, first_chain AS copy, first_res, second_res FROM contacts),
k AS (SELECT DISTINCT pair, copy FROM c),
s AS (SELECT k.pair, k.copy, (SELECT count(DISTINCT c.first_res) FROM c JOIN f1 ON f1.pair = c.pair AND f1.first_res = c.first_res WHERE c.pair = k.pair
  AND c.copy = k.copy) / (SELECT count(*) FROM f1 WHERE f1.pair = k.pair) AS share1, (SELECT count(DISTINCT c.second_res) FROM c JOIN f2 ON f2.pair = c.pair
  AND f2.second_res = c.second_res WHERE c.pair = k.pair AND c.copy = k.copy) / (SELECT count(*) FROM f2 WHERE f2.pair = k.pair) AS share2 FROM k)
SELECT pair, copy, round(share1, 6) AS share1, round(share2, 6) AS share2 FROM s WHERE share1 >= 0.5 AND share2 >= 0.5 QUALIFY row_number() OVER (PARTITION BY pair
  ORDER BY copy) = 1""", "contacts")
def j18(c):
    own = c.select(F.col("second_chain").alias("pair"), F.col("first_chain").alias("copy"), "first_res", "second_res")
    out = I.faces_covered(own, own.where("first_res % 2 = 0").select("pair", "first_res"), own.where("second_res % 2 = 0").select("pair", "second_res"), ["pair"], "copy")
    return out.select("pair", "copy", r6("share1").alias("share1"), r6("share2").alias("share2"))


@plain("J19_common_contacts", """
WITH r AS (SELECT DISTINCT pdb, first_res, second_res FROM contacts),
m AS (SELECT DISTINCT pdb, first_res, second_res FROM contacts WHERE distance < 0.05)
SELECT r.pdb, round(count(m.pdb) / count(*), 6) AS fnat FROM r LEFT JOIN m ON m.pdb = r.pdb AND m.first_res = r.first_res AND m.second_res = r.second_res GROUP BY r.pdb""", "contacts")
def j19(c):
    return I.common_contacts(c.where("distance < 0.05"), c, "pdb").withColumn("fnat", r6("fnat"))


@plain("J21_merge_streams", "WITH a AS (SELECT first_res AS k, count(*) * 1.0::DOUBLE AS v FROM contacts WHERE first_res % 2 = 0 GROUP BY ALL), b AS (SELECT first_res AS k, max(distance) AS v FROM contacts WHERE first_res % 3 = 0 GROUP BY ALL) SELECT coalesce(a.k, b.k) AS key, coalesce(a.v, 0) AS \"left\", coalesce(b.v, 0) AS \"right\" FROM a FULL JOIN b ON a.k = b.k", "contacts")
def j21(c):
    a = c.where("first_res % 2 = 0").groupBy(F.col("first_res").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return I.merge_streams(a, c.where("first_res % 3 = 0").groupBy(F.col("first_res").alias("key")).agg(F.max("distance").alias("value")), "key")


@plain("TK3_best_neighbour", "SELECT pdb, first_res, second_res, score FROM contacts QUALIFY row_number() OVER (PARTITION BY pdb ORDER BY score DESC, first_res, second_res, interface_id, distance) = 1", "contacts")
def tk3(c):
    from ..operators.aggregates import first_per_key

    return first_per_key(c, ["pdb"], [F.desc("score"), "first_res", "second_res", "interface_id", "distance"]).select("pdb", "first_res", "second_res", "score")


@plain("AG21_best_hits", "SELECT pdb, first_chain, max(score) AS best, min(distance) AS e_value FROM contacts GROUP BY ALL", "contacts")
def ag21(c):
    return c.groupBy("pdb", "first_chain").agg(F.max("score").alias("best"), F.min("distance").alias("e_value"))


@plain("CL8_neighbour_lists", """
WITH b AS (SELECT pdb, first_res AS res, second_res AS other FROM contacts
UNION SELECT pdb, second_res, first_res FROM contacts)
SELECT pdb, res, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours FROM b GROUP BY ALL""", "contacts")
def cl8(c):
    return I.neighbour_lists(c).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@plain("J6_features_by_key", "WITH f AS (SELECT cath_domain, serial_number, charge * 2 AS charge2 FROM atoms WHERE element <> 'F') SELECT cath_domain, serial_number, x, charge2 FROM atoms JOIN f USING (cath_domain, serial_number)", "atoms")
def j6(a):
    f = a.where("element != 'F'").select("cath_domain", "serial_number", (F.col("charge") * 2).alias("charge2"))
    return a.select("cath_domain", "serial_number", "x").join(f, ["cath_domain", "serial_number"])


@plain("J22_features_of_residues", "SELECT cath_domain, serial_number, residue_id FROM atoms SEMI JOIN (SELECT DISTINCT cath_domain, residue_id FROM atoms WHERE bfactor > 104) USING (cath_domain, residue_id)", "atoms")
def j22(a):
    return P.unfold_residues(a, a.where("bfactor > 104")).select("cath_domain", "serial_number", "residue_id")


@query("JS1_interfaces", (), "SELECT event_id, CAST(user_id AS INT) AS interface_id, event_type AS chain1, 'B' AS chain2, CASE WHEN value > 50 THEN 'bio' ELSE 'xtal' END AS interface_type FROM events")
def js1(spark, sf):
    e = tables(spark, sf)["events"]
    score = F.array(F.struct(F.lit("other").alias("method"), F.lit("x").alias("callName")), F.struct(F.lit("eppic").alias("method"), F.when(F.col("value") > 50, "bio").otherwise("xtal").alias("callName")))
    raw = F.to_json(F.array(F.struct(F.col("user_id").alias("interfaceId"), F.col("event_type").alias("chain1"), F.lit("B").alias("chain2"), F.struct(score.alias("interfaceScore")).alias("interfaceScores"))))
    return I.parse_interfaces(e.select("event_id", raw.alias("raw")), "raw").select("event_id", "interface_id", "chain1", "chain2", "interface_type")


@query("JS2_sequences", (), "SELECT event_id, unnest(['A', 'B']) AS chain, CAST(user_id AS INT) AS number, event_type AS label FROM events")
def js2(spark, sf):
    e = tables(spark, sf)["events"]
    info = F.array(F.struct(F.col("user_id").alias("residueNumber"), F.col("event_type").alias("pdbResidueNumber")), F.struct(F.lit(0).cast("long").alias("residueNumber"), F.lit(None).cast("string").alias("pdbResidueNumber")))
    raw = F.to_json(F.array(F.struct(F.lit("A").alias("repChain"), F.lit("A,B").alias("memberChains"), info.alias("residueInfos"))))
    return I.parse_sequences(e.select("event_id", raw.alias("raw")), "raw")


@query("JS3_residue_listing", (), "SELECT event_id, event_type AS chain, CAST(user_id AS INT) AS number, concat(user_id + 1, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE '' END) AS label FROM events")
def js3(spark, sf):
    e = tables(spark, sf)["events"]
    res = F.array(F.struct(F.col("user_id").alias("residue_number"), (F.col("user_id") + 1).alias("author_residue_number"), F.when(F.col("user_id") % 2 == 0, "A").otherwise(" ").alias("author_insertion_code")))
    raw = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("event_type").alias("chain_id"), res.alias("residues"))).alias("chains"))).alias("molecules")))
    return I.parse_listing(e.select("event_id", raw.alias("raw")), "raw")


@query("JS4_stringify", (), "SELECT event_id, CAST(user_id AS VARCHAR) AS pdb_id, event_type FROM events")
def js4(spark, sf):
    return I.stringify(tables(spark, sf)["events"].select("event_id", F.col("user_id").alias("pdb_id"), "event_type"))


@query("JS5_payload_state", (), "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'html' WHEN 1 THEN 'busy' WHEN 2 THEN 'hollow' WHEN 3 THEN 'broken' ELSE 'ok' END AS state FROM events")
def js5(spark, sf):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "<html></html>").when(k == 1, "Too many submissions").when(k == 2, '[{"uid": 3}]').when(k == 3, '{"a": ').otherwise(F.col("props"))
    return I.payload_state(tables(spark, sf)["events"].select("event_id", raw.alias("raw")), "raw").select("event_id", "state")


@query("SC9_service_payload", (), "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def sc9(spark, sf):
    return tables(spark, sf)["events"].select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@plain("AG21b_best_hits_wide", "SELECT pdb, coalesce(max(score) FILTER (first_chain = 'A'), 0) AS A, coalesce(max(score) FILTER (first_chain = 'N'), 0) AS N, coalesce(max(score) FILTER (first_chain = 'R'), 0) AS R FROM contacts GROUP BY pdb", "contacts")
def ag21b(c):
    return I.best_hits(c, "pdb", "first_chain", "score", ["A", "N", "R"])


@plain("AG23b_site_atoms", "WITH s AS (SELECT DISTINCT cath_domain, residue_id FROM atoms WHERE bfactor > 104) SELECT cath_domain, serial_number, residue_id FROM atoms SEMI JOIN s USING (cath_domain, residue_id)", "atoms")
def ag23b(a):
    """The atoms of sites that are given as comma-joined residues."""
    sites = a.where("bfactor > 104").groupBy("cath_domain").agg(F.array_join(F.collect_set("residue_id"), ",").alias("resi"))
    return I.site_atoms(a, sites).select("cath_domain", "serial_number", "residue_id")


@query("SC9b_contact_payload", (), "SELECT event_id, CAST(user_id AS INT) AS first_res, CAST(user_id + k AS INT) AS second_res, event_type AS first_type, k = 2 AS is_clash, value AS distance, CAST(k AS INT) AS n_atoms FROM events, (VALUES (1), (2)) t(k)")
def sc9b(spark, sf):
    """A payload with two contacts an event."""
    one = lambda k: F.struct(F.col("user_id").cast("int").alias("firstResNumber"), (F.col("user_id") + k).cast("int").alias("secondResNumber"), F.col("event_type").alias("firstResType"), F.lit(k == 2).alias("isClash"), F.col("value").alias("minDistance"), F.lit(k).alias("numAtoms"))
    e = tables(spark, sf)["events"].select("event_id", F.to_json(F.array(one(1), one(2))).alias("payload"))
    return I.parse_contacts(e, "payload").select("event_id", "first_res", "second_res", "first_type", "is_clash", "distance", "n_atoms")
