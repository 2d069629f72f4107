"""Queries on the hierarchy, datasets and splits over the domain view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import filters as P
from ..operators import hierarchy as H
from ..sources import structures as T
from .q_rows import plain

_NODES = """
nodes AS (SELECT DISTINCT array_to_string(string_split(cath_code, '.')[1:k], '.') AS cath_code, CAST(k AS INT) AS level,
  CASE WHEN k > 1 THEN array_to_string(string_split(cath_code, '.')[1:k - 1], '.') END AS parent_code FROM domains, generate_series(1, 4) g(k))"""


def split_sql(scope: str, key: str, shares: list[tuple[str, float]], source: str = "domains") -> str:
    """The closed form of the split rule, cut by cut."""
    last = shares[-1][0]
    first_null = " AND ".join(f"{k} IS NOT NULL" for k in key.split(", "))
    out = [f"tot AS (SELECT {scope}, count(*) AS rws FROM {source} GROUP BY {scope})", f"s0 AS (SELECT *, count(*) OVER (PARTITION BY {scope}) AS grp FROM (SELECT {scope}, {key}, count(*) AS n FROM {source} WHERE {first_null} GROUP BY {scope}, {key}) JOIN tot USING ({scope}))"]
    picks = []
    for i, (name, p) in enumerate(shares[:-1]):
        lo, hi = p - 0.01, p + 0.01
        out.append(f"f{i} AS (SELECT *, sum(n) OVER w / rws AS f, row_number() OVER w AS j, count(*) OVER (PARTITION BY {scope}) AS m, CAST(floor(grp * {p}::DOUBLE) AS BIGINT) AS k0 FROM s{i} WINDOW w AS (PARTITION BY {scope} ORDER BY {key}))")
        out.append(f"""
c{i} AS (SELECT {scope}, max(m) AS m, max(k0) AS k0, coalesce(max(f) FILTER (j <= k0), 0) AS f0, coalesce(max(j) FILTER (j < k0
  AND f <= {hi}), 0) AS dn, coalesce(max(f) FILTER (j < k0 AND f <= {hi}), 0) AS fd, min(j) FILTER (j >= k0 AND f >= {lo}) AS u, min(f) FILTER (j >= k0 AND f >= {lo}) AS fu
  FROM f{i} GROUP BY {scope})""")
        out.append(f"""
k{i} AS (SELECT {scope}, CASE WHEN f0 >= {lo} AND f0 <= {hi} THEN least(k0, m) WHEN f0 > {hi} AND k0 > m THEN m WHEN f0 > {hi} THEN
  CASE WHEN fd >= {lo} THEN dn ELSE dn + 1 END WHEN u IS NULL THEN m ELSE CASE WHEN fu <= {hi} THEN u ELSE u - 1 END END AS cut FROM c{i})""")
        picks.append(f"SELECT {scope}, {key}, n, '{name}' AS split FROM f{i} JOIN k{i} USING ({scope}) WHERE j <= cut")
        out.append(f"s{i + 1} AS (SELECT {scope}, {key}, n, rws, grp FROM f{i} JOIN k{i} USING ({scope}) WHERE j > cut)")
    picks.append(f"SELECT {scope}, {key}, n, '{last}' AS split FROM s{len(shares) - 1}")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(picks)


_THREE = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


@plain("HI1_nodes", f"WITH {_NODES} SELECT *, '/' || replace(cath_code, '.', '/') AS h5_key FROM nodes", "domains")
def hi1(d):
    return H.build_nodes(d)


@plain("HI2_attach_domains", "SELECT cath_code, count(*) AS n, min(domain_length) AS shortest, max(domain_length) AS longest FROM domains GROUP BY ALL", "domains")
def hi2(d):
    return H.attach_domains(d)


@plain("HI3_expand_codes", f"WITH {_NODES} SELECT cath_code, level FROM nodes WHERE level = 4 AND starts_with(cath_code || '.', '2.') AND NOT starts_with(cath_code || '.', '2.2.')", "domains")
def hi3(d):
    return H.expand(H.build_nodes(d), ["2"], ["2.2"]).select("cath_code", "level")


@plain("HI4_dataset_view", "SELECT cath_domain, cath_code FROM domains WHERE cath_domain IN (SELECT min(cath_domain) FROM domains GROUP BY cath_code, s)", "domains")
def hi4(d):
    reps = d.groupBy("cath_code", "s").agg(F.min("cath_domain").alias("cath_domain"))
    return H.dataset_view(d, representatives=reps).select("cath_domain", "cath_code")


@plain("HI5_truth_from_list", "SELECT cath_domain, CAST(i AS VARCHAR) IN ('1', '5', '9') AS truth FROM domains", "domains")
def hi5(d):
    return d.withColumn("sites", F.lit("1,5,9")).select("cath_domain", F.array_contains(F.split("sites", ","), F.col("i").cast("string")).alias("truth"))


@plain("HI4b_dataset_split", f"WITH t AS (SELECT * FROM ({split_sql('cath_code', 's', _THREE)}) WHERE split = 'validation') SELECT cath_domain, cath_code FROM domains SEMI JOIN t USING (cath_code, s)", "domains")
def hi4b(d):
    splits = H.level_splits(d, ["cath_code"], {"S35": ["s"]})
    return H.dataset_view(d, splits=splits, level="S35", split="validation", key=("s",)).select("cath_domain", "cath_code")


@plain("HI4c_dataset_list", "SELECT cath_domain, cath_code, 'list' AS view FROM domains WHERE cath_domain IN (3, 5, 9) UNION ALL SELECT cath_domain, cath_code, 'all' FROM domains", "domains")
def hi4c(d):
    view = lambda df, n: df.select("cath_domain", "cath_code", F.lit(n).alias("view"))
    return view(H.dataset_view(d, names=[3, 5, 9, -1]), "list").unionByName(view(H.dataset_view(d), "all"))


@plain("HI7_label_column", """
WITH v AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS label FROM (SELECT DISTINCT t FROM domains))
SELECT cath_domain, concat_ws(',', CASE WHEN i % 2 = 0 THEN '1.0,0.0' ELSE '0.0,1.0' END, concat(label, '.0')) AS truth FROM domains JOIN v USING (t)""", "domains")
def hi7(d):
    rows = X.truth_vectors(H.label_encode(d, "t"), F.col("i") % 2 == 1)
    return rows.select("cath_domain", F.array_join(X.with_label(F.col("truth"), F.col("label")).cast("array<string>"), ",").alias("truth"))


@plain("PF7_ancestors", f"WITH {_NODES} SELECT cath_code, level FROM nodes WHERE starts_with('1.1.3.', cath_code || '.') OR starts_with('2.', cath_code || '.')", "domains")
def pf7(d):
    return P.ancestors_of(H.build_nodes(d), ["1.1.3", "2"]).select("cath_code", "level")


@plain("PF8_skip_subtree", f"WITH {_NODES} SELECT cath_code, level FROM nodes WHERE NOT starts_with(cath_code || '.', '3.') AND NOT starts_with(cath_code || '.', '4.4.')", "domains")
def pf8(d):
    return P.filter_codes(H.build_nodes(d), skip=["3", "4.4"]).select("cath_code", "level")


@plain("J15_request_order", "SELECT position, cath_domain, cath_code FROM domains JOIN (VALUES (0, 5), (1, 3), (2, 5), (4, 9)) q(position, cath_domain) USING (cath_domain)", "domains")
def j15(d):
    return H.in_request_order(d, [5, 3, 5, 7, 9], "cath_domain", ignore=[7]).select(F.col("position").cast("int").alias("position"), "cath_domain", "cath_code")


@plain("J16_cluster_representatives", "WITH r AS (SELECT s, o, min(cath_domain) AS rep FROM domains GROUP BY ALL) SELECT cath_domain, rep, cath_domain = rep AS is_rep FROM domains JOIN r USING (s, o)", "domains")
def j16(d):
    return d.join(d.groupBy("s", "o").agg(F.min("cath_domain").alias("rep")), ["s", "o"]).select("cath_domain", "rep", (F.col("cath_domain") == F.col("rep")).alias("is_rep"))


@plain("J17_representatives", """
WITH r AS (SELECT cath_code, min(cath_domain) AS cath_domain FROM domains GROUP BY cath_code, s),
f AS (SELECT cath_domain FROM domains WHERE cath_domain % 3 <> 0)
SELECT cath_code, count(*) AS total_domains, count(*) FILTER (f.cath_domain IS NULL) AS n_missing, coalesce(min(r.cath_domain) FILTER (f.cath_domain IS NULL), -1) AS first_missing
  FROM r LEFT JOIN f USING (cath_domain) GROUP BY ALL""", "domains")
def j17(d):
    return H.representatives(d.where("cath_domain % 3 != 0"), d.groupBy("cath_code", "s").agg(F.min("cath_domain").alias("cath_domain"))).na.fill(-1, ["first_missing"])




@plain("W8_cluster_split", split_sql("c", "s", _THREE), "domains")
def w8(d):
    return H.cluster_split(d, ["c"], ["s"])


@plain("W9_level_split_S95", split_sql("cath_code", "s, o, l", _THREE), "domains")
def w9(d):
    return H.cluster_split(d, ["cath_code"], ["s", "o", "l"])


_LEVELS = {"S35": "s", "S60": "s, o", "S95": "s, o, l", "S100": "s, o, l, i"}


@plain("W9b_all_levels", " UNION ALL ".join(f"SELECT cath_code, '{name}' AS level, concat_ws('.', {key}) AS key, n, split FROM ({split_sql('cath_code', key, _THREE)})" for name, key in _LEVELS.items()), "domains")
def w9b(d):
    return H.level_splits(d, ["cath_code"])


@plain("W10_flat_split", split_sql("g", "s, o", _THREE, "(SELECT *, 1 AS g FROM domains)").replace("SELECT g, s, o, n, '", "SELECT s, o, n, '"), "domains")
def w10(d):
    return H.cluster_split(d, [], ["s", "o"])


_FLAT = {"100": "s, o, l, i", "95": "s, o, l", "90": "s, o", "70": "s, l", "50": "s", "30": "o"}
_ONE_SCOPE = "(SELECT *, 1 AS g FROM domains)"


@plain("W10b_flat_levels", " UNION ALL ".join(f"SELECT '{name}' AS level, concat_ws('.', {key}) AS key, n, split FROM ({split_sql('g', key, _THREE, _ONE_SCOPE)})" for name, key in _FLAT.items()), "domains")
def w10b(d):
    return H.flat_splits(d, {name: key.split(", ") for name, key in _FLAT.items()})[0]


@plain("W10c_flat_representatives", "SELECT CAST(o AS VARCHAR) AS key, min(cath_domain) AS representative FROM domains GROUP BY o", "domains")
def w10c(d):
    return H.flat_splits(d, {"30": ["o"]}, "30")[1]


@plain("W11_two_way_split", split_sql("c", "s", [("train", 0.7), ("test", 0.3)]), "domains")
def w11(d):
    return H.cluster_split(d, ["c"], ["s"], {"train": 0.7, "test": 0.3})


@plain("W7_label_encode", "WITH v AS (SELECT cath_code, row_number() OVER (ORDER BY cath_code) - 1 AS label FROM (SELECT DISTINCT cath_code FROM domains)) SELECT cath_domain, CAST(label AS INT) AS label FROM domains JOIN v USING (cath_code)", "domains")
def w7(d):
    return H.label_encode(d, "cath_code").select("cath_domain", "label")


@plain("TK1_top_families", "SELECT cath_code, count(*) AS n FROM domains GROUP BY ALL ORDER BY n DESC, cath_code LIMIT 300", "domains")
def tk1(d):
    return H.top_families(d)


@plain("SO1_concatenate", "SELECT cath_domain, 'a' AS part FROM domains WHERE c = 1 UNION ALL SELECT cath_domain, 'b' FROM domains WHERE c = 2", "domains")
def so1(d):
    return H.concatenate({"a": d.where("c = 1").select("cath_domain"), "b": d.where("c = 2").select("cath_domain")})


@plain("SO2_remaining_work", "SELECT cath_domain FROM domains EXCEPT SELECT cath_domain FROM domains WHERE i > 10", "domains")
def so2(d):
    return P.drop_keys(d, d.where("i > 10"), "cath_domain").select("cath_domain")


@plain("SO3_common_keys", "SELECT cath_domain FROM domains WHERE i > 10 INTERSECT SELECT cath_domain FROM domains WHERE l < 6", "domains")
def so3(d):
    return H.common_keys(d.where("i > 10"), d.where("l < 6"))


@plain("SO4_undersample", """
WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM domains GROUP BY c))
SELECT cath_domain, c FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5(concat(cath_domain, ':0')), cath_domain) AS k FROM domains), m WHERE k <= m""", "domains")
def so4(d):
    return H.balance(d, "c", "cath_domain").select("cath_domain", "c")


@plain("SO4b_oversample", """
WITH n AS (SELECT c, count(*) AS n FROM domains GROUP BY c),
k AS (SELECT cath_domain, c, row_number() OVER (PARTITION BY c ORDER BY md5(concat(cath_domain, ':0')), cath_domain) AS k FROM domains),
w AS (SELECT c, n, unnest(generate_series(1, (SELECT max(n) FROM n) - n)) AS d FROM n),
q AS (SELECT c, CAST(concat('0x', substr(md5(concat(c, ':', d, ':0')), 1, 8)) AS BIGINT) % n + 1 AS k FROM w)
SELECT cath_domain, c FROM k
UNION ALL SELECT cath_domain, c FROM q JOIN k USING (c, k)""", "domains")
def so4b(d):
    return H.oversample(d.select("cath_domain", "c"), "c", "cath_domain")


@plain("SO5_drop_negatives", "SELECT cath_domain, domain_length FROM domains WHERE domain_length > 100000", "domains")
def so5(d):
    return H.drop_negatives(d, F.col("domain_length") > 100000).select("cath_domain", "domain_length")


@plain("SO6_search_union", "SELECT DISTINCT cath_domain FROM domains WHERE s = 3 OR (c = 1 AND a = 4) OR cath_code = '2.2.1.1'", "domains")
def so6(d):
    return H.search_union(d, [F.expr("s = 3"), F.expr("c = 1 and a = 4"), F.expr("cath_code = '2.2.1.1'")])


@plain("ST1_natural_sort_key", "SELECT cath_domain, CAST(string_split(cath_code, '.')[2] AS INT) AS number, string_split(cath_code, '.')[1] AS prefix FROM domains", "domains")
def st1(d):
    return d.select("cath_domain", F.regexp_extract("cath_code", r"^[^.]*\.(\d+)", 1).cast("int").alias("number"), F.regexp_extract("cath_code", r"^([^.]*)", 1).alias("prefix"))


@plain("ST2_sort_rank", "SELECT cath_domain, CAST(row_number() OVER (PARTITION BY cath_code ORDER BY domain_length, cath_domain) AS INT) AS place FROM domains", "domains")
def st2(d):
    return H.places(d, ["cath_code"], ["domain_length", "cath_domain"]).select("cath_domain", "place")


_LINE = "concat_ws('  ', cath_domain, c, a, t, h, s, o, l, i, 1, domain_length, '1.500')"


@plain("SC3_domain_list", "SELECT CAST(cath_domain AS VARCHAR) AS cath_domain, c, a, t, h, s, domain_length, 1.5::DOUBLE AS resolution, cath_code, '/' || replace(cath_code, '.', '/') AS h5_key FROM domains", "domains")
def sc3(d):
    lines = d.select(F.expr(_LINE).alias("line")).union(d.limit(1).select(F.lit("# comment").alias("line")))
    return T.read_domain_list(lines).select("cath_domain", "c", "a", "t", "h", "s", "domain_length", "resolution", "cath_code", "h5_key")


@plain("SC4_hierarchy_names", "SELECT cath_code, CAST(min(cath_domain) AS VARCHAR) AS representative, concat('family ', cath_code) AS description FROM domains GROUP BY cath_code", "domains")
def sc4(d):
    lines = d.groupBy("cath_code").agg(F.min("cath_domain").alias("r")).select(F.concat("cath_code", F.lit("    "), F.col("r").cast("string"), F.lit("    :family "), "cath_code").alias("line"))
    return T.read_hierarchy_names(lines)


@plain("SC6_annotations", "SELECT cath_domain AS path, cath_domain * 2 AS serial_number, l - 0.5::DOUBLE AS charge, 1.5::DOUBLE AS radius FROM domains", "domains")
def sc6(d):
    lines = d.select(F.col("cath_domain").alias("path"), F.expr("concat_ws(' ', 'ATOM', cath_domain * 2, 'CA', 'ALA', 'A', i, '1.0', '2.0', '3.0', cast(l - 0.5D as string), '1.50')").alias("line"))
    return T.read_annotation(lines, "pqr")


@plain("SC7_cluster_table", "SELECT 'H' AS record_type, s AS cluster, domain_length AS length, 97.5::DOUBLE AS pct_id, '+' AS strand, 'D' AS alignment, CAST(cath_domain AS VARCHAR) AS label_query, cath_code AS label_target FROM domains", "domains")
def sc7(d):
    return T.read_clusters(d.select(F.expr("concat_ws('\\t', 'H', s, domain_length, '97.5', '+', '0', '0', 'D', cath_domain, cath_code)").alias("line")), "uc")


@plain("SC7b_similarity_table", "SELECT CAST(cath_domain AS VARCHAR) AS chain1, cath_code AS chain2, s / 100::DOUBLE AS score12, o / 10::DOUBLE AS score21, l * 1.0::DOUBLE AS rmsd FROM domains", "domains")
def sc7b(d):
    return T.read_similarity(d.select(F.expr("concat_ws('\\t', cath_domain, cath_code, cast(s / 100 as double), cast(o / 10 as double), l)").alias("line")))


@plain("SC8_distance_records", "SELECT cath_code AS path, s AS a, o + 100 AS b, l * 0.5::DOUBLE AS distance FROM domains UNION SELECT cath_code, o + 100, s, l * 0.5::DOUBLE FROM domains", "domains")
def sc8(d):
    return T.read_distances(d.select(F.col("cath_code").alias("path"), F.expr("concat('DIST : ', s, ' ', o + 100, ' ', cast(l * 0.5D as string))").alias("line")))


_FOUR = """
SELECT 'cx' AS kind, cath_domain AS path, CAST(i AS VARCHAR) AS id, s + 0.5::DOUBLE AS value FROM domains
UNION ALL SELECT 'pdbqt', cath_domain, CAST(i AS VARCHAR), NULL FROM domains
UNION ALL SELECT 'frustration', cath_domain, CAST(i AS VARCHAR), l - 6.5::DOUBLE FROM domains
UNION ALL SELECT 'consurf', cath_domain, CAST(i AS VARCHAR), o * 0.25::DOUBLE FROM domains"""


@plain("SC6b_other_annotations", _FOUR, "domains")
def sc6b(d):
    """The other four tools' formats, written as text and read."""
    text = {
        "cx": F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00%6.2f", "i", "i", F.lit(1.0), F.lit(2.0), F.lit(3.0), F.col("s") + 0.5),
        "pdbqt": F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00    +0.000 C ", "i", "i", F.lit(1.0), F.lit(2.0), F.lit(3.0)),
        "frustration": F.format_string("%d A 0.1 0.2 ALA 0.3 0.4 %.3f", "i", F.col("l") - 6.5),
        "consurf": F.format_string("  %d  A  ALA1:A  %.3f  5", "i", F.col("o") * 0.25),
    }
    columns = {"cx": ("serial_number", "cx"), "pdbqt": ("serial_number", None), "frustration": ("residue_id", "frustration_index"), "consurf": ("position", "score")}
    out = None
    for kind, (key, value) in columns.items():
        lines = d.select(F.col("cath_domain").alias("path"), text[kind].alias("line"))
        one = T.read_annotation(lines, kind).select(F.lit(kind).alias("kind"), "path", F.col(key).cast("string").alias("id"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@plain("SC8b_cluster_log", """
WITH m AS (SELECT cath_code AS path, o AS cluster, cath_domain, min(cath_domain) OVER (PARTITION BY cath_code, o) AS c FROM domains)
SELECT path, cluster, CAST(cath_domain AS INT) AS item, CAST(cath_domain AS VARCHAR) AS structure, CAST(c AS INT) AS centroid_item, 0.5::DOUBLE AS spread,
  CAST(c AS VARCHAR) AS centroid FROM m""", "domains")
def sc8b(d):
    """Logs with a section of clusters and one of centroids."""
    code = F.col("cath_code").alias("path")
    head = lambda at, text: d.select(code).distinct().select("path", F.lit(at).cast("long").alias("line_no"), F.lit(text).alias("line"))
    members = d.select(code, (F.col("cath_domain") + 10).alias("line_no"), F.expr("concat_ws(' ', 'INFO  :', cath_domain, ':', o, cath_domain)").alias("line"))
    centres = d.groupBy(code, "o").agg(F.min("cath_domain").alias("c")).select("path", (F.col("o") + (1 << 40)).alias("line_no"), F.expr("concat_ws(' ', 'INFO  :', o, ':', c, '3', '0.5', c)").alias("line"))
    rows = [head(1, "INFO  : 5 Clusters @ Threshold 0.8"), head(2, "INFO  : Item Cluster"), head(3, "INFO  : -----"), members, head(1 << 39, "INFO  : ======"), head((1 << 39) + 1, "INFO  : Centroids"), centres, head(1 << 41, "INFO  : ======")]
    lines = rows[0]
    for r in rows[1:]:
        lines = lines.unionByName(r)
    return T.read_cluster_log(lines).select("path", "cluster", "item", "structure", "centroid_item", "spread", "centroid")
