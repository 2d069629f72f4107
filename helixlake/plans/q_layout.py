"""Queries on corrected segments, laid-out tables, dense blocks, folders as hierarchies, and user functions with any result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.featurizers import failures, map_groups, results
from ..operators import hierarchy as H
from ..operators import overlay as O
from ..operators import voxel as V
from ..operators.scratch import scratch_path
from ..sources import dense as B
from ..sources import layout as L
from .q_clusters import _RUNS, segments_of
from .q_rows import plain
from .q_space import lattice
from .registry import query
from .views import tables, view

# Corrections of segments: the seventh line of each order, by order.
_FIXES = """
SELECT l_suppkey AS cath_domain, l_orderkey AS nr, min(l_partkey % 500) + 1 AS start, min(l_partkey % 500) + max(CAST(l_quantity AS BIGINT)) AS stop,
 CASE min(l_returnflag) WHEN 'A' THEN 'H' WHEN 'N' THEN 'E' ELSE 'X' END AS value
FROM {lineitem} WHERE l_linenumber = 7 GROUP BY 1, 2"""


@query("W3_corrections", ("atoms",), f"""
WITH {_RUNS}, f AS ({_FIXES.format(lineitem="lineitem")}),
r AS (SELECT cath_domain, value, unnest(generate_series(start, stop)) AS pos FROM s),
c AS (SELECT cath_domain, pos, arg_max(value, nr) AS value FROM (SELECT cath_domain, nr, value, unnest(generate_series(start, stop)) AS pos FROM f) GROUP BY ALL),
v AS (SELECT cath_domain, pos, coalesce(c.value, r.value) AS value FROM r FULL JOIN c USING (cath_domain, pos)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY cath_domain, value ORDER BY pos) AS island FROM v)
SELECT cath_domain, min(pos) AS start, max(pos) AS stop, value FROM i GROUP BY cath_domain, value, island""")
def w3_corrections(spark, sf):
    fixes = spark.sql(_FIXES, lineitem=tables(spark, sf)["lineitem"])
    return O.overlay(segments_of(view(spark, sf, "atoms", V.TASK_ATOMS)), fixes, "cath_domain").select("cath_domain", "start", "stop", "value")


@plain("SC2_scan_level", """
SELECT 'code' AS asked, cath_domain, cath_code, domain_length FROM domains WHERE cath_code LIKE '2.1_.%'
UNION ALL SELECT 'domain', cath_domain, cath_code, domain_length FROM domains WHERE cath_domain = 7
UNION ALL SELECT 'both', cath_domain, cath_code, domain_length FROM domains WHERE cath_domain = 7 AND cath_code LIKE '3.%'""", "domains")
def sc2_level(d):
    """A level written in its layout, and read by codes, by a domain, and by both."""
    path = scratch_path(d.sparkSession, "levels")
    L.write_level(d.select("cath_domain", "cath_code", "domain_length"), path, "residue")
    out = None
    for asked, code, domain in (*(("code", f"2.1{k}", None) for k in range(10)), ("domain", None, 7), ("both", "3", 7)):
        part = L.scan(d.sparkSession, path, "residue", code, domain).select(F.lit(asked).alias("asked"), "cath_domain", "cath_code", "domain_length")
        out = part if out is None else out.unionByName(part)
    return out


@plain("AG3_dense_blocks", f"""
WITH v AS (SELECT cath_domain, vx, vy, vz, greatest(0, max(charge)) AS q FROM ({lattice()}) GROUP BY ALL)
SELECT CAST(cath_domain AS VARCHAR) AS name, count(*) AS n, sum(q) > 0 AS any_charge, md5(string_agg(concat(vx, ',', vy, ',', vz), ';' ORDER BY vx, vy, vz)) AS places FROM v GROUP BY cath_domain""", "atoms")
def ag3_dense(a):
    """All structures written as dense blocks and read back."""
    path = scratch_path(a.sparkSession, "dense")
    B.write_dense(V.sparse_samples(V.voxelize(a, ["charge"]), ["charge"]), path)
    s = B.read_dense(a.sparkSession, path)
    text = F.array_join(F.transform("coords", lambda c: F.array_join(c.cast("array<string>"), ",")), ";")
    charge = F.aggregate("feats", F.lit(0.0), lambda t, f: t + f[0])
    return s.select("name", F.size("coords").cast("long").alias("n"), (charge > 0).alias("any_charge"), F.md5(text).alias("places"))


_FOLDERS = "array_to_string(string_split(cath_code, '.')[1:1 + cath_domain % 4], '/')"


@plain("HI1_directories", f"""
WITH f AS (SELECT string_split({_FOLDERS}, '/') AS p FROM domains),
s AS (SELECT p, unnest(generate_series(1, len(p))) AS level FROM f),
n AS (SELECT array_to_string(p[1:level], '.') AS cath_code, CAST(level AS INTEGER) AS level, CASE WHEN level > 1 THEN array_to_string(p[1:level - 1], '.') END AS parent_code,
  '/' || array_to_string(p[1:level], '/') AS h5_key, CAST(sum(CASE WHEN len(p) = level THEN 1 ELSE 0 END) AS BIGINT) AS n_files, count(*) AS n_below FROM s GROUP BY ALL)
SELECT n.*, d.description FROM n LEFT JOIN (SELECT DISTINCT split_part(cath_code, '.', 1) AS cath_code, concat('class ', split_part(cath_code, '.', 1)) AS description FROM domains) d USING (cath_code)""", "domains")
def hi1_directories(d):
    """An uneven tree of folders: files lie at one to four levels."""
    codes = F.split("cath_code", r"\.")
    folder = F.array_join(F.slice(codes, 1, (F.col("cath_domain") % 4 + 1).cast("int")), "/")
    files = d.select(F.concat(F.lit("store/"), folder, F.lit("/"), F.col("cath_domain").cast("string"), F.lit(".pdb")).alias("path"))
    names = d.select(codes[0].alias("cath_code")).distinct().withColumn("description", F.concat(F.lit("class "), "cath_code"))
    return H.directory_nodes(files, "store", names)


def _extremes(rows: pd.DataFrame) -> pd.DataFrame | None:
    """The two ends of a structure along each axis; none for structures whose number ends in 3, and no answer for those in 7."""
    key = int(rows["cath_domain"].iloc[0])
    if key % 10 == 7:
        raise ValueError("no surface")
    if key % 10 == 3:
        return None
    return pd.DataFrame({"axis": list("xyz"), "low": rows[list("xyz")].min().to_numpy(), "high": rows[list("xyz")].max().to_numpy()})


@plain("U2_map_rows", """
WITH a AS (SELECT cath_domain, unnest(['x', 'y', 'z']) AS axis, unnest([min(x), min(y), min(z)]) AS low, unnest([max(x), max(y), max(z)]) AS high FROM atoms WHERE cath_domain % 10 NOT IN (3, 7) GROUP BY cath_domain)
SELECT cath_domain, axis, low, high, NULL::VARCHAR AS message FROM a
UNION ALL SELECT DISTINCT cath_domain, NULL, NULL, NULL, 'ValueError: no surface' FROM atoms WHERE cath_domain % 10 = 7""", "atoms")
def u2_rows(a):
    """Results of several rows a key and the failures, from one written table."""
    done = map_groups(a.select("cath_domain", "x", "y", "z"), _extremes, "cath_domain", "axis string, low double, high double")
    good = results(done, "cath_domain").withColumn("message", F.lit(None).cast("string"))
    return good.unionByName(failures(done, "cath_domain").drop("stage"), allowMissingColumns=True)
