"""Deterministic views of the general tables that stand for structure data. One SQL text serves Spark and other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")

_RES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
_RESIDUE = "CASE CAST(l_partkey % 21 AS INT) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RES)) + " ELSE 'UNK' END"

# Structures: a supplier is a domain, its line items are atoms.
ATOMS = f"""
SELECT cath_domain, serial_number, residue_id, chain, x, y, z, element, vdw_radii, bfactor, charge, residue_rasa, ss, residue_name,
 CASE CAST(serial_number % 6 AS INT) WHEN 1 THEN 'N' WHEN 2 THEN 'CA' WHEN 3 THEN 'C' WHEN 4 THEN 'O' WHEN 5 THEN 'CB' ELSE 'CG' END AS atom_name
FROM (SELECT l_suppkey AS cath_domain,
 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS serial_number,
 CAST(l_orderkey % 60 AS STRING) AS residue_id, l_returnflag AS chain,
 l_quantity AS x, CAST(l_partkey % 500 AS DOUBLE) / CAST(10 AS DOUBLE) AS y, CAST(l_orderkey % 500 AS DOUBLE) / CAST(10 AS DOUBLE) AS z,
 CASE l_linenumber WHEN 1 THEN 'H' WHEN 2 THEN 'C' WHEN 3 THEN 'N' WHEN 4 THEN 'O' WHEN 5 THEN 'S' WHEN 6 THEN 'P' ELSE 'F' END AS element,
 CAST(CASE l_linenumber WHEN 1 THEN 1.2 WHEN 2 THEN 1.7 WHEN 3 THEN 1.55 WHEN 4 THEN 1.52 WHEN 5 THEN 1.8 WHEN 6 THEN 1.8 ELSE 1.47 END AS DOUBLE) AS vdw_radii,
 l_extendedprice / CAST(1000 AS DOUBLE) AS bfactor, l_discount - CAST(0.05 AS DOUBLE) AS charge, l_tax * CAST(10 AS DOUBLE) AS residue_rasa,
 CASE l_linenumber WHEN 1 THEN 'H' WHEN 2 THEN 'E' WHEN 3 THEN 'G' WHEN 4 THEN 'B' WHEN 5 THEN 'T' WHEN 6 THEN 'S' ELSE '-' END AS ss,
 {_RESIDUE} AS residue_name FROM {{lineitem}}) t"""

# A four-level hierarchy: an order is a domain.
DOMAINS = """
SELECT o_orderkey AS cath_domain, CAST(n_regionkey AS INT) AS c, CAST(n_nationkey AS INT) AS a,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS t, CAST(c_custkey % 7 AS INT) AS h,
 CAST(o_custkey % 97 AS INT) AS s, CAST(substring(o_orderpriority, 1, 1) AS INT) AS o, CAST(month(o_orderdate) AS INT) AS l, CAST(day(o_orderdate) AS INT) AS i,
 CAST(floor(o_totalprice) AS INT) AS domain_length,
 concat(CAST(n_regionkey AS STRING), '.', CAST(n_nationkey AS STRING), '.', CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '3' WHEN 'HOUSEHOLD' THEN '4' ELSE '5' END, '.', CAST(c_custkey % 7 AS STRING)) AS cath_code
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

# Residue ranges of domains on the chains of a structure.
SEGMENTS = """
SELECT l_suppkey AS pdb, l_returnflag AS chain, l_orderkey AS cath_domain, l_partkey AS nstart, l_partkey + CAST(l_quantity AS BIGINT) AS nstop, min(l_linenumber) AS nseg
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5"""

# Contacts between residues, with areas.
CONTACTS = """
SELECT l_orderkey AS pdb, l_linenumber AS interface_id, l_partkey AS first_res, l_suppkey AS second_res, l_discount AS distance, l_returnflag AS first_chain, l_linestatus AS second_chain,
 l_extendedprice AS c1_asa, l_quantity * CAST(100 AS DOUBLE) AS c2_asa, l_extendedprice * (CAST(1 AS DOUBLE) - l_tax) AS complex_asa, l_tax AS score, CAST(l_shipdate AS DATE) AS seen
FROM {lineitem}"""

# Fixed-width coordinate text of two models a structure, with alternate locations, hetero records and insertion codes.
LINES = f"""
SELECT cath_domain AS path, serial_number * 4 AS line_no, concat(
 CASE WHEN serial_number % 11 = 0 THEN 'HETATM' ELSE 'ATOM  ' END, lpad(CAST(serial_number AS STRING), 5, ' '), ' ',
 rpad(concat(' ', atom_name), 4, ' '), CASE CAST(serial_number % 10 AS INT) WHEN 3 THEN 'A' WHEN 4 THEN 'B' ELSE ' ' END, residue_name, ' ', chain,
 lpad(residue_id, 4, ' '), CASE WHEN serial_number % 13 = 0 THEN 'A' ELSE ' ' END, '   ',
 lpad(CAST(CAST(x AS DECIMAL(10,3)) AS STRING), 8, ' '), lpad(CAST(CAST(y AS DECIMAL(10,3)) AS STRING), 8, ' '), lpad(CAST(CAST(z AS DECIMAL(10,3)) AS STRING), 8, ' '),
 '  1.00', lpad(CAST(CAST(floor(bfactor) AS DECIMAL(10,2)) AS STRING), 6, ' '), '      ', rpad(concat('S', chain), 4, ' '), lpad(element, 2, ' '), '  ') AS line
FROM ({ATOMS}) q
UNION ALL SELECT DISTINCT l_suppkey, CAST(1 AS BIGINT), rpad('MODEL        1', 80, ' ') FROM {{lineitem}}
UNION ALL SELECT DISTINCT l_suppkey, CAST(1201 AS BIGINT), rpad('ENDMDL', 80, ' ') FROM {{lineitem}}
UNION ALL SELECT DISTINCT l_suppkey, CAST(1202 AS BIGINT), rpad('MODEL        2', 80, ' ') FROM {{lineitem}}
UNION ALL SELECT DISTINCT l_suppkey, CAST(999998 AS BIGINT), rpad('ENDMDL', 80, ' ') FROM {{lineitem}}
UNION ALL SELECT DISTINCT l_suppkey, CAST(999999 AS BIGINT), rpad('END', 80, ' ') FROM {{lineitem}}"""

# The same, parsed.
RECORDS = f"""
SELECT path, line_no, rtrim(substr(line, 1, 6)) AS record, TRY_CAST(trim(substr(line, 7, 5)) AS INT) AS serial, substr(line, 13, 4) AS atom_name, substr(line, 17, 1) AS altloc,
 trim(substr(line, 18, 3)) AS resname, substr(line, 22, 1) AS chain, TRY_CAST(trim(substr(line, 23, 4)) AS INT) AS resseq, substr(line, 27, 1) AS icode,
 TRY_CAST(trim(substr(line, 31, 8)) AS DOUBLE) AS x, TRY_CAST(trim(substr(line, 39, 8)) AS DOUBLE) AS y, TRY_CAST(trim(substr(line, 47, 8)) AS DOUBLE) AS z,
 TRY_CAST(trim(substr(line, 55, 6)) AS DOUBLE) AS occ, TRY_CAST(trim(substr(line, 61, 6)) AS DOUBLE) AS b, substr(line, 73, 4) AS segid, trim(substr(line, 77, 2)) AS element, trim(substr(line, 79, 2)) AS charge, line
FROM ({LINES}) p"""

# Energies of pairs of residues, with the state and the kind of well each is in.
PAIR_ENERGIES = """
SELECT cath_domain, res1, res2, min(l_discount) AS native_energy, min(l_tax) AS decoy_energy, max(l_tax) AS sd_energy, min(idx) AS frustration_index,
 CASE WHEN min(idx) < 15 THEN 'highly' WHEN min(idx) > 40 THEN 'minimally' ELSE 'neutral' END AS state,
 CASE CAST(min(l_linenumber) % 3 AS INT) WHEN 0 THEN 'water-mediated' WHEN 1 THEN 'short' ELSE 'long' END AS well
FROM (SELECT l_suppkey AS cath_domain, least(CAST(l_orderkey % 60 AS STRING), CAST(l_partkey % 60 AS STRING)) AS res1, greatest(CAST(l_orderkey % 60 AS STRING), CAST(l_partkey % 60 AS STRING)) AS res2,
 l_discount, l_tax, l_linenumber, l_extendedprice / CAST(1000 AS DOUBLE) AS idx FROM {lineitem}) e WHERE res1 <> res2 GROUP BY 1, 2, 3"""

VIEWS = {"pair_energies": PAIR_ENERGIES, "lines": LINES, "records": RECORDS, "atoms": ATOMS, "domains": DOMAINS, "segments": SEGMENTS, "contacts": CONTACTS}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _Tables(spark, sf_dir)


class _Tables(dict):
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def view(spark: SparkSession, sf_dir: str, name: str, task_rows: int | None = None) -> DataFrame:
    """``task_rows``: line items are dealt by supplier, in as many tasks as their number calls for, about so many to a task."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    if task_rows:
        used["lineitem"] = used["lineitem"].repartition(max(1, -(-used["lineitem"].count() // task_rows)), "l_suppkey")
    return spark.sql(VIEWS[name], **used)


def view_sql(*names: str) -> str:
    """The views as common table expressions over the tables."""
    plain = {t: t for t in TABLES}
    return ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
