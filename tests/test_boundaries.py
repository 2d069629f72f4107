"""Queries of distances equal their SQL where a distance is the limit but for the last bit."""

import duckdb

from helixlake.plans import q_clusters
from helixlake.plans.queries import QUERIES, SQL
from helixlake.plans.views import view_sql

LINEITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp"


def lineitem(path, rows):
    """A folder with line items (order, part, supplier, line, quantity), and DuckDB on it."""
    con = duckdb.connect()
    con.execute(f"create table t ({LINEITEM})")
    con.executemany("insert into t values (?, ?, ?, ?, ?, 1000, 0.05, 0.02, 'A', 'F', timestamp '1996-01-01')", rows)
    con.execute(f"copy t to '{path}/lineitem.parquet' (format parquet)")
    con.execute(f"create view lineitem as select * from '{path}/lineitem.parquet'")
    return con


def test_connections_at_the_limit(spark, tmp_path):
    # from 4.1 to 16.1 and from 23.3 to 32.3: 15 by products, and 14.999999999999998 by DuckDB's power, which counted it
    ends = [(233, 41, 1, 1, 10), (323, 161, 1, 2, 10)]
    con = lineitem(tmp_path, [*ends, (233, 41, 2, 1, 10), (323, 151, 2, 2, 10)])
    want = con.execute(SQL["J20_allowed_connections"]).fetchall()
    got = QUERIES["J20_allowed_connections"](spark, str(tmp_path)).collect()
    assert [(r.cath_domain, r.n, r.digest) for r in got] == want
    assert [r[:2] for r in want] == [(2, 2)]


def edges_in_both_orders(spark, name, f):
    """The result of ``f`` and that of the query's SQL, on atoms (in place of the view) in two orders of rows. The mean of the
    first residue's y is 8, or 7.999999999999998 if it is summed from the end; the other residue's is 20."""
    y = [31, 140, 18, 10, 58, 124, 121, 54, 98, 146]
    names = ["N", "CA", "C", "O", "CB", "CG"]
    near = [(1, k + 1, "1", names[k % 6], 10.0, v / 10, 0.0, 1.0) for k, v in enumerate(y)]
    far = [(1, 11 + k, "2", n, 10.0, v, 0.0, 1.0) for k, (n, v) in enumerate([("N", 19.0), ("O", 21.0)])]
    columns = {"cath_domain": "bigint", "serial_number": "bigint", "residue_id": "string", "atom_name": "string", "x": "double", "y": "double", "z": "double", "bfactor": "double"}
    energies = [(1, "1", "2", 0.1, 0.2, 0.3, 10.0, "highly", "short")]
    known = {"cath_domain": "bigint", "res1": "string", "res2": "string", "native_energy": "double", "decoy_energy": "double", "sd_energy": "double", "frustration_index": "double", "state": "string", "well": "string"}
    ddl = lambda c: ", ".join(f"{k} {t}" for k, t in c.items())
    views = ("atoms", "pair_energies") if name.startswith("J23") else ("atoms",)
    sql = SQL[name].replace(view_sql(*views) + ", ", "", 1)
    assert sql != SQL[name]
    out = []
    for rows in (near + far, (near + far)[::-1]):
        con = duckdb.connect()
        for table, c, data in (("atoms", columns, rows), ("pair_energies", known, energies)):
            con.execute(f"create table {table} ({ddl(c)})")
            con.executemany(f"insert into {table} values ({', '.join('?' * len(c))})", data)
        out.append(con.execute(sql).fetchall())
        frames = [spark.createDataFrame(rows, ddl(columns)).coalesce(1), spark.createDataFrame(energies, ddl(known))]
        out.append([tuple(r) for r in f(*frames[: len(views)]).collect()])
    return out


def test_torsions_of_an_edge_at_the_limit(spark):
    out = edges_in_both_orders(spark, "CL5b_edge_torsions", q_clusters.cl5b)
    assert [len(o) for o in out] == [1] * 4 and out == out[:1] * 4


def test_kernels_of_an_edge_at_the_limit(spark):
    out = edges_in_both_orders(spark, "CL6_edge_kernels", q_clusters.cl6)
    assert [len(o) for o in out] == [1] * 4 and out == out[:1] * 4


def test_annotations_of_an_edge_at_the_limit(spark):
    out = edges_in_both_orders(spark, "J23_pair_annotations", q_clusters.j23)
    assert [len(o) for o in out] == [1] * 4 and out == out[:1] * 4
    assert out[0] == [(1, "1", "2", 0.1, 0.2, 0.3, 10.0, True, False, False, False, True, False)]
