"""Readers and writers of coordinate text and of the tables that come with it. All of them are lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textfiles import few_listing_tasks, read_text_files, write_text_files

# Columns of a coordinate record, as first column (from 1), width and type; raw ones keep their blanks.
FIELDS = {
    "record": (1, 6, "rtrim"), "serial": (7, 5, "int"), "atom_name": (13, 4, "raw"), "altloc": (17, 1, "raw"), "resname": (18, 3, "trim"), "chain": (22, 1, "raw"),
    "resseq": (23, 4, "int"), "icode": (27, 1, "raw"), "x": (31, 8, "double"), "y": (39, 8, "double"), "z": (47, 8, "double"), "occ": (55, 6, "double"),
    "b": (61, 6, "double"), "segid": (73, 4, "raw"), "element": (77, 2, "trim"), "charge": (79, 2, "trim"),
}
COORDS = ("ATOM", "HETATM")


def _field(line: Column, start: int, width: int, kind: str) -> Column:
    text = F.substring(line, start, width)
    if kind == "raw":
        return text
    if kind == "rtrim":
        return F.rtrim(text)
    return F.trim(text) if kind == "trim" else F.trim(text).try_cast(kind)


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed columns next to path, line_no and the line itself; what can't be read is null."""
    return lines.withColumns({n: _field(F.col(line), *f) for n, f in FIELDS.items()})


def read_structures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Coordinate files of any number as path, line_no (order in the file) and parsed columns.

    A file is one record to the reader and is split into numbered lines on the executor that read it: structures are small,
    and the numbers need no window over the file."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("line != ''")
    return parse_records(rows.withColumn("line_no", F.col("line_no").cast("long")))


def render(df: DataFrame) -> Column:
    """The 80 columns of a coordinate record from its fields; null text is blank, occupancy 1 and b-factor 0 by default."""
    s = lambda c, n: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")
    right = lambda c, n: F.lpad(F.coalesce(c.cast("string"), F.lit("")), n, " ")
    fixed = lambda c, n, d, other: right(F.coalesce(F.bround(F.col(c), d), F.lit(other)).cast(f"decimal(18,{d})"), n)
    return F.concat(s("record", 6), right(F.col("serial"), 5), F.lit(" "), s("atom_name", 4), s("altloc", 1), right(F.col("resname"), 3), F.lit(" "), s("chain", 1), right(F.col("resseq"), 4), s("icode", 1), F.lit("   "), fixed("x", 8, 3, 0.0), fixed("y", 8, 3, 0.0), fixed("z", 8, 3, 0.0), fixed("occ", 6, 2, 1.0), fixed("b", 6, 2, 0.0), F.lit(" " * 6), s("segid", 4), right(F.col("element"), 2), s("charge", 2))


def feature_to_bfactor(df: DataFrame, features: list[str]) -> DataFrame:
    """One structure a feature, with a hundred times its value in the b-factor column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f) * 100).alias("b")) for f in features)))
    return df.select(*[c for c in df.columns if c not in (*features, "b")], pairs.alias("_f")).select("*", "_f.feature", "_f.b").drop("_f")


def write_structures(df: DataFrame, path: str, by: str = "path", dealt: bool = False) -> None:
    """One folder a structure, its lines in order. ``dealt``: rows of a structure are in one task already."""
    rows = df.select(by, "line_no", render(df).alias("value"))
    write_text_files(rows, path, [by], "line_no", dealt=dealt)


def write_tables(df: DataFrame, path: str, by: str = "c") -> None:
    """Replaces the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def list_structures(spark: SparkSession, path: str, glob: str = "*.{pdb,cif,mmtf}") -> DataFrame:
    with few_listing_tasks(spark):
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def listed_structures(inventory: DataFrame, names: DataFrame, name: str = "line") -> DataFrame:
    """Of an inventory of files those that a text file names, a path (its last folder and file count) or a file name a line;
    blank lines and ``#`` lines don't count."""
    tail = lambda c, n: F.array_join(F.slice(F.split(c, "/"), -n, n), "/")
    wanted = names.select(F.trim(name).alias("n")).where("n != '' and not startswith(n, '#')").select(F.when(F.col("n").contains("/"), tail("n", 2)).otherwise(F.col("n")).alias("key")).distinct()
    found = inventory.select("path", F.explode(F.array(tail("path", 1), tail("path", 2))).alias("key")).join(wanted, "key", "left_semi").select("path").distinct()
    return inventory.join(found, "path", "left_semi")


def coded_structures(inventory: DataFrame) -> DataFrame:
    """Files of a folder with a folder for each code: the code next to the path."""
    return inventory.withColumn("code", F.element_at(F.split("path", "/"), -2))


def split_structures(df: DataFrame, path: str, by: tuple[str, ...], dealt: bool = False) -> None:
    """The lines of each chain, model or segment (columns ``by``, all in one pass) of each structure in a folder of its own, in
    order. ``dealt``: rows of a structure are in one task already."""
    rows = df.select("path", "line_no", F.col("line").alias("value"), *(F.trim(F.col(c).cast("string")).alias(c) for c in by))
    write_text_files(rows, path, ["path"], "line_no", splits=by, dealt=dealt)


def read_split_structures(spark: SparkSession, path: str) -> DataFrame:
    """What ``split_structures`` wrote, a line a row: value, by (the column), path and part, as text."""
    return read_text_files(spark, path, ["by", "path", "part"], level=1)


def compact(spark: SparkSession, source: str, path: str, parts: int = 20, by: str | None = None) -> None:
    """A table of many small files as one of ``parts`` files, or a file for each value of ``by`` and part."""
    rows = spark.read.parquet(source).repartition(parts)
    (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").parquet(path)


def write_interactions(df: DataFrame, path: str) -> None:
    """The interaction table twice: in order of the structures, and in folders by family."""
    df.repartitionByRange("pdb").sortWithinPartitions("pdb").write.mode("overwrite").parquet(f"{path}/by_pdb")
    df.repartition("cath_code").write.partitionBy("cath_code").mode("overwrite").parquet(f"{path}/by_family")


def read_assembly(lines: DataFrame) -> DataFrame:
    """The matrices of the first biological assembly from ``REMARK 350`` lines (path, line_no, line): a row for each of three
    axes of a copy, with its factors and shift."""
    remark = lines.where(F.col("line").startswith("REMARK 350")).select("path", "line_no", F.substring("line", 12, 80).alias("text"))
    n = F.sum(F.col("text").startswith("BIOMOLECULE:").cast("int")).over(Window.partitionBy("path").orderBy("line_no"))
    p = F.split(F.trim("text"), r"\s+")
    rows = remark.withColumn("molecule", n).where(F.col("text").startswith("  BIOMT") & (F.col("molecule") <= 1))
    return rows.select("path", p[1].try_cast("int").alias("copy"), F.substring(p[0], 6, 1).try_cast("int").alias("axis"), *(p[k + 2].try_cast("double").alias(c) for k, c in enumerate("abct")))


def read_domain_list(lines: DataFrame) -> DataFrame:
    """Blank-separated lists of domains; ``#`` starts a comment line. Column ``line`` in, one row a domain out."""
    p = F.split(F.trim("line"), r"\s+")
    names = ("c", "a", "t", "h", "s", "o", "l", "i", "d", "domain_length")
    out = lines.where(~F.trim("line").startswith("#") & (F.trim("line") != "")).select(p[0].alias("cath_domain"), *(p[k + 1].try_cast("int").alias(n) for k, n in enumerate(names)), p[11].try_cast("double").alias("resolution"))
    code = F.concat_ws(".", "c", "a", "t", "h")
    return out.withColumns({"cath_code": code, "h5_key": F.concat(F.lit("/"), F.translate(code, ".", "/"))})


def read_hierarchy_names(lines: DataFrame) -> DataFrame:
    """Code, representative and description, parted by four blanks; the description's first character is dropped."""
    p = F.split("line", " {4}")
    return lines.where(~F.col("line").startswith("#")).select(p[0].alias("cath_code"), p[1].alias("representative"), F.substring(p[2], 2, 1 << 20).alias("description"))


def read_domain_description(spark: SparkSession, path: str) -> DataFrame:
    """Records that end in ``//`` as one row a segment; names that go over several lines are joined."""
    t = spark.read.option("lineSep", "//\n").text(path).where("value like '%DOMAIN %'")
    one = lambda k: F.trim(F.regexp_extract("value", rf"(?m)^{k}\s+(\S+)", 1))
    all_of = lambda k: F.array_join(F.transform(F.regexp_extract_all("value", F.lit(rf"(?m)^{k}\s+(.*)$"), F.lit(1)), F.rtrim), "")
    seg = F.posexplode_outer(F.regexp_extract_all("value", F.lit(r"SRANGE\s+START=(-?\S+)\s+STOP=-?\S+"), F.lit(1)))
    stop = F.regexp_extract_all("value", F.lit(r"SRANGE\s+START=-?\S+\s+STOP=(-?\S+)"), F.lit(1))
    rows = t.select(one("DOMAIN").alias("cath_domain"), one("CATHCODE").alias("cath_code"), *(all_of(k).alias(k.lower()) for k in ("CLASS", "ARCH", "TOPOL", "HOMOL")), one("DLENGTH").try_cast("int").alias("dlength"), stop.alias("_stops"), seg.alias("nseg", "srange_start"))
    return rows.withColumn("srange_stop", F.get("_stops", F.col("nseg"))).withColumn("nseg", F.col("nseg") + 1).drop("_stops")


def read_annotation(lines: DataFrame, kind: str) -> DataFrame:
    """Outputs of external tools by atom or residue, from columns path and line.

    cx: concavity in the b-factor column; pqr: charge and radius, the last two of 10 or 11 fields; pdbqt: atom type;
    frustration: blank-separated table; consurf: grades by position."""
    p = F.split(F.trim("line"), r"\s+")
    if kind == "cx":
        return parse_records(lines).where(F.col("record").isin(*COORDS)).select("path", F.col("serial").alias("serial_number"), F.col("b").alias("cx"))
    if kind == "pqr":
        n = F.size(p)
        return lines.where(F.col("line").rlike("^(ATOM|HETATM)") & n.isin(10, 11)).select("path", p[1].try_cast("long").alias("serial_number"), F.element_at(p, -2).try_cast("double").alias("charge"), F.element_at(p, -1).try_cast("double").alias("radius"))
    if kind == "pdbqt":
        return lines.where(F.col("line").rlike("^(ATOM|HETATM)")).select("path", F.trim(F.substring("line", 7, 5)).try_cast("long").alias("serial_number"), F.trim(F.substring("line", 78, 2)).alias("atom_type"))
    if kind == "frustration":
        return lines.where(~F.col("line").startswith("#") & ~F.col("line").startswith("Res")).select("path", p[0].alias("residue_id"), p[1].alias("chain"), F.element_at(p, -1).try_cast("double").alias("frustration_index"))
    if kind == "consurf":
        return lines.where(p[0].rlike("^[0-9]+$")).select("path", p[0].try_cast("int").alias("position"), p[1].alias("code"), p[2].alias("residue"), p[3].try_cast("double").alias("score"))
    raise ValueError(f"unknown annotation {kind}")


def read_clusters(lines: DataFrame, kind: str) -> DataFrame:
    """``uc``: ten tab-separated columns, of which two mean nothing; ``pairs``: representative and member."""
    p = F.split("line", "\t")
    if kind == "pairs":
        return lines.select(p[0].alias("cluster_representative"), p[1].alias("structure"))
    return lines.select(p[0].alias("record_type"), p[1].try_cast("int").alias("cluster"), p[2].try_cast("int").alias("length"), p[3].try_cast("double").alias("pct_id"), p[4].alias("strand"), p[7].alias("alignment"), p[8].alias("label_query"), p[9].alias("label_target"))


def read_similarity(lines: DataFrame) -> DataFrame:
    p = F.split("line", "\t")
    return lines.select(p[0].alias("chain1"), p[1].alias("chain2"), p[2].try_cast("double").alias("score12"), p[3].try_cast("double").alias("score21"), p[4].try_cast("double").alias("rmsd"))


def read_distances(lines: DataFrame) -> DataFrame:
    """``DIST : i j d`` records, in both directions."""
    pattern = r"^DIST\s*:\s*(\d+)\s+(\d+)\s+(\S+)"
    one = lines.where(F.col("line").rlike(pattern)).select("path", *(F.regexp_extract("line", pattern, k).try_cast(t).alias(n) for k, t, n in ((1, "int", "a"), (2, "int", "b"), (3, "double", "distance"))))
    return one.union(one.select("path", F.col("b").alias("a"), F.col("a").alias("b"), "distance")).distinct()


def read_cluster_log(lines: DataFrame) -> DataFrame:
    """Members of clusters with the centroid of each, from logs (path, line_no, line) with a section of clusters and one of
    centroids, each after a line that names it and before a line of ``=``."""
    w = Window.partitionBy("path").orderBy("line_no")
    named = F.when(F.col("line").contains("Clusters @ Threshold"), "clusters").when(F.col("line").contains("Centroids"), "centroids").when(F.col("line").startswith("INFO  : ="), "end")
    rows = lines.withColumns({"_name": named, "section": F.last(named, True).over(w)}).where("_name is null")
    p = F.split(F.trim("line"), r"\s+")
    at = lambda k, kind="string": F.element_at(p, k).try_cast(kind)
    members = rows.where((F.col("section") == "clusters") & (F.size(p) >= 4) & at(-2, "int").isNotNull()).select("path", at(-4, "int").alias("item"), at(-2, "int").alias("cluster"), at(-1).alias("structure"))
    centres = rows.where((F.col("section") == "centroids") & (F.size(p) >= 6) & at(-6, "int").isNotNull()).select("path", at(-6, "int").alias("cluster"), at(-4, "int").alias("centroid_item"), at(-2, "double").alias("spread"), at(-1).alias("centroid"))
    return members.join(centres, ["path", "cluster"])
