"""Tables laid out so that one domain, or the domains below a code, are read without the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("atom", "residue", "edge")
#: Bytes of a row group: what a scan of one domain reads, about.
ROW_GROUP = 16_000_000


def _class(code: str) -> F.Column:
    return F.split(F.col(code), r"\.")[0]


def write_level(df: DataFrame, path: str, level: str, code: str = "cath_code", domain: str = "cath_domain", row_group: int = ROW_GROUP, files: int | None = None) -> None:
    """Writes the rows of a level (atom, residue or edge) below ``path``, in a folder for each class (the first part of the
    code); folders that have new rows are replaced, others stay. Rows are dealt to files by ranges of code and domain and
    sorted by them, so that the statistics of files and row groups name few domains, and each row group has a Bloom filter
    of its domains. ``files``: how many ranges, if not as many as Spark's shuffle has. Rows without code are an error."""
    if level not in LEVELS:
        raise ValueError(f"level is one of {', '.join(LEVELS)}")
    bad = F.when(F.col(code).isNull(), F.raise_error(F.lit(f"a row without {code}"))).otherwise(_class(code))
    rows = df.withColumn("class", bad)
    dealt = rows.repartitionByRange(files, "class", code, domain) if files else rows.repartitionByRange("class", code, domain)
    writer = dealt.sortWithinPartitions("class", code, domain).write.mode("overwrite").partitionBy("class")
    options = {"partitionOverwriteMode": "dynamic", "compression": "zstd", "parquet.block.size": str(row_group), f"parquet.bloom.filter.enabled#{domain}": "true"}
    writer.options(**options).parquet(f"{path}/{level}")


def scan(spark: SparkSession, path: str, level: str, code: str | None = None, domain=None, code_col: str = "cath_code", domain_col: str = "cath_domain") -> DataFrame:
    """The rows of a level: all, those below a code (``1.10`` has 1.10 and 1.10.8, not 1.100), those of one domain, or of one
    domain below a code. The class folder is picked by the code, row groups by their statistics and Bloom filters."""
    if level not in LEVELS:
        raise ValueError(f"level is one of {', '.join(LEVELS)}")
    rows = spark.read.option("basePath", f"{path}/{level}").parquet(f"{path}/{level}")
    if code is not None:
        rows = rows.where((F.col("class").cast("string") == code.split(".")[0]) & ((F.col(code_col) == code) | F.col(code_col).startswith(f"{code}.")))
    if domain is not None:
        rows = rows.where(F.col(domain_col) == F.lit(domain))
    return rows.drop("class")
