"""Whole datasets: a folder with one Parquet table for each of atom, residue, edge, split and representative rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def export_dataset(tables: dict[str, DataFrame], path: str, by: dict[str, str] | None = None) -> None:
    """Writes every table, partitioned by the column named for it. Links between tables are ordinary rows, so order doesn't
    matter."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by[name]) if by and name in by else writer).parquet(f"{path}/{name}")


def load_dataset(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
