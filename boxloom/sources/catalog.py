"""Catalog scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A parquet catalog table; filter and projection reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str, bounds: tuple[int, int], partitions: int,
              **options: str) -> DataFrame:
    """A live catalog table read in ``partitions`` parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", table)
        .option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
        .option("numPartitions", partitions).load()
    )
