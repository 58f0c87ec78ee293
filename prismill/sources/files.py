"""Readers and writers of file formats; schemas are given, never inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options: str) -> None:
    """Write a table; csv gets a header, and quotes so that any text comes back as it was."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} isn't one of {FORMATS}")
    defaults = {"csv": {"header": "true", "escape": '"', "nullValue": "\\N", "lineSep": "\n"}, "json": {"ignoreNullFields": "false"}}.get(kind, {})
    w = df.write.format(kind).options(**(defaults | options)).mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def read(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", **options: str) -> DataFrame:
    """Read a table with the given schema; partition columns and filters prune what is read."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} isn't one of {FORMATS}")
    defaults = {"csv": {"header": "true", "escape": '"', "nullValue": "\\N", "multiLine": "true"}}.get(kind, {})
    return spark.read.format(kind).options(**(defaults | options)).schema(schema).load(path)


def bucketed(df: DataFrame, table: str, by: str, buckets: int) -> None:
    """Save as a table dealt by a key, so that later joins and aggregates on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(table)
