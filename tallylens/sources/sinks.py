"""Exports and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(df: DataFrame, columns: list[str], date: str | None = None) -> DataFrame:
    """Texts of the chosen columns, nulls empty, dates cut to 19 characters."""
    return df.select(*[F.coalesce(F.substring(F.col(c).cast("string"), 1, 19) if c == date else F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
