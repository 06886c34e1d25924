"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write a scored table as parquet and hand back the stored version."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_customers(df: DataFrame, path: str) -> None:
    """Write a customer table as CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
