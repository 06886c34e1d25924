"""Column names of a caller's table kept apart from those an operator uses inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shielded(df: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """The table without the columns named like a result, under names of its own, and those names by the old ones."""
    given = df.drop(*results)
    names = {c: f"x{i}x" for i, c in enumerate(given.columns)}
    return given.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], *results) -> DataFrame:
    """The caller's columns under their old names, then the results."""
    return df.select(*[F.col(inner).alias(c) for c, inner in names.items()], *results)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
