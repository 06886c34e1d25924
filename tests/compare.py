"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_canonical(v) for v in value)
    return value


def _sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def spark_rows(df):
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, statement: str):
    result = con.execute(statement)
    return _sorted_rows([d[0] for d in result.description], result.fetchall())


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def type_differences(df, con, statement: str) -> list[str]:
    result = con.execute(f"DESCRIBE {statement}").fetchall()
    sql_types = {r[0]: r[1] for r in result}
    return [
        f"{c}: {t} / {sql_types.get(c)}"
        for c, t in df.dtypes
        if _KINDS.get(t, t) != sql_types.get(c)
    ]
