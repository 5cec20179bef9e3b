"""Run a registered query next to its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql):
    found = connection.execute(sql)
    return _sorted([d[0] for d in found.description], found.fetchall())


# How a Spark type appears in DuckDB.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def spark_types(df):
    return {name: TYPES.get(kind, kind) for name, kind in df.dtypes}


def sql_types(connection, sql):
    return {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
