"""Rows of a Spark query and of its SQL on the same Parquet tables, in a comparable form."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb

FOLDER = Path("/root/testdata/sf0.01")


def connect(folder: Path = FOLDER) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in folder.iterdir():
        path = f"{f}/*.parquet" if f.is_dir() else str(f)
        c.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else round(value, 9) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    found = connection.execute(sql)
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
