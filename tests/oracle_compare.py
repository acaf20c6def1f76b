"""Run a query on Spark and its SQL on DuckDB, and compare the rows without regard to order."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(named, key=repr)


def spark_rows(frame):
    return rows_of(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())
