"""Run queries and their SQL side by side: ``python -m checks.compare [folder] [query ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from bandrisk.session import local_session
from checks.oracle import ORACLE
from checks.registry import QUERIES, build

TABLES = ("region", "nation", "customer", "supplier", "orders")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """What differs between Spark and the SQL, or None. Columns go by name, rows by value."""
    df = build(name, spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=_sortable)
    result = connection.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    places = [names.index(c) for c in columns]
    expected = sorted((tuple(r[p] for p in places) for r in result.fetchall()), key=_sortable)
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    for got, want in zip(rows, expected):
        for column, a, b in zip(columns, got, want):
            if not _same(a, b):
                return f"{column}: {a!r} against {b!r} in {got} / {want}"
    return None


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = difference(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'FAIL' if found else 'ok':5}{name:28}{time.time() - start:7.2f}s  {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
