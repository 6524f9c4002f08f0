"""Compare a registered query with its SQL oracle."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(x)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in names, types, row count and values; empty when equal."""
    problems = []
    rel = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(rel.columns):
        return [f"columns differ: {sorted(set(names) ^ set(rel.columns))}"]
    kinds = {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "double": "DOUBLE",
        "string": "VARCHAR",
        "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
        "timestamp": "TIMESTAMP",
        "date": "DATE",
    }
    duck_types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} / {duck_types[name]}")
    mine = sorted(tuple(_cell(r[n]) for n in names) for r in spark_df.select(*names).collect())
    at = [rel.columns.index(n) for n in names]
    theirs = sorted(tuple(_cell(row[i]) for i in at) for row in rel.fetchall())
    if len(mine) != len(theirs):
        problems.append(f"rows: {len(mine)} / {len(theirs)}")
    only = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    if only:
        a, b = only[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y]
        problems.append(f"{len(only)} rows differ, first: {cells[:6]}")
    return problems
