"""Holds a query's rows against DuckDB's for the SQL that says the same."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from read_parquet({glob.glob(path + '/*.parquet') if os.path.isdir(path) else [path]})")
    return c


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value) if not isinstance(value, int | str | bool | type(None)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([normal(r[k]) for k in order] for r in rows), key=repr), [columns[k] for k in order]


def differences(df, sql, connection):
    """None if both give the same rows under the same names, else what differs."""
    result = connection.execute(sql)
    there, names = rows_of([d[0] for d in result.description], result.fetchall())
    here, own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if own != names:
        return f"columns {own} and {names}"
    if len(here) != len(there):
        return f"{len(here)} rows and {len(there)}"
    return next((f"{a} and {b}" for a, b in zip(here, there, strict=True) if a != b), None)
