"""Compare queries with their SQL: rows with columns sorted by name, values as text."""

import glob
import os

import duckdb


def normal(value):
    import datetime
    import decimal

    if isinstance(value, (float, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def sql_rows(con, sql):
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    return names, sorted(tuple(normal(r[i]) for i in at) for r in got.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(normal(r[n]) for n in names) for r in df.collect())
