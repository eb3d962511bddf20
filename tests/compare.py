"""Order-free comparison of a Spark query with its SQL on the same tables."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (1, repr(value + 0.0))
    if isinstance(value, bool):
        return (1, repr(value))
    return (1, str(value))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        sorted(columns),
        sorted(tuple(_cell(r[i]) for i in order) for r in records),
    )


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())
