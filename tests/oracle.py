"""Spark results against the queries' SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, columns):
    return sorted(repr(tuple(bytes(x).hex() if isinstance(x, (bytes, bytearray)) else x for x in r)) for r in rows), columns


def same(df, con, text):
    """Whether a DataFrame's rows and columns are those of the SQL text, in any order."""
    rel = con.sql(text)
    names = list(rel.columns)
    columns = sorted(df.columns)
    if sorted(names) != columns:
        return False
    at = [names.index(c) for c in columns]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    return plain(got, columns) == plain([tuple(r[i] for i in at) for r in rel.fetchall()], columns)
