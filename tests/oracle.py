"""Compares a frame with SQL run by DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted(tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == wanted
