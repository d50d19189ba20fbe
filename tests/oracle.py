"""A query's rows against those of its SQL."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def compare(df, sql, sf_dir):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = connect(sf_dir).execute(sql)
    there = [c[0] for c in cursor.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(r[there.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
