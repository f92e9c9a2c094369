"""Rows of a query beside the rows of its SQL in DuckDB."""

import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql, folder=DATA):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else str(v)
    ours = sorted([tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()], key=str)
    order = [columns.index(c) for c in sorted(columns)]
    theirs = sorted([tuple(plain(r[k]) for k in order) for r in found.fetchall()], key=str)
    assert ours == theirs
