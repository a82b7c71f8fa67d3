"""Runs a query and its SQL side by side."""

import os

import duckdb


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def connect(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    return con


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in at] == names
    wanted = sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    assert got == wanted
    return len(got)
