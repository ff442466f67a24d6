"""Rows of a query beside those of its SQL, whatever their order."""

from __future__ import annotations

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def assert_same(spark, sf: str, query, sql: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = query(spark, sf)
    names = sorted(df.columns)
    cursor = con.execute(sql)
    at = [[c[0] for c in cursor.description].index(n) for n in names]
    assert len(cursor.description) == len(names)
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    assert got == want
