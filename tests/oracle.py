"""Run a query and its SQL on the same tables and compare their rows."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def both(spark, sf_dir: str, query, sql: str):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    relation = connection(sf_dir).sql(sql)
    names = relation.columns
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    return mine, theirs
