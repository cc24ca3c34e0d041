"""Compare a query with its SQL twin."""

import math
import os

import duckdb


def twin(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def same(df, sf_dir: str, sql: str) -> None:
    names, rows = twin(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in rows)
    assert mine == theirs
