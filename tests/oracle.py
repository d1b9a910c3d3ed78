"""Compares a query with its SQL, as sorted rows with columns by name."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _key(row):
    return tuple((x is None, str(type(x)) if x is None else "", repr(x) if isinstance(x, float) and math.isnan(x) else x) for x in row)


def same(df, con, sql):
    cols = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*[df[c] for c in cols]).collect()), key=_key)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    theirs = sorted(rel.select(*[f'"{c}"' for c in cols] and [duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=_key)
    assert len(mine) == len(theirs)
    assert mine == theirs
