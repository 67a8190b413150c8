"""Compares a query's rows with those of its SQL in DuckDB, over one folder of tables."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = c.execute(sql)
    columns = [d[0] for d in found.description]
    assert names == sorted(columns)
    assert rows == sorted(repr(tuple(plain(r[columns.index(n)]) for n in names)) for r in found.fetchall())
