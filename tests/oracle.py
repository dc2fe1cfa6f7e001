"""Compares a Spark result with DuckDB's for the same tables, whatever the order of rows."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def duck(sql, columns, sf_dir=SF):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    return sorted((tuple(plain(dict(zip(names, r, strict=True))[n]) for n in columns) for r in found.fetchall()), key=lambda r: [(v is None, str(v)) for v in r])


def agree(df, sql, sf_dir=SF):
    columns = sorted(df.columns)
    assert rows(df, columns) == duck(sql, columns, sf_dir)
