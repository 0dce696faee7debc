"""Side-by-side comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.date()
    return v


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.sql(sql)
    names = sorted(result.columns)
    return names, sorted((tuple(plain(dict(zip(result.columns, row, strict=True))[n]) for n in names) for row in result.fetchall()), key=str)


def actual(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=str)
