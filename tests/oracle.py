"""Spark and DuckDB rows side by side, as multisets of rounded values in the order of column names."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
