"""Compares registered queries with their SQL in DuckDB over the given tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 7) if isinstance(v, float) and math.isfinite(v) else v


def differences(spark_df, con, sql: str) -> str:
    """What differs, or nothing."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(columns)} and {sorted(spark_df.columns)}"
    order = sorted(columns)
    want = sorted(([plain(r[columns.index(c)]) for c in order] for r in found.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in order] for r in spark_df.collect()), key=repr)
    if want == got:
        return ""
    off = [(w, g) for w, g in zip(want, got) if w != g]
    return f"{len(want)} and {len(got)} rows; {len(off)} differ: {off[:2]}"
