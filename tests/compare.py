"""A query's rows held against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}" if value else "0"
    return str(value)


def mismatch(df, sql: str, sf_dir: str) -> str | None:
    """What differs between the rows of ``df`` and those of ``sql``, in any order; None if nothing does."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    own = sorted(tuple(_cell(row[c]) for c in order) for row in df.collect())
    other = sorted(tuple(_cell(dict(zip(names, row))[c]) for c in order) for row in found.fetchall())
    if own == other:
        return None
    return f"{len(own)} and {len(other)} rows; " + "; ".join(f"{a} <> {b}" for a, b in zip(own, other) if a != b)[:600]
