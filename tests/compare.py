"""Running a query and its check side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def check_rows(con, sql: str):
    result = con.execute(sql)
    given = [d[0] for d in result.description]
    names = sorted(given)
    order = [given.index(n) for n in names]
    return names, sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def difference(df, con, sql: str) -> str | None:
    """The first difference between the two, or None."""
    left_names, left = spark_rows(df)
    right_names, right = check_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            pairs = [(n, x[:300], y[:300]) for n, x, y in zip(left_names, a, b) if x != y]
            return f"row differs: {pairs[:4]}"
    return None
