"""Runs a registered query in Spark and its SQL in DuckDB on the same tables, and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET threads=2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, list):
        return tuple(plain(v) for v in x)
    return x


def key(row):
    return tuple((x is not None, round(x, 3) if isinstance(x, float) else x) for x in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-9)
    return a == b


def differences(df, sql: str, sf_dir: str, most: int = 5) -> list[str]:
    """What differs between a DataFrame and the SQL's result; nothing if the rows are the same."""
    names, rows = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rows), key=key)
    out = [] if len(got) == len(want) else [f"{len(got)} rows and {len(want)}"]
    for g, w in zip(got, want, strict=False):
        if not all(same(x, y) for x, y in zip(g, w, strict=True)):
            out.append(f"{dict(zip(order, g, strict=True))} and {dict(zip(order, w, strict=True))}")
            if len(out) >= most:
                break
    return out
