"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=key)


def rows_of_sql(c, text: str) -> tuple[list[str], list[tuple]]:
    r = c.execute(text)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=key)


def same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1.0, abs(a), abs(b)))


def check(df, c, text: str) -> None:
    names, got = rows_of(df)
    sql_names, want = rows_of_sql(c, text)
    assert names == sql_names
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (names, a, b)
