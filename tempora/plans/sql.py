"""Pieces of DuckDB SQL for the oracle queries: framed windows by (symbol, bar_ts)."""

from __future__ import annotations

P = "PARTITION BY symbol ORDER BY bar_ts"


def over(n: int, end: int = 0) -> str:
    first, last = n - 1 - end, -end
    return f"OVER ({P} ROWS BETWEEN {first} PRECEDING AND {'CURRENT ROW' if not last else f'{last} PRECEDING'})"


def agg(f: str, x: str, n: int, end: int = 0) -> str:
    return f"CASE WHEN count({x}) {over(n, end)} = {n} THEN {f.format(x)} {over(n, end)} END"


def avg(x: str, n: int) -> str:
    return agg("avg({})", x, n)


def total(x: str, n: int) -> str:
    return agg("sum({})", x, n)


def std(x: str, n: int) -> str:
    return agg("stddev_samp({})", x, n)


def high(x: str, n: int) -> str:
    return agg("max({})", x, n)


def low(x: str, n: int) -> str:
    return agg("min({})", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def cum(x: str) -> str:
    return f"sum({x}) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rounded(columns: dict[str, str], digits: int = 4, keys: str = "symbol, bar_ts") -> str:
    return ", ".join([keys, *[f"round({v}, {digits}) AS {k}" for k, v in columns.items()]])


def named(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())
