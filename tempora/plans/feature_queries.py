"""One query for each feature family, and its SQL, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.feature_sets import BASE, FAMILIES, apply
from tempora.sources.bars import BARS_SQL, bars_weekly


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    family = FAMILIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = apply(bars_weekly(spark, sf_dir), name)
        return wide.select("symbol", "bar_ts", *[(F.round(F.col(c).cast("double"), family.digits) + F.lit(0.0)).alias(c) for c in family.out])

    return run


def _sql(name: str) -> str:
    family = FAMILIES[name]
    parts, last = [f"WITH {BARS_SQL}"], "bars"
    for k, stage in enumerate(BASE + family.stages):
        columns = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in stage.items())
        parts.append(f"s{k}_ AS (SELECT *, {columns} FROM {last})")
        last = f"s{k}_"
    out = ", ".join(f"round(({c})::DOUBLE, {family.digits}) + 0.0 AS {c}" for c in family.out)
    return ",\n".join(parts) + f"\nSELECT symbol, bar_ts, {out} FROM {last}"


QUERIES = {name: _query(name) for name in FAMILIES}
ORACLE_SQL = {name: _sql(name) for name in FAMILIES}
