"""Queries of cleaning and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import alignment, cleaning
from tempora.plans import sql as q
from tempora.sources.bars import BARS_SQL, bars_weekly, read

SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _round(df: DataFrame, names: list[str], digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def ohlcv_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.validation(bars_weekly(spark, sf_dir))


def ohlcv_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.issue_list(bars_weekly(spark, sf_dir))


def clean_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cleaning.clean(bars_weekly(spark, sf_dir)), ["capped", "winsorised", "min_max", "standard", "robust", "inverse"])


def targets_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cleaning.targets(bars_weekly(spark, sf_dir)), ["simple", "log_return", "next_close", "next_return"])


def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaning.sequences(bars_weekly(spark, sf_dir))
    return found.select("symbol", "bar_ts", F.size("features").cast("long").alias("steps"), F.get("features", F.lit(0))["close"].alias("first_close"), F.get("features", F.lit(9))["volume"].alias("last_volume"), "target")


def last_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaning.last_sequence(bars_weekly(spark, sf_dir))
    return found.select("symbol", F.posexplode("closes").alias("place", "close"))


def calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cleaning.spine_fill(bars_weekly(spark, sf_dir), 7), ["forward", "backward", "linear"])


def bar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cleaning.summary(bars_weekly(spark, sf_dir)), ["mean", "sd"])


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.quality_score(bars_weekly(spark, sf_dir))


def wide_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = alignment.wide_pivot(bars_weekly(spark, sf_dir), SYMBOLS)
    return wide.select("bar_ts", *[F.col(f"`{s}`").alias(f"s{k}") for k, s in enumerate(SYMBOLS)])


def nearest_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the weekly close nearest to its date in its priority."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), "o_orderdate")
    return alignment.nearest_asof(orders, bars_weekly(spark, sf_dir), "symbol", "o_orderdate", "bar_ts", "close").select("o_orderkey", "close")


def config_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as configs, each derived from the part at half its key."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("config_id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent_id"))
    return alignment.lineage(spark, parts)


def rebalancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by share of orders against weights by share of value, customers' nations as assets."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("symbol"), "c_acctbal")
    w = c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("v"))
    totals = w.agg(F.sum("n").alias("tn"), F.sum("v").alias("tv"))
    shares = w.join(totals).select("symbol", (F.col("n") / F.col("tn")).alias("cw"), (F.col("v") / F.col("tv")).alias("tw"))
    found = alignment.weight_changes(shares.where("cw > 0.035").select("symbol", F.col("cw").alias("weight")), shares.where("tw > 0.035").select("symbol", F.col("tw").alias("weight")))
    return _round(found, ["current", "target", "change"], 9)


_W = "OVER (PARTITION BY symbol ORDER BY bar_ts"
QUERIES = {f.__name__: f for f in (ohlcv_validation, ohlcv_issues, clean_and_scale, targets_and_splits, sequence_windows, last_sequences, calendar_fill, bar_summary, data_quality, wide_closes, nearest_benchmark, config_lineage, rebalancing)}
_VALID = f"""WITH {BARS_SQL}, m AS (SELECT *, abs(close / nullif({q.lag('close')}, 0) - 1) AS jump, date_diff('day', {q.lag('bar_ts')}, bar_ts) AS days, count(*) OVER (PARTITION BY symbol, bar_ts) AS same FROM bars),
u AS (SELECT symbol, days AS usual FROM (SELECT symbol, days, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, days) AS k FROM m WHERE days IS NOT NULL GROUP BY symbol, days) WHERE k = 1),
v AS (SELECT symbol, count(*) AS bars, count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_prices, count_if(high < low) AS high_below_low, count_if(open > high OR open < low) AS open_outside, count_if(close > high OR close < low) AS close_outside,
 count_if(least(open, high, low, close, volume) < 0) AS negative, count_if(jump > 0.5) AS jumps, count_if(same > 1) AS duplicate_times, count_if(days > 2 * usual) AS gaps FROM m JOIN u USING (symbol) GROUP BY symbol)"""
_KINDS = ("null_prices", "high_below_low", "open_outside", "close_outside", "negative", "jumps", "duplicate_times", "gaps")
ORACLE_SQL = {
    "ohlcv_validation": _VALID + " SELECT symbol, bars, " + ", ".join(f"{k}::BIGINT AS {k}" for k in _KINDS) + " FROM v",
    "ohlcv_issues": _VALID + " " + " UNION ALL ".join(f"SELECT symbol, '{k}' AS issue FROM v WHERE {k} > 0" for k in _KINDS),
    "clean_and_scale": f"""WITH {BARS_SQL}, s AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS sd, stddev_pop(close) AS sp, min(close) AS a, max(close) AS b, quantile_cont(close, 0.05) AS p05, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.5) AS md, quantile_cont(close, 0.75) AS q3, quantile_cont(close, 0.95) AS p95 FROM bars GROUP BY symbol),
 j AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bars JOIN s USING (symbol))
 SELECT symbol, bar_ts, CASE WHEN close < lo OR close > hi THEN 1 ELSE 0 END AS iqr_outlier, CASE WHEN abs((close - m) / nullif(sd, 0)) > 3 THEN 1 ELSE 0 END AS z_outlier, round(least(greatest(close, lo), hi), 5) AS capped, round(least(greatest(close, p05), p95), 5) AS winsorised,
 round((close - a) / nullif(b - a, 0), 5) AS min_max, round((close - m) / nullif(sp, 0), 5) AS standard, round((close - md) / nullif(q3 - q1, 0), 5) AS robust, round((close - a) / nullif(b - a, 0) * (b - a) + a, 5) AS inverse FROM j""",
    "targets_and_splits": f"""WITH {BARS_SQL}, x AS (SELECT *, lead(close) {_W}) AS nx, row_number() {_W}) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
 SELECT symbol, bar_ts, round(close / nullif({q.lag('close')}, 0) - 1, 5) AS simple, round(ln(close) - ln({q.lag('close')}), 5) AS log_return, round(nx, 5) AS next_close, round(nx / nullif(close, 0) - 1, 5) AS next_return, CASE WHEN nx > close THEN 1 ELSE 0 END AS direction, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM x""",
    "sequence_windows": f"""WITH {BARS_SQL}, x AS (SELECT *, {q.lag('close', 10)} AS first_close, {q.lag('volume', 1)} AS last_volume, row_number() {_W}) AS k FROM bars) SELECT symbol, bar_ts, 10::BIGINT AS steps, first_close, last_volume, close AS target FROM x WHERE k > 10""",
    "last_sequences": f"""WITH {BARS_SQL}, x AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k FROM bars) SELECT symbol, (10 - k)::INT AS place, close FROM x WHERE k <= 10""",
    "calendar_fill": f"""WITH {BARS_SQL}, l AS (SELECT min(bar_ts) AS a, max(bar_ts) AS b FROM bars), w AS (SELECT unnest(generate_series(a, b, INTERVAL 7 DAY)) AS bar_ts FROM l),
 sp AS (SELECT symbol, bar_ts FROM (SELECT DISTINCT symbol FROM bars), w), g AS (SELECT sp.symbol, sp.bar_ts, b.close FROM sp LEFT JOIN (SELECT * FROM bars WHERE (date_diff('day', TIMESTAMP '1990-01-01', bar_ts) // 7) % 7 <> 0) b ON b.symbol = sp.symbol AND b.bar_ts = sp.bar_ts),
 k AS (SELECT *, row_number() {_W}) AS k FROM g),
 f AS (SELECT *, last_value(close IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fw, first_value(close IGNORE NULLS) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bw, max(CASE WHEN close IS NOT NULL THEN k END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ka, min(CASE WHEN close IS NOT NULL THEN k END) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM k)
 SELECT symbol, bar_ts, close, round(fw, 5) AS forward, round(bw, 5) AS backward, round(coalesce(close, fw + (bw - fw) * ((k - ka) / nullif(kb - ka, 0))), 5) AS linear FROM f""",
    "bar_summary": f"WITH {BARS_SQL} SELECT symbol, count(*) AS bars, min(bar_ts) AS first, max(bar_ts) AS last, round(avg(close), 5) AS mean, round(stddev_samp(close), 5) AS sd, min(close) AS least, max(close) AS most FROM bars GROUP BY symbol",
    "data_quality": f"WITH {BARS_SQL}, x AS (SELECT symbol, (count_if(open IS NULL) + count_if(high IS NULL) + count_if(low IS NULL) + count_if(close IS NULL) + count_if(volume IS NULL)) / (count(*) * 5) AS missing_pct FROM bars GROUP BY symbol) SELECT symbol, missing_pct, greatest(0.0, 1 - missing_pct)::DOUBLE AS quality FROM x",
    "wide_closes": f"WITH {BARS_SQL} SELECT bar_ts, " + ", ".join(f"max(close) FILTER (symbol = '{s}') AS s{k}" for k, s in enumerate(SYMBOLS)) + " FROM bars GROUP BY bar_ts",
    "nearest_benchmark": f"""WITH {BARS_SQL}, b AS (SELECT o_orderkey, o_orderdate, p.bar_ts AS t0, p.close AS v0 FROM orders ASOF LEFT JOIN bars p ON o_orderpriority = p.symbol AND o_orderdate >= p.bar_ts),
 a AS (SELECT o_orderkey, n.bar_ts AS t1, n.close AS v1 FROM orders ASOF LEFT JOIN bars n ON o_orderpriority = n.symbol AND o_orderdate <= n.bar_ts)
 SELECT o_orderkey, CASE WHEN t1 IS NULL OR epoch_us(o_orderdate) - epoch_us(t0) <= epoch_us(t1) - epoch_us(o_orderdate) THEN v0 ELSE v1 END AS close FROM b JOIN a USING (o_orderkey)""",
    "config_lineage": "SELECT p_partkey AS config_id, least(p_partkey, 1)::BIGINT AS root, floor(log2(greatest(p_partkey, 1)))::INT AS depth FROM part",
    "rebalancing": """WITH w AS (SELECT c_nationkey::VARCHAR AS symbol, count(*) / sum(count(*)) OVER () AS cw, sum(greatest(c_acctbal, 0)) / sum(sum(greatest(c_acctbal, 0))) OVER () AS tw FROM customer GROUP BY 1),
 x AS (SELECT symbol, CASE WHEN cw > 0.035 THEN cw ELSE 0 END AS current, CASE WHEN tw > 0.035 THEN tw ELSE 0 END AS target FROM w WHERE cw > 0.035 OR tw > 0.035)
 SELECT symbol, round(current, 9) AS current, round(target, 9) AS target, round(target - current, 9) AS change, CASE WHEN abs(target - current) <= 0.01 THEN 'hold' WHEN target > current THEN 'buy' ELSE 'sell' END AS action FROM x""",
}
