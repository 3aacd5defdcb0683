"""Properties and edge cases of operators on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import scalars
from tempora.operators import alignment, cross_asset, ensembles, indicators, metrics, recursive
from tempora.operators.indicators import with_base
from tempora.sources import sinks
from tempora.sources.bars import BAR_SCHEMA, bars_between, normalize_bars
from tempora.streaming import monitor

START = dt.datetime(2024, 1, 1)


def make_bars(spark, closes, symbol="A"):
    rows = [(symbol, START + dt.timedelta(days=k), c, c + 1.0, c - 1.0, c, 10.0 + k) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR_SCHEMA)


def test_warm_up_is_null(spark):
    out = indicators.technical(make_bars(spark, [float(k) for k in range(30)])).orderBy("bar_ts").collect()
    assert [r["sma_20"] is None for r in out].count(True) == 19
    assert out[19]["sma_20"] == pytest.approx(9.5)
    assert out[-1]["rsi_14"] == 100.0


def test_flat_market_has_no_division_by_zero(spark):
    out = indicators.technical(make_bars(spark, [5.0] * 40)).orderBy("bar_ts").collect()
    assert out[-1]["rsi_14"] is None and out[-1]["hist_vol"] == 0.0


def test_empty_bars(spark):
    empty = make_bars(spark, [1.0]).where("false")
    assert indicators.technical(empty).count() == 0
    assert recursive.parabolic_sar(empty).count() == 0


def test_nan_becomes_null(spark):
    bars = normalize_bars(make_bars(spark, [1.0, float("nan"), 2.0]))
    assert bars.where("close is null").count() == 1
    assert bars_between(bars, "2024-01-02", "2024-01-03").count() == 1


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_linear_scan_is_the_recursion_for_any_chunk(spark, chunk):
    x = np.random.default_rng(1).normal(size=50) + 10
    base = with_base(make_bars(spark, [float(v) for v in x]))
    got = [r["e"] for r in recursive.linear_scan(base, {"e": recursive.ema("close", 0.2)}, chunk).orderBy("n").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append(0.2 * v + 0.8 * want[-1])
    assert got == pytest.approx(want)


def test_savitzky_golay_keeps_a_cubic(spark):
    t = np.arange(40) / 10
    bars = make_bars(spark, [float(v) for v in t**3 - t])
    rows = recursive.savitzky_golay(bars).join(bars, ["symbol", "bar_ts"]).where("smooth is not null").collect()
    assert len(rows) == 20 and all(abs(r["smooth"] - r["close"]) < 1e-8 for r in rows)


def test_nearest_asof_prefers_the_earlier_of_two(spark):
    right = spark.createDataFrame([("A", START, 1.0), ("A", START + dt.timedelta(days=2), 2.0)], "symbol string, bar_ts timestamp_ntz, close double")
    left = spark.createDataFrame([("A", START + dt.timedelta(days=1)), ("A", START + dt.timedelta(days=5)), ("B", START)], "symbol string, at timestamp_ntz")
    out = {(r["symbol"], r["at"].day): r["close"] for r in alignment.nearest_asof(left, right, "symbol", "at", "bar_ts", "close").collect()}
    assert out == {("A", 2): 1.0, ("A", 6): 2.0, ("B", 1): None}


def test_lineage_of_long_chains(spark):
    rows = [(k, k - 1 if k else None) for k in range(150)] + [(200, 149), (200, 3), (201, 999), (201, 999), (None, 7)]  # two parents, an unknown one, repeated rows
    out = {r["config_id"]: (r["root"], r["depth"]) for r in alignment.lineage(spark, spark.createDataFrame(rows, "config_id long, parent_id long")).collect()}
    assert out == {**{k: (0, k) for k in range(150)}, 200: (0, 150), 201: (999, 1), None: (None, 0)}
    assert alignment.lineage(spark, spark.createDataFrame([], "config_id long, parent_id long")).count() == 0
    with pytest.raises(ValueError, match="circle"):
        alignment.lineage(spark, spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "config_id long, parent_id long"))


def test_walk_forward_periods_keep_the_purge():
    found = metrics.periods(100, 40, 10, 10, purge=2)
    assert all(c - b == 2 and d - c == 10 for _, _, b, c, d in found) and found[-1][4] <= 100


def test_optimised_weights_are_a_portfolio():
    mu, cov = np.array([0.1, 0.05, 0.02]), np.diag([0.04, 0.01, 0.0025])
    for objective in ("max_sharpe", "min_variance", "max_return"):
        w = cross_asset.optimise(mu, cov, objective)
        assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()
    assert cross_asset.optimise(mu, cov, "min_variance").argmax() == 2
    assert cross_asset.optimise(mu, cov, "max_return")[0] == pytest.approx(1, abs=0.02)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.combination(F.lit(10), F.lit(3)).alias("c"), scalars.permutation(F.lit(5), F.lit(2)).alias("p"), scalars.gcd(F.lit(48), F.lit(18)).alias("g"), scalars.lcm(F.lit(4), F.lit(6)).alias("l"), scalars.round_up_half(F.lit(-2.5), 0).alias("r"), scalars.safe_log(F.lit(-1.0)).alias("n"),
        scalars.half_open_range(F.lit(0.0), F.lit(1.0), F.lit(0.25)).alias("h"), scalars.percentage_change(F.lit(0.0), F.lit(1.0)).alias("i"),
    ).first()
    assert (row["c"], row["p"], row["g"], row["l"], row["r"], row["n"], row["h"]) == (120.0, 20.0, 6, 12, -2.0, None, [0.0, 0.25, 0.5, 0.75])
    assert row["i"] == float("inf")
    with pytest.raises(Exception, match="logarithm"):
        spark.range(1).select(scalars.safe_log(F.lit(-1.0), strict=True)).collect()


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 2.0, 6.0), (4, 3.0, 5.0), (5, 1.0, 5.0)], "k int, a double, b double")
    assert {r["k"] for r in ensembles.pareto(df, "k", ["a", "b"]).collect()} == {1, 2, 5}


def test_sinks_round_trip(spark, tmp_path):
    bars = make_bars(spark, [1.0, 2.0]).unionByName(make_bars(spark, [3.0], "B"))
    sinks.write_bars(bars, f"{tmp_path}/bars")
    sinks.write_bars(make_bars(spark, [9.0], "B"), f"{tmp_path}/bars")
    assert sinks.read_symbol(spark, f"{tmp_path}/bars", "A").count() == 2
    assert sinks.read_symbol(spark, f"{tmp_path}/bars", "B").first()["close"] == 9.0
    for kind in sinks.FORMATS:
        sinks.export(bars, f"{tmp_path}/{kind}", kind)
        assert sinks.load(spark, f"{tmp_path}/{kind}", kind, BAR_SCHEMA).count() == 3
    with pytest.raises(ValueError, match="unknown format"):
        sinks.export(bars, f"{tmp_path}/x", "xml")


def test_stream_and_batch_alerts_agree(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name"), (F.col("user_id") % 4).alias("model_id"), F.col("value").alias("metric_value"))
    batch = {r["event_id"] for r in monitor.threshold_alerts_batch(rows, 60.0).collect()}
    stream = monitor.threshold_alerts(monitor.event_stream(spark, f"{sf_dir}/events.parquet*"), 60.0)
    assert {r["event_id"] for r in monitor.run_to_end(stream, "agree").collect()} == batch and batch
