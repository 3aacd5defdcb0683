"""Properties of reports, validation, tracking, detectors and weights on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import adaptive_weights, cross_regimes, detectors, ema_features, monitoring, outlier_analysis, recursive, regime_analysis, reporting, tracking, validation
from tests.test_operators import START, make_bars


def log(spark, rows):
    return spark.createDataFrame([("A", START + dt.timedelta(days=k), *r) for k, r in enumerate(rows)], "symbol string, bar_ts timestamp_ntz, regime string, prediction double, actual double")


def stream(spark, rows):
    return spark.createDataFrame([(m, i, START + dt.timedelta(minutes=30 * k), k, float(v)) for k, (m, i, v) in enumerate(rows)], "metric_name string, model_id long, ts timestamp_ntz, event_id long, metric_value double")


def test_smoothing_overrides_a_lone_label(spark):
    df = log(spark, [(x, 0.0, 0.0) for x in "aaabaacc"])
    got = [(r["smoothed"], r["confidence_factor"]) for r in regime_analysis.smoothed(df).orderBy("bar_ts").collect()]
    assert got == [("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 0.8), ("a", 1.0), ("a", 1.0), ("c", 1.0), ("c", 1.0)]


def test_transitions_compare_old_and_new_regime(spark):
    df = log(spark, [("a", 1.0, 0.0)] * 4 + [("b", 3.0, 0.0)] * 4)
    r = regime_analysis.transitions(df).collect()
    assert len(r) == 1 and (r[0]["before_mae"], r[0]["after_mae"], r[0]["change"]) == (1.0, 3.0, 2.0)


def test_empty_logs(spark):
    empty = log(spark, [("a", 0.0, 0.0)]).where("false")
    for f in (regime_analysis.smoothed, regime_analysis.performance, regime_analysis.summary, regime_analysis.transitions, regime_analysis.distribution):
        assert f(empty).count() == 0
    bars = make_bars(spark, [1.0]).where("false")
    assert ema_features.multi_macd(bars).count() == 0 and cross_regimes.spillover(bars).count() == 0 and detectors.stationarity(bars).count() == 0


def test_benchmark_of_itself(spark):
    rows = [(1, START + dt.timedelta(days=k), k, 0, x, x) for k, x in enumerate([0.01, -0.02, 0.03, -0.01])]
    df = spark.createDataFrame(rows, "model_id int, ts timestamp_ntz, event_id int, period_id int, strategy double, benchmark double")
    r = reporting.benchmark_comparison(df).first()
    assert r["tracking_error"] == 0 and r["information_ratio"] == 0 and r["up_capture"] == r["down_capture"] == 1 and r["beta"] == pytest.approx(4 / 3)


def test_advice_names_what_misses_its_target(spark):
    names = "mae double, direction double, sharpe double, consistency double, drift double"
    df = spark.createDataFrame([(0.01, 60.0, 1.5, 0.75, 0.0), (0.03, 50.0, 0.5, 0.5, 0.01), (0.01, 70.0, 3.0, 0.9, 0.0)], names)
    got = [r[0] for r in df.select(F.array_join(reporting.advice(), ";")).collect()]
    assert got == ["meets_targets", "high_error;weak_direction;low_sharpe;inconsistent;worsening", "good_direction;excellent_sharpe;consistent"]


def test_parameters_and_vectors(spark):
    assert validation.parameter_issues("n", 5, 1, 10, True) == []
    assert validation.parameter_issues("n", 0.5, 1, integer=True) == ["n must be a whole number", "n must be at least 1"]
    assert validation.parameter_issues("n", 11, most=10) == ["n must be at most 10"]
    assert validation.parameter_issues("n", True) == validation.parameter_issues("n", "x") == validation.parameter_issues("n", float("nan")) == ["n must be a finite number"]
    df = spark.createDataFrame([([1.0, 2.0],), ([],), ([1.0, None],), ([float("nan"), float("inf")],)], "x array<double>")
    assert [r[0] for r in df.select(validation.feature_vector_issues(F.col("x"))).collect()] == ["", "empty", "null", "nan;infinite"]


def test_switches_are_the_state_machine(spark):
    rng = np.random.default_rng(3)
    rows = [("m", int(rng.integers(3)), float(rng.integers(100))) for _ in range(400)]
    got = [(r["event_id"], r["from_model"], r["to_model"]) for r in tracking.switches(stream(spark, rows), 45.0, 5, 120).orderBy("event_id").collect()]
    seen, newest, active, since, want = {0: [], 1: [], 2: []}, {}, None, None, []
    for k, (_, i, v) in enumerate(rows):
        seen[i].append(v)
        if len(seen[i]) < 5:
            continue
        mean = sum(seen[i][-5:]) / 5
        newest[i] = mean
        if i != (0 if active is None else active) or mean <= 45 or (since is not None and 30 * (k - since) < 120):
            continue
        best, other = min((v, m) for m, v in newest.items())
        if best < mean:
            want.append((k, i, other))
            active, since = other, k
    assert got == want and len(want) > 5


def test_bounded_history_and_snapshots(spark):
    df = stream(spark, [("m", 1, v) for v in range(20)] + [("m", 2, 5.0)] * 3)
    assert sorted(r["metric_value"] for r in tracking.bounded_history(df, 4).where("model_id = 1").collect()) == [16.0, 17.0, 18.0, 19.0]
    assert {r["model_id"]: r["mean"] for r in tracking.snapshots(df, 10).collect()} == {1: 14.5, 2: float("inf")}


def test_forest_and_neighbours_find_the_lone_value(spark):
    rng = np.random.default_rng(5)
    values = [*rng.normal(10, 1, 300), 60.0]
    df = stream(spark, [("m", 1, v) for v in values])
    scores = {r["event_id"]: r["score"] for r in detectors.isolation_forest(df, "event_id", ["metric_value"]).collect()}
    assert len(scores) == 301 and max(scores, key=scores.get) == 300 and scores[300] > 0.7 > np.median(list(scores.values()))
    factors = {r["event_id"]: (r["factor"], r["outlier"]) for r in detectors.local_outliers(df).collect()}
    assert max(factors, key=factors.get) == 300 and factors[300][1] == 1 and np.median([x for x, _ in factors.values()]) == pytest.approx(1, abs=0.15)
    assert detectors.isolation_forest(df.where("false"), "event_id", ["metric_value"]).count() == 0


def test_unit_root():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=800)
    t, bound = detectors.unit_root_statistic(noise)
    assert t < bound
    t, bound = detectors.unit_root_statistic(np.cumsum(noise))
    assert t > bound and bound == pytest.approx(-2.865, abs=0.01)
    assert np.isnan(detectors.unit_root_statistic(np.ones(50))[0])


def test_weights_are_shares(spark):
    rows = [(i, START + dt.timedelta(hours=k), 10 * k + i, k // 10, float(k), float(k + 1 + i), 1.0 + i + k % 3) for i in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "model_id int, ts timestamp_ntz, event_id int, period_id int, prediction double, actual double, error double")
    for f in (adaptive_weights.volatility_adjusted, adaptive_weights.smoothed_weights, adaptive_weights.tail_weights):
        w = {r["model_id"]: r["weight"] for r in f(df).collect()}
        assert sum(w.values()) == pytest.approx(1) and w[0] > w[2]
    for r in adaptive_weights.bootstrap_interval(df).collect():
        assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1


def test_ledoit_wolf_is_the_known_shrinkage(spark):
    rng = np.random.default_rng(2)
    closes = np.exp(np.cumsum(rng.normal(0, 0.02, (40, 3)), axis=0))
    bars = None
    for j, name in enumerate("ABC"):
        part = make_bars(spark, [float(v) for v in closes[:, j]], name)
        bars = part if bars is None else bars.unionByName(part)
    x = closes[1:] / closes[:-1] - 1
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum()
    beta = sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / n**2
    rho = min(beta, delta) / delta
    want = (1 - rho) * s + rho * mu * np.eye(p)
    for r in cross_regimes.ledoit_wolf(bars).collect():
        assert r["cov"] == pytest.approx(want["ABC".index(r["a"]), "ABC".index(r["b"])]) and r["shrinkage"] == pytest.approx(rho)


def test_stress_lies_around_large_moves(spark):
    closes = [100.0 + 0.1 * (k % 2) for k in range(60)]
    closes[30] = 200.0
    df = make_bars(spark, closes).select("symbol", "bar_ts", F.col("close").alias("y"))
    got = [r["stress"] for r in outlier_analysis.stress(df).orderBy("bar_ts").collect()]
    assert got[26:38] == [0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1] and sum(got) == 11


def test_rolling_correlation_of_one_factor_is_closed_form(spark):
    """Two symbols: the first component of standardised returns has equal loadings and explains (1 + |corr|) / 2."""
    from tempora.operators import cross_asset

    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, (60, 2))
    r[:, 1] += 0.5 * r[:, 0]
    closes = np.vstack([np.ones(2), np.cumprod(1 + r, axis=0)])
    bars = make_bars(spark, [float(v) for v in closes[:, 0]], "A").unionByName(make_bars(spark, [float(v) for v in closes[:, 1]], "B"))
    rows = cross_asset.rolling_pca(bars, ["A", "B"]).where("loading is not null").orderBy("bar_ts", "symbol").collect()
    assert len(rows) == 22 and all(x["loading"] == pytest.approx(0.5**0.5) for x in rows)
    assert rows[0]["explained"] == pytest.approx((1 + abs(np.corrcoef(r[:50].T)[0, 1])) / 2)


def test_fractional_means_are_recursions(spark):
    closes = [float(v) for v in np.random.default_rng(7).normal(50, 5, 40)]
    got = [x["e2_5"] for x in ema_features.fractional_means(make_bars(spark, closes)).orderBy("n").collect()]
    want = [closes[0]]
    for v in closes[1:]:
        want.append(want[-1] + 2 / 3.5 * (v - want[-1]))
    assert got == pytest.approx(want)
    assert recursive.span(2.5) == pytest.approx(2 / 3.5)


def test_degradation_is_its_sql_on_ties_and_nulls(spark, tmp_path):
    from tempora.plans.monitor_queries import ORACLE_SQL, metric_degradation
    from tests import oracle

    # cents whose means' ratios are often ties of the sixth digit or of a threshold; every seventh value of a second model is null
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.choice([0.05, 0.1, 0.14, 0.15, 0.2, 0.35, 1.28], 4000)]
    rows = [(k, START + dt.timedelta(minutes=k // 3), 4 * (k % 5) + k % 2, "view", None if k % 14 == 1 else v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["change"], r["severity"]) for r in metric_degradation(spark, str(tmp_path)).collect()}
    c = oracle.duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == {k: (change, severity) for k, change, severity in c.execute(ORACLE_SQL["metric_degradation"]).fetchall()}
