"""Reports on models against a benchmark and against targets, from return logs (model_id, ts, event_id, strategy, benchmark)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.rolling import div

DAYS = 252


def benchmark_comparison(log: DataFrame) -> DataFrame:
    """Annualised returns and volatilities, beta, alpha, tracking error, information ratio and captures by model."""
    s, b = F.col("strategy"), F.col("benchmark")
    x = s - b
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    side = lambda c: zero(div(F.avg(F.when(c, s)), F.avg(F.when(c, b))))
    out = log.groupBy("model_id").agg(
        (F.avg(s) * DAYS).alias("strategy_return"), (F.avg(b) * DAYS).alias("benchmark_return"), (F.stddev_pop(s) * DAYS**0.5).alias("strategy_volatility"), (F.stddev_pop(b) * DAYS**0.5).alias("benchmark_volatility"),
        (F.stddev_pop(x) * DAYS**0.5).alias("tracking_error"), zero(div(F.avg(x), F.stddev_pop(x)) * DAYS**0.5).alias("information_ratio"), zero(div(F.covar_samp(s, b), F.var_pop(b))).alias("beta"),
        zero(div(F.covar_pop(s, b), F.stddev_pop(s) * F.stddev_pop(b))).alias("correlation"), side(b > 0).alias("up_capture"), side(b < 0).alias("down_capture"),
    )
    return out.withColumns({
        "excess_return": F.col("strategy_return") - F.col("benchmark_return"),
        "alpha": F.col("strategy_return") - F.col("beta") * F.col("benchmark_return"),
        "strategy_sharpe": zero(div("strategy_return", "strategy_volatility")),
        "benchmark_sharpe": zero(div("benchmark_return", "benchmark_volatility")),
    })


def composite_score(mae: Column, direction_percent: Column, sharpe: Column) -> Column:
    """Four tenths accuracy, three tenths direction, three tenths risk-adjusted return, each within 0 and 1."""
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return 0.4 * F.greatest(F.lit(0.0), 1.0 - mae) + 0.3 * direction_percent / 100 + 0.3 * within(sharpe / 2)


def scorecard(log: DataFrame) -> DataFrame:
    """(model_id, mae, direction, sharpe, max_drawdown, consistency, drift, score, advice) by model; consistency and drift over
    the periods' errors; advice names what misses or exceeds its target."""
    e = F.abs(F.col("strategy") - F.col("benchmark"))
    same = (F.signum("strategy") == F.signum("benchmark")).cast("double")
    folds = log.groupBy("model_id", "period_id").agg(F.avg(e).alias("e"), F.sum(e).alias("sum_e"), F.sum(same).alias("same"), F.sum("strategy").alias("s"), F.sum(F.col("strategy") * F.col("strategy")).alias("s2"), F.count(F.lit(1)).alias("n"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    out = folds.groupBy("model_id").agg(
        (F.sum("sum_e") / n).alias("mae"), (100 * F.sum("same") / n).alias("direction"), (div(mean, F.sqrt(F.sum("s2") / n - mean * mean)) * DAYS**0.5).alias("sharpe"),
        (1 - div(F.stddev_pop("e"), F.avg("e"))).alias("consistency"), F.regr_slope("e", F.col("period_id").cast("double")).alias("drift"),
    )
    return out.select("*", composite_score(F.col("mae"), F.col("direction"), F.col("sharpe")).alias("score"), F.array_join(advice(), ";").alias("advice"))


#: Targets of the advice: (name, column, whether it must be above, bound).
ADVICE = (
    ("high_error", "mae", True, 0.02), ("weak_direction", "direction", False, 55.0), ("low_sharpe", "sharpe", False, 1.0), ("inconsistent", "consistency", False, 0.7), ("worsening", "drift", True, 0.001),
    ("good_direction", "direction", True, 65.0), ("excellent_sharpe", "sharpe", True, 2.0), ("consistent", "consistency", True, 0.8),
)


def advice(rules: tuple = ADVICE) -> Column:
    """The names of the rules that hold, in order; `meets_targets` where none does."""
    held = F.array_compact(F.array(*[F.when(F.col(c) > bound if above else F.col(c) < bound, name) for name, c, above, bound in rules]))
    return F.when(F.size(held) == 0, F.array(F.lit("meets_targets"))).otherwise(held)


def tolerance_accuracy(log: DataFrame, percents: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Relative errors of each model in percent: mean, median, largest, the share within each tolerance, and the status by the share within 2%."""
    e = F.abs((F.col("actual") - F.col("prediction")) / F.col("actual")) * 100
    out = log.where("actual != 0").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(e).alias("mean_error"), F.percentile(e, F.lit(0.5)).alias("median_error"), F.max(e).alias("max_error"), *[(100 * F.avg((e <= k).cast("double"))).alias(f"within_{k}") for k in percents]
    )
    return out.withColumn("status", accuracy_status(F.col("within_2")))


def accuracy_status(share: Column) -> Column:
    """Fixed bounds in percent: 90, 80, 70."""
    return F.when(share >= 90, "excellent").when(share >= 80, "good").when(share >= 70, "acceptable").otherwise("needs_improvement")
