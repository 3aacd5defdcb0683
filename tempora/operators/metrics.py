"""Backtest aggregates over a prediction log (model_id, ts, event_id, period_id, prediction, actual, error, squared_error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rolling import div


def time_order():
    """Rows of a model by time."""
    return Window.partitionBy("model_id").orderBy("ts", "event_id")


def so_far():
    """Rows of a model up to the current one."""
    return time_order().rowsBetween(Window.unboundedPreceding, 0)


def accuracy(y: str = "actual", p: str = "prediction") -> dict[str, Column]:
    """Error reductions of one group of rows."""
    e = F.col(p) - F.col(y)
    n = F.count(F.lit(1))
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)) * 100)),
        "r2": 1 - div(F.sum(e * e), F.var_pop(y) * n),
        "rho": div(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y)),
        "max_error": F.max(F.abs(e)),
        "bias": F.avg(e),
        "median_error": F.percentile(F.abs(e), F.lit(0.5)),
        **{f"within_{k}": F.avg((F.abs(e) <= k / 100 * F.abs(F.col(y))).cast("double")) for k in (10, 20, 30)},
    }


def with_direction(log: DataFrame) -> DataFrame:
    """Adds the change of prediction and actual against the last row, and whether both have one direction."""
    dp, da = F.col("prediction") - F.lag("prediction").over(time_order()), F.col("actual") - F.lag("actual").over(time_order())
    return log.select("*", dp.alias("dp"), da.alias("da")).select("*", (F.signum("dp") == F.signum("da")).cast("double").alias("same_direction"), (F.col("actual") / 1000 - 0.05).alias("ret"))


def by_model(log: DataFrame) -> DataFrame:
    """All error metrics and the directional accuracy of each model."""
    return with_direction(log).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in accuracy().items()], F.avg("same_direction").alias("direction"))


def by_fold(log: DataFrame) -> DataFrame:
    """Error metrics of each model and period."""
    return with_direction(log).groupBy("model_id", "period_id").agg(F.count(F.lit(1)).alias("n"), *[accuracy()[k].alias(k) for k in ("mae", "rmse", "bias")], F.avg("same_direction").alias("direction"))


def fold_summary(log: DataFrame) -> DataFrame:
    """Mean, median, deviation and extremes of the folds' errors, and the trend of them, by model."""
    folds = by_fold(log)
    return folds.groupBy("model_id").agg(F.count(F.lit(1)).alias("folds"), F.avg("rmse").alias("mean_rmse"), F.percentile("rmse", F.lit(0.5)).alias("median_rmse"), F.stddev_pop("rmse").alias("sd_rmse"), F.min("rmse").alias("best"), F.max("rmse").alias("worst"), F.regr_slope("rmse", F.col("period_id").cast("double")).alias("trend"), F.regr_r2("rmse", F.col("period_id").cast("double")).alias("trend_r2"))


def rolling_errors(log: DataFrame, n: int = 50) -> DataFrame:
    """Error and direction over the last n rows of each model."""
    w = time_order().rowsBetween(-(n - 1), 0)
    enough = F.count(F.lit(1)).over(w) == n
    return with_direction(log).select("model_id", "event_id", F.when(enough, F.avg("error").over(w)).alias("mae"), F.when(enough, F.sqrt(F.avg("squared_error").over(w))).alias("rmse"), F.when(enough, F.avg("same_direction").over(w)).alias("direction"))


def drawdowns(log: DataFrame) -> DataFrame:
    """Adds the compounded level of `ret`, its running peak and the drawdown from it."""
    level = with_direction(log).withColumn("level", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(so_far())))
    return level.withColumn("peak", F.greatest(F.max("level").over(so_far()), F.lit(1.0))).withColumn("drawdown", F.col("level") / F.col("peak") - 1)


def risk(log: DataFrame) -> DataFrame:
    """Return, Sharpe, Sortino, Calmar, profit factor, tails and losing streaks of each model."""
    marked = drawdowns(log).withColumn("__before", F.lag(F.col("ret") < 0).over(time_order()))
    marked = marked.withColumn("__island", F.sum(F.when((F.col("ret") < 0) == F.col("__before"), 0).otherwise(1)).over(so_far()))
    streaks = marked.where("ret < 0").groupBy("model_id", "__island").agg(F.count(F.lit(1)).alias("length")).groupBy("model_id").agg(F.max("length").alias("losing_streak"))
    tails = marked.groupBy("model_id").agg(F.percentile("ret", F.lit(0.05)).alias("var95"), F.percentile("ret", F.lit(0.01)).alias("var99"))
    joined = marked.join(tails, "model_id")
    m, s = F.avg("ret"), F.stddev_pop("ret")
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))))
    out = joined.groupBy("model_id").agg(
        m.alias("mean"), s.alias("sd"), (div(m, s) * 252**0.5).alias("sharpe"), (div(m, down) * 252**0.5).alias("sortino"), F.min("drawdown").alias("max_drawdown"), div(m * 252, -F.min("drawdown")).alias("calmar"),
        div(F.sum(F.greatest("ret", F.lit(0.0))), -F.sum(F.least("ret", F.lit(0.0)))).alias("profit_factor"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
        F.max("var95").alias("var95"), F.max("var99").alias("var99"), F.avg(F.when(F.col("ret") <= F.col("var95"), F.col("ret"))).alias("es95"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"), F.avg(-F.col("drawdown")).alias("pain"),
    )
    return out.join(streaks, "model_id", "left")


def statistics(log: DataFrame) -> DataFrame:
    """Test statistics of the signed errors: Jarque-Bera with its p-value, t, Ljung-Box over 5 lags, runs."""
    e = with_direction(log).withColumn("e", F.col("prediction") - F.col("actual"))
    centred = e.withColumn("d", F.col("e") - F.avg("e").over(Window.partitionBy("model_id")))
    lagged = centred.select("*", *[F.lag("d", k).over(time_order()).alias(f"d{k}") for k in range(1, 6)], F.lag(F.signum("d")).over(time_order()).alias("s1"))
    n = F.count(F.lit(1))
    out = lagged.groupBy("model_id").agg(
        n.alias("n"), F.skewness("e").alias("s"), F.kurtosis("e").alias("k"), div(F.avg("e"), F.stddev_samp("e") / F.sqrt(n)).alias("t"), (1 + F.count_if(F.signum("d") != F.col("s1"))).alias("runs"), *[div(F.sum(F.col("d") * F.col(f"d{k}")), F.sum(F.col("d") * F.col("d"))).alias(f"r{k}") for k in range(1, 6)]
    )
    jb = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    box = F.col("n") * (F.col("n") + 2) * sum((F.col(f"r{k}") ** 2 / (F.col("n") - k) for k in range(2, 6)), F.col("r1") ** 2 / (F.col("n") - 1))
    return out.select("model_id", "n", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_p"), "t", box.alias("ljung_box"), "runs", "r1", "r5")


def paired_test(log: DataFrame) -> DataFrame:
    """(a, b, n, t, cohen_d): paired t on squared errors of every two models, paired by rank in time."""
    ranked = log.select("model_id", "squared_error", F.row_number().over(time_order()).alias("k"))
    one, two = ranked.select(F.col("model_id").alias("a"), "k", F.col("squared_error").alias("x")), ranked.select(F.col("model_id").alias("b"), "k", F.col("squared_error").alias("y"))
    d = F.col("x") - F.col("y")
    n = F.count(F.lit(1))
    return one.join(two, "k").where("a < b").groupBy("a", "b").agg(n.alias("n"), div(F.avg(d), F.stddev_samp(d) / F.sqrt(n)).alias("t"), div(F.avg(d), F.stddev_samp(d)).alias("cohen_d"))


def periods(rows: int, train: int, test: int, step: int, purge: int = 0, embargo: int = 0, expanding: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(period, train_from, train_to, test_from, test_to), ends exclusive, of a walk forward over `rows` rows."""
    out, start, k = [], 0, 0
    while start + train + purge + test <= rows:
        first = start + train + purge
        out.append((k, 0 if expanding else start, start + train, first, first + test))
        start, k = start + step + embargo, k + 1
    return out


def walk_forward(bars: DataFrame, train: int = 60, test: int = 20, step: int = 20, purge: int = 2) -> DataFrame:
    """A one-factor least-squares forecast (return on last return), fitted on each period's train rows and applied to its test rows.

    A row's periods follow from its number by arithmetic: period p trains on rows [p * step, p * step + train) and tests on the
    `test` rows after the purge, where the longest series has all of these.
    """
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    base = bars.select("symbol", "bar_ts", (div("close", F.lag("close").over(w)) - 1).alias("ret"), (F.row_number().over(w) - 1).alias("k"))
    base = base.withColumn("x", F.lag("ret").over(w))
    longest = base.agg(F.max("k")).first()[0] or 0
    last = (longest + 1 - train - purge - test) // step

    def within(offset: int, length: int) -> Column:
        first, final = F.greatest(F.ceil((F.col("k") - offset - length + 1) / step), F.lit(0)).cast("int"), F.least(F.floor((F.col("k") - offset) / step), F.lit(last)).cast("int")
        return F.when(final >= first, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))

    known = base.where("x is not null and ret is not null")
    joined = known.select("*", F.explode(within(0, train)).alias("period"), F.lit("train").alias("side")).unionByName(known.select("*", F.explode(within(train + purge, test)).alias("period"), F.lit("test").alias("side")))
    model = joined.where("side = 'train'").groupBy("symbol", "period").agg(F.regr_slope("ret", "x").alias("slope"), F.regr_intercept("ret", "x").alias("intercept"), F.count(F.lit(1)).alias("train_rows"))
    test_rows = joined.where("side = 'test'").join(model, ["symbol", "period"])
    return test_rows.select("symbol", "period", "bar_ts", "train_rows", (F.col("intercept") + F.col("slope") * F.col("x")).alias("prediction"), F.col("ret").alias("actual"))
