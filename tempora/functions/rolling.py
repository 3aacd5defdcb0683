"""Column builders over ordered series: every function takes columns and returns a column, so Catalyst sees one plan.

All share one window specification, (symbol, bar_ts), so a family of columns needs a single exchange and sort.
A rolling value is null until its frame is full; division by zero is null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def order():
    """Rows of a symbol by time.  Specifications are made on use, as they need a session."""
    return Window.partitionBy("symbol").orderBy("bar_ts")


def whole():
    """All rows of a symbol."""
    return Window.partitionBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def up_to():
    """Rows of a symbol up to the current one."""
    return order().rowsBetween(Window.unboundedPreceding, 0)


def onward():
    """Rows of a symbol from the current one on, nearest last.  A frame that starts at the partition's edge is kept up row by
    row, where one that ends at its far edge would be read anew for each row."""
    return Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc()).rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(n: int, end: int = 0):
    return order().rowsBetween(end - n + 1, end)


def full(x: Column, n: int, value: Column, end: int = 0) -> Column:
    return F.when(F.count(x).over(frame(n, end)) == n, value)


def sma(x: str | Column, n: int) -> Column:
    return full(col(x), n, F.avg(col(x)).over(frame(n)))


def total(x: str | Column, n: int) -> Column:
    return full(col(x), n, F.sum(col(x)).over(frame(n)))


def std(x: str | Column, n: int, population: bool = False) -> Column:
    return full(col(x), n, (F.stddev_pop if population else F.stddev_samp)(col(x)).over(frame(n)))


def var(x: str | Column, n: int) -> Column:
    return full(col(x), n, F.var_samp(col(x)).over(frame(n)))


def highest(x: str | Column, n: int) -> Column:
    return full(col(x), n, F.max(col(x)).over(frame(n)))


def lowest(x: str | Column, n: int) -> Column:
    return full(col(x), n, F.min(col(x)).over(frame(n)))


def quantile(x: str | Column, n: int, q: float) -> Column:
    return full(col(x), n, F.percentile(col(x), F.lit(q)).over(frame(n)))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(order())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(col(x), n).over(order())


def diff(x: str | Column, n: int = 1) -> Column:
    return col(x) - lag(x, n)


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def change(x: str | Column, n: int = 1) -> Column:
    return div(x, lag(x, n)) - 1


def log_return(x: str | Column, n: int = 1) -> Column:
    return F.ln(col(x)) - F.ln(lag(x, n))


def wma(x: str | Column, n: int) -> Column:
    """Linear weights, the newest heaviest."""
    out = F.lit(0.0)
    for k in range(n):
        out = out + (n - k) * lag(x, k)
    return out / (n * (n + 1) / 2)


def slope(x: str | Column, n: int) -> Column:
    """Least-squares slope over the frame, per row."""
    return full(col(x), n, F.regr_slope(col(x), F.col("n").cast("double")).over(frame(n)))


def corr(x: str | Column, y: str | Column, n: int) -> Column:
    """Pearson correlation; null where either is constant."""
    x, y = col(x), col(y)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    sx, sy = F.stddev_samp(x).over(frame(n)), F.stddev_samp(y).over(frame(n))
    return F.when(F.count(both).over(frame(n)) == n, div(F.covar_samp(x, y).over(frame(n)), sx * sy))


def autocorr(x: str | Column, lagged: str | Column, n: int, k: int = 1) -> Column:
    """Correlation with itself k rows earlier (given as a column), over the n - k pairs inside the frame."""
    return F.when(F.count(col(x)).over(frame(n)) == n, corr(x, lagged, n - k))


def skew(x: str | Column, n: int) -> Column:
    """Bias-corrected skewness."""
    return full(col(x), n, F.skewness(col(x)).over(frame(n)) * ((n * (n - 1)) ** 0.5 / (n - 2)))


def kurt(x: str | Column, n: int) -> Column:
    """Bias-corrected excess kurtosis."""
    return full(col(x), n, ((n + 1) * F.kurtosis(col(x)).over(frame(n)) + 6) * ((n - 1) / ((n - 2) * (n - 3))))


def rank_pct(x: str | Column, n: int) -> Column:
    """Share of the frame at or below the value, ties averaged."""
    values = F.collect_list(col(x)).over(frame(n))
    below = F.size(F.filter(values, lambda v: v < col(x)))
    equal = F.size(F.filter(values, lambda v: v == col(x)))
    return full(col(x), n, (below + (equal + 1) / 2) / n)


def mean_abs_dev(x: str | Column, n: int) -> Column:
    values = F.collect_list(col(x)).over(frame(n))
    mean = F.avg(col(x)).over(frame(n))
    return full(col(x), n, F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / n)


def cumulative(x: str | Column) -> Column:
    return F.sum(col(x)).over(up_to())


def zscore(x: str | Column, n: int) -> Column:
    return div(col(x) - sma(x, n), std(x, n))
