"""Technical indicators without recursion, each as column expressions over canonical bars.

`with_base` adds what many of them share, so that it is computed once.  `technical` has the primary definitions,
`variants` the alternative conventions (population deviation, flat markets, textbook DM, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import rolling as r


def with_base(bars: DataFrame) -> DataFrame:
    """Adds n (row number), the previous bar, one-bar differences, ret, log_ret, tp (typical price) and tr (true range)."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - r.lag("close")), F.abs(F.col("low") - r.lag("close")))
    return bars.select(
        "*",
        F.row_number().over(r.order()).alias("n"),
        r.diff("close").alias("delta"),
        r.change("close").alias("ret"),
        r.log_return("close").alias("log_ret"),
        tp.alias("tp"),
        tr.alias("tr"),
        r.lag("close").alias("prev_close"),
        r.diff("high").alias("d_high"),
        r.diff("low").alias("d_low"),
        r.diff(tp).alias("d_tp"),
        r.diff((F.col("high") + F.col("low")) / 2).alias("d_mid"),
    )


def rsi(n: int = 14, delta: str = "delta") -> Column:
    """Relative strength by simple means; 100 where nothing fell, null where nothing moved."""
    gain = F.when(F.col(delta) > 0, F.col(delta)).otherwise(F.lit(0.0))
    loss = F.when(F.col(delta) < 0, -F.col(delta)).otherwise(F.lit(0.0))
    up, down = r.sma(gain, n), r.sma(loss, n)
    return F.when((down == 0) & (up > 0), F.lit(100.0)).otherwise(100 - r.div(F.lit(100.0), 1 + r.div(up, down)))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, s = r.sma("close", n), r.std("close", n)
    up, low = mid + k * s, mid - k * s
    return {"bb_mid": mid, "bb_up": up, "bb_low": low, "bb_width": r.div(up - low, mid), "bb_pos": r.div(F.col("close") - low, up - low)}


def stochastic(n: int = 14) -> Column:
    low = r.lowest("low", n)
    return 100 * r.div(F.col("close") - low, r.highest("high", n) - low)


def williams(n: int = 14) -> Column:
    high = r.highest("high", n)
    return -100 * r.div(high - F.col("close"), high - r.lowest("low", n))


def atr(n: int = 14) -> Column:
    return r.sma("tr", n)


def cci(n: int = 20) -> Column:
    return r.div(F.col("tp") - r.sma("tp", n), 0.015 * r.mean_abs_dev("tp", n))


def directional(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds plus_di, minus_di, dx and adx; DM by rises of the high and falls of the low."""
    up, down = F.col("d_high"), -F.col("d_low")
    moved = bars.select("*", F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)).alias("__up"), F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)).alias("__down"))
    di = moved.select("*", (100 * r.div(r.sma("__up", n), r.sma("tr", n))).alias("plus_di"), (100 * r.div(r.sma("__down", n), r.sma("tr", n))).alias("minus_di")).drop("__up", "__down")
    di = di.withColumn("dx", 100 * r.div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return di.withColumn("adx", r.sma("dx", n))


def obv() -> Column:
    """On-balance volume from 0."""
    return r.cumulative(F.signum(F.coalesce("delta", F.lit(0.0))) * F.col("volume"))


def vwap() -> Column:
    return r.div(r.cumulative(F.col("tp") * F.col("volume")), r.cumulative("volume"))


def mfi(n: int = 14) -> Column:
    flow = F.col("tp") * F.col("volume")
    step = F.col("d_tp")
    up = r.total(F.when(step > 0, flow).otherwise(F.lit(0.0)), n)
    down = r.total(F.when(step < 0, flow).otherwise(F.lit(0.0)), n)
    return F.when((down == 0) & (up > 0), F.lit(100.0)).otherwise(100 - r.div(F.lit(100.0), 1 + r.div(up, down)))


def ichimoku() -> dict[str, Column]:
    mid = lambda n: (r.highest("high", n) + r.lowest("low", n)) / 2
    return {"tenkan": mid(9), "kijun": mid(26), "senkou_b_now": mid(52), "chikou": r.lead("close", 26)}


def aroon(n: int = 14) -> dict[str, Column]:
    """Share of the frame since its first maximum and minimum, in percent."""
    top = F.max_by("n", F.struct(F.col("high"), -F.col("n"))).over(r.frame(n))
    bottom = F.min_by("n", F.struct(F.col("low"), F.col("n"))).over(r.frame(n))
    up = r.full(F.col("high"), n, 100.0 * (n - (F.col("n") - top)) / n)
    down = r.full(F.col("low"), n, 100.0 * (n - (F.col("n") - bottom)) / n)
    return {"aroon_up": up, "aroon_down": down, "aroon_osc": up - down}


def donchian(n: int = 20) -> dict[str, Column]:
    high, low = r.highest("high", n), r.lowest("low", n)
    return {"don_up": high, "don_low": low, "don_mid": (high + low) / 2}


def ultimate(a: int = 7, b: int = 14, c: int = 28) -> Column:
    bp = F.col("close") - F.least("low", "prev_close")
    part = lambda n: r.div(r.total(bp, n), r.total("tr", n))
    return 100 * (4 * part(a) + 2 * part(b) + part(c)) / 7


def accumulation() -> Column:
    clv = r.div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    return r.cumulative(clv * F.col("volume"))


def ease_of_movement(n: int = 14) -> Column:
    return r.sma(r.div(F.col("d_mid"), r.div(F.col("volume"), F.col("high") - F.col("low"))), n)


def technical(bars: DataFrame) -> DataFrame:
    """The primary indicators, one wide table over one exchange."""
    base = with_base(bars)
    columns = {
        **{f"sma_{n}": r.sma("close", n) for n in (10, 20, 50, 200)},
        "wma_10": r.wma("close", 10),
        **{f"rsi_{n}": rsi(n) for n in (14, 21, 28)},
        **bollinger(),
        "stoch_k": stochastic(),
        "williams": williams(),
        "atr": atr(),
        "cci": cci(),
        "obv": obv(),
        "vwap": vwap(),
        "mfi": mfi(),
        **ichimoku(),
        **aroon(),
        **donchian(),
        "momentum": r.change("close", 10),
        "roc": 100 * r.change("close", 10),
        "ultimate": ultimate(),
        "hist_vol": r.std("ret", 20) * 252**0.5,
        "vol20": r.std("ret", 20),
        "accumulation": accumulation(),
        "volume_roc": 100 * r.change("volume", 14),
        "ease": ease_of_movement(),
    }
    wide = directional(base.select("*", *[c.alias(k) for k, c in columns.items()]))
    wide = wide.select("*", r.sma("stoch_k", 3).alias("stoch_d"), r.std("vol20", 20).alias("vol_of_vol"), (r.sma("close", 10) - r.sma("close", 20)).alias("__gap"))
    before = r.lag("__gap")
    cross = F.when((F.col("__gap") > 0) & (before <= 0), 1).when((F.col("__gap") < 0) & (before >= 0), -1).otherwise(0)
    senkou = {"senkou_a": r.lag((F.col("tenkan") + F.col("kijun")) / 2, 26), "senkou_b": r.lag("senkou_b_now", 26)}
    return wide.select("*", cross.alias("cross_signal"), *[c.alias(k) for k, c in senkou.items()]).drop("__gap", "senkou_b_now")


def variants(bars: DataFrame) -> DataFrame:
    """Alternative conventions of the same indicators."""
    base = with_base(bars)
    low, high = r.lowest("low", 14), r.highest("high", 14)
    flat = high == low
    change = F.col("delta")
    gain, loss = F.when(change > 0, change).when(change <= 0, F.lit(0.0)), F.when(change < 0, -change).when(change >= 0, F.lit(0.0))
    up, down = r.sma(gain, 14), r.sma(loss, 14)
    mad = r.mean_abs_dev("tp", 20)
    mid = F.col("tp")
    columns = {
        "sma_back": r.sma("close", 20),
        "std_pop": r.std("close", 20, population=True),
        "bbp_up": r.sma("close", 20) + 2 * r.std("close", 20, population=True),
        "bbp_low": r.sma("close", 20) - 2 * r.std("close", 20, population=True),
        "stoch_flat": F.when(flat, F.lit(50.0)).otherwise(100 * r.div(F.col("close") - low, high - low)),
        "williams_flat": F.when(flat, F.lit(-50.0)).otherwise(-100 * r.div(high - F.col("close"), high - low)),
        "rsi_full": F.when(down == 0, F.lit(100.0)).otherwise(100 - r.div(F.lit(100.0), 1 + r.div(up, down))),
        "cci_flat": F.when(mad == 0, F.lit(0.0)).otherwise(r.div(mid - r.sma("tp", 20), 0.015 * mad)),
        "atr_late": F.when(F.col("n") > 14, r.sma("tr", 14)),
        "obv_seeded": r.cumulative(F.when(F.col("n") == 1, F.col("volume")).otherwise(F.signum("delta") * F.col("volume"))),
        "vwap_safe": F.coalesce(vwap(), F.col("tp")),
        "momentum_diff": r.diff("close", 10),
        "roc_safe": F.when(F.col("n") > 10, F.coalesce(100 * r.change("close", 10), F.lit(0.0))),
        "std_10": r.std("close", 10),
        "var_10": r.var("close", 10),
        "slope_10": r.slope("close", 10),
        "pivot": F.col("tp"),
        "r1": 2 * F.col("tp") - F.col("low"),
        "s1": 2 * F.col("tp") - F.col("high"),
        "r2": F.col("tp") + F.col("high") - F.col("low"),
        "s2": F.col("tp") - F.col("high") + F.col("low"),
        "r3": F.col("high") + 2 * (F.col("tp") - F.col("low")),
        "s3": F.col("low") - 2 * (F.col("high") - F.col("tp")),
    }
    wide = base.select("*", *[c.alias(k) for k, c in columns.items()])
    return wide.withColumn("sma_back", F.last("sma_back", True).over(r.onward()))
