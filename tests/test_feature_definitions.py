"""The feature families against definitions written anew in pandas, on one seeded random walk; nothing is shared with the library."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tempora.operators.feature_sets import FAMILIES, apply
from tempora.sources.bars import BAR_SCHEMA

N = 240


def table() -> pd.DataFrame:
    rng = np.random.default_rng(11)
    close = np.round(60 * np.exp(np.cumsum(rng.normal(0, 0.03, N))), 2)
    open_ = np.round(np.append(60.0, close[:-1]) * (1 + rng.normal(0, 0.01, N)), 2)
    high, low = np.round(np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.008, N))), 2), np.round(np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.008, N))), 2)
    high[5], low[9] = max(close[5], open_[5]), min(close[9], open_[9])
    return pd.DataFrame({"bar_ts": [dt.datetime(2023, 12, 20) + dt.timedelta(days=k) for k in range(N)], "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(50, 400, N).astype(float)})


T = table()
o, h, l, c, v = (T[x] for x in ("open", "high", "low", "close", "volume"))  # noqa: E741
ret, lret, delta = c / c.shift() - 1, np.log(c).diff(), c.diff()
gain, loss = delta.where(delta > 0, 0.0), (-delta).where(delta < 0, 0.0)
number = pd.Series(np.arange(1.0, N + 1))


def mean(x, n):
    return x.rolling(n).mean()


def sd(x, n):
    return x.rolling(n).std()


def z(x, n):
    return (x - mean(x, n)) / sd(x, n)


def corr(x, y, n):
    return x.rolling(n).corr(y)


def slope(x, n):
    return x.rolling(n).apply(lambda w: np.polyfit(np.arange(n), w, 1)[0], raw=True)


def rank(x, n):
    return x.rolling(n).rank(method="average", pct=True)


def flag(x):
    """1 where it holds, 0 where it does not or is not known."""
    return x.fillna(False).astype(float)


def either(*cases, other=0.0):
    """The value of the first case that holds."""
    out = pd.Series(np.full(N, other, float))
    for condition, value in reversed(cases):
        out = out.where(~condition.fillna(False).astype(bool), value)
    return out


def rsi(n):
    up, down = mean(gain, n), mean(loss, n)
    return (100 - 100 / (1 + up / down)).where(down != 0, 100.0).where(up.notna())


def run_length(x):
    """Rows since the value last changed, from 1; a row without a value, or after one, begins anew."""
    new = (x != x.shift()) | x.isna()
    return x.groupby(new.cumsum()).cumcount() + 1.0


def pipeline():
    s = {k: mean(c, k) for k in (5, 10, 20, 50)}
    s20 = sd(c, 20)
    out = {"ret": ret, "lret": lret, **{f"vol{k}": sd(ret, k) for k in (5, 10, 20)}, **{f"rsi{k}": rsi(k) for k in (7, 14, 21)}, **{f"ratio{k}": c / s[k] for k in s}, **{f"lag{k}": c.shift(k) for k in (1, 2, 3, 5)}}
    return out | {
        "realised": sd(ret, 20) * 252**0.5, "position": (c - (s[20] - 2 * s20)) / (4 * s20), "width": 4 * s20 / s[20], "volume_ratio": v / mean(v, 20), "price_position": (c - l) / (h - l), "daily_range": (h - l) / c,
        "momentum5": c / c.shift(5), "sma5_20": s[5] / s[20], "vol10_ratio": v / mean(v, 10), "oc_return": c / o - 1, "pvt": (ret * v).cumsum(),
    }


def spread_flow():
    spread, tick, v10 = (h - l) / c, np.sign(c - (h + l) / 2), v.rolling(10).sum()
    net = (tick * v).rolling(10).sum()
    return {
        "spread": spread, "spread_mean": mean(spread, 10), "spread_std": sd(spread, 10), "spread_cv": sd(spread, 10) / mean(spread, 10), "spread_rank": rank(spread, 20), "eff": 2 * ret.abs(), "body": (o - c).abs() / c,
        "vw_ret": (ret * v).rolling(10).sum() / v10, "ofi": np.sign(ret) * z(v, 20), "tick": tick, "signed": tick * v, "net_flow": net, "net_ratio": net / v10, "flow_momentum": net - net.shift(10),
        "buy_pressure": v.where(ret > 0, 0).rolling(10).sum() / v10, "sell_pressure": v.where(ret < 0, 0).rolling(10).sum() / v10,
    }


def rogers_satchell():
    return np.log(h / c) * np.log(h / o) + np.log(l / c) * np.log(l / o)


def impact_volatility():
    k = 0.34 / (1.34 + (N + 1) / (N - 1))
    rs, trend = rogers_satchell(), mean(ret, 10)
    big = flag(ret.abs() > 2 * sd(ret, 20))

    def covariance(t):
        x = ret[t - 50 : t].to_numpy()
        both = np.stack([x[1:], x[:-1]])
        both = both[:, ~np.isnan(both).any(axis=0)]
        return np.cov(both)[0, 1]

    def ratio(t):
        x = lret[t - 20 : t].to_numpy()
        return np.var(x[1:] + x[:-1]) / (2 * np.var(x)) if len(x) == 20 and not np.isnan(x).any() else np.nan

    cov = pd.Series([covariance(t) if t >= 50 else np.nan for t in range(N)])
    return {
        "intraday": (c - o) / o, "gap": o / c.shift() - 1, "impact": ret / np.sqrt(v), "permanent": corr(ret, ret.shift(-5), 50), "gk": 0.5 * np.log(h / l) ** 2 - (2 * np.log(2) - 1) * np.log(c / o) ** 2, "rs": rs,
        "yz": np.log(o / c.shift()) ** 2 + k * np.log(c / o) ** 2 + (1 - k) * rs, "autocorr": ret.rolling(20).apply(lambda w: np.corrcoef(w[1:], w[:-1])[0, 1], raw=True), "vratio": pd.Series([ratio(t) if t >= 20 else np.nan for t in range(N)]),
        "noise": (ret - trend).rolling(50).var() / trend.rolling(50).var(), "cv_corr": corr(c, v, 20), "intensity": v / mean(v, 20), "cluster": either((c % 1 == 0, 1.0), (2 * c % 1 == 0, 0.5), (4 * c % 1 == 0, 0.25)),
        "roll_spread": 2 * np.sqrt((-cov).clip(lower=0)), "reversal": either((np.sign(ret) == -np.sign(ret.shift()), 1.0)).where(big.shift() == 1), "open_close": c / o, "hl_position": (c - l) / (h - l),
        "vap": either((c == h, 1.0), (c == l, -1.0)) * v, "vslope": slope(v, 10), "big": big,
    }


def bollinger():
    m, s = {k: mean(c, k) for k in (10, 20, 50)}, {k: sd(c, k) for k in (10, 20, 50)}
    width = {k: 4 * s[k] / m[k] for k in m}
    pos = {(k, j): (c - (m[k] - j * s[k])) / (2 * j * s[k] + 1e-10) for k in m for j in (1, 2)}
    touch = flag((c >= m[20] + 2 * s[20]) | (c <= m[20] - 2 * s[20]))
    wide, wmean, wsd = width[20], mean(width[20], 50), sd(width[20], 50)
    a = s[20] * (0.5 + 0.5 * sd(ret, 10) / sd(ret, 50))
    above = pd.concat([c > m[k] for k in m], axis=1)
    return {
        **{f"pos{k}_{j}": x for (k, j), x in pos.items()}, **{f"width{k}": x for k, x in width.items()}, "touch": touch, "since_touch": touch.groupby(touch.cumsum()).cumcount().astype(float), "dpos": pos[20, 2].diff(), "d2pos": pos[20, 2].diff().diff(),
        "squeeze": flag(wide < wmean - 0.5 * wsd), "squeeze_depth": (wmean - wide) / wsd, "wratio": width[10] / width[50], "wrank": rank(wide, 50), "wmom": wide / wide.shift() - 1, "wdiff3": wide.diff(3),
        "aligned": flag((above.all(axis=1) | (~above).all(axis=1)) & m[50].notna()), "ad_pos": (c - (m[20] - 2 * a)) / (4 * a),
    }


def rsi_family():
    r, r7 = rsi(14), rsi(7)
    velocity, zone = r.diff(), either((r >= 70, 1.0), (r <= 30, -1.0))
    rz, p10, q10, spread = z(r, 20), slope(c, 10), slope(r, 10), r7 - r
    return {
        "rsi7": r7, "rsi14": r, "rsi21": rsi(21), "smooth": mean(r, 5), "zone": zone, "time_in_zone": run_length(zone), "velocity": velocity, "acceleration": velocity.diff(), "jerk": velocity.diff().diff(), **{f"slope{k}": slope(r, k) for k in (3, 5, 8)},
        "turning": flag((np.sign(velocity) != np.sign(velocity.shift())) & velocity.notna() & velocity.shift().notna()), "rz": rz, "rrank": rank(r, 20), "reversion": either((rz > 2, -1.0), (rz < -2, 1.0)),
        "divergence": either(((p10 > 0) & (q10 < 0), -1.0), ((p10 < 0) & (q10 > 0), 1.0)), "phase_sin": np.sin(2 * np.pi * r / 100), "phase_cos": np.cos(2 * np.pi * r / 100), "phase": np.arctan2(np.sin(2 * np.pi * r / 100), np.cos(2 * np.pi * r / 100)),
        "peak": flag((r > r.shift()) & (r > r.shift(-1))), "spread7_14": spread, "ratio7_14": r7 / r, "crossed": either(((spread > 0) & (spread.shift() <= 0), 1.0), ((spread < 0) & (spread.shift() >= 0), -1.0)),
        "regime": either((r > 60, 2.0), (r > 40, 1.0)), "rvol": sd(r, 10),
    }


def micro():
    accel, body, upper, lower, s5 = delta.diff(), c - o, h - np.maximum(o, c), np.minimum(o, c) - l, sd(ret, 5)
    sign = np.sign(ret)
    flips = flag((sign != sign.shift()) & sign.notna() & sign.shift().notna())
    turn = np.sign(accel)
    return {
        **{f"r{k}": c / c.shift(k) - 1 for k in (1, 2, 3)}, "rz": z(ret, 20), "accel": accel, "jerk": accel.diff(), "turned": flag((turn != turn.shift()) & turn.notna() & turn.shift().notna()), "persistence": run_length(sign), "flip_rate": flips.rolling(10).sum() / 10,
        "doji": flag(body.abs() < 0.1 * (h - l)), "hammer": flag((lower > 2 * body.abs()) & (upper < body.abs())), "star": flag((upper > 2 * body.abs()) & (lower < body.abs())), "gap_up": flag(o > c.shift()),
        "filled": flag(((o > c.shift()) & (l <= c.shift())) | ((o < c.shift()) & (h >= c.shift()))), "body_ratio": body.abs() / (h - l), "upper_ratio": upper / (h - l), "lower_ratio": lower / (h - l), "s3": sd(ret, 3), "s5": s5,
        "volvol": sd(s5, 10), "vratio": sd(ret, 3) / s5, "clustered": flag(s5 > s5.rolling(50).quantile(0.8)),
    }


def liquidity():
    spread, vwap = (h - l) / c, (c * v).rolling(20).sum() / v.rolling(20).sum()
    known = lret.rolling(50).count() == 50
    vr = lambda k: (lret.rolling(k).sum().rolling(50, min_periods=2).var() / (k * lret.rolling(50).var())).where(known)
    ac = {k: corr(ret, ret.shift(k), 50) for k in (1, 2, 3, 5)}
    place = rank(spread, 50)
    return {
        "spread": spread, "spread_ln": spread / np.log(v + 1), "spread_rank": place, "spread_regime": either((place > 0.8, 2.0), (place < 0.2, 0.0), other=1.0), "temporary": (o.shift(-1) - c).abs() / c, **{f"ac{k}": x for k, x in ac.items()},
        "vr2": vr(2), "vr4": vr(4), "rv_corr": corr(ret, v / v.shift() - 1, 50), "pv_corr": corr(c, v, 10), "vbreak": flag(v > mean(v, 20) + 2 * sd(v, 20)), "vwap_dev": (c - vwap) / vwap, "vwap_slope": vwap / vwap.shift(5) - 1,
        "touch": flag((l <= vwap) & (h >= vwap)), "roll": 2 * np.sqrt((-ac[1]).clip(lower=0)).fillna(0), "buy20": v.where(c > o, 0).rolling(20).sum() / v.rolling(20).sum(), "turnover": v / mean(v, 50),
    }


def volatility():
    s20, s50 = sd(ret, 20), sd(ret, 50)
    rv, bv = np.sqrt((ret**2).rolling(20).sum()), np.pi / 2 * (ret.abs() * ret.abs().shift()).rolling(20).sum()
    dd = c / c.cummax() - 1
    q = [s20.rolling(100).quantile(k) for k in (0.2, 0.4, 0.6, 0.8)]
    return {
        "s10": sd(ret, 10), "s20": s20, "s50": s50, "vov": sd(s20, 20), "pk": np.sqrt(mean(np.log(h / l) ** 2, 20) / (4 * np.log(2))), "sk": ret.rolling(20).skew(), "ku": ret.rolling(20).kurt(), "rv": rv, "bv": bv, "jump": (rv - bv).clip(lower=0).fillna(0),
        "var95": ret.rolling(50).quantile(0.05), "parametric": mean(ret, 50) - 1.645 * s50, "dd": dd, "dd50": dd.rolling(50).min(), "vol_regime": sum((s20 > x).astype(float) for x in q).where(q[0].notna()),
        "forecast": 0.05 * s50**2 + 0.1 * ret.shift() ** 2 + 0.85 * s20.shift() ** 2, "vmom": s20 / s20.shift(5) - 1, "vrev": s20 / s50, "vslope": slope(s20, 5), "fz": z(s20, 50), "efficiency": ret.rolling(20).sum().abs() / ret.abs().rolling(20).sum(),
        "shock": flag(ret.abs() > 2 * s20.shift()),
    }


def calendar():
    t = T["bar_ts"].dt
    wave = lambda f, k, x, n: f(2 * np.pi * k * x / n)
    return {
        "hour": t.hour, "month": t.month, "quarter": t.quarter, "dom": t.day, "dow": t.dayofweek, "week": t.isocalendar().week.astype(float), **{f"month_sin{k}": wave(np.sin, k, t.month, 12) for k in (1, 2, 3)}, **{f"month_cos{k}": wave(np.cos, k, t.month, 12) for k in (1, 2, 3)},
        "dow_sin1": wave(np.sin, 1, t.dayofweek, 7), "dow_cos1": wave(np.cos, 1, t.dayofweek, 7), "is_month_start": t.is_month_start, "is_month_end": t.is_month_end, "is_quarter_start": t.is_quarter_start, "is_year_start": t.is_year_start,
        **{f"cycle{k}": np.sin(2 * np.pi * (number - 1) / k) for k in (5, 20, 60)},
    }


def precision():
    med, q1, q3 = (c.rolling(20).quantile(k) for k in (0.5, 0.25, 0.75))
    top, bottom = h.rolling(20).max(), l.rolling(20).min()
    pct = {k: c / c.shift(k) - 1 for k in (2, 3, 5, 10, 20, 50)}
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    m21 = mean(c, 21)
    return {
        **{f"ratio{k}": c / mean(c, k) for k in (8, 13, 21, 34, 55)}, "level": c // 10 * 10, "z20": z(c, 20), "prank": rank(c, 20), "iqr": (q3 - q1) / med, "mad_pos": (c - med) / (q3 - q1), **{f"fib{round(1000 * k)}": (c - (top - k * (top - bottom))) / c for k in (0.236, 0.382, 0.5, 0.618)},
        "maslope": (m21 - m21.shift(5)) / m21, "atr_norm": mean(tr, 14) / c, "sup_dist": 1 - c.shift().rolling(20).min() / c, "res_dist": c.shift().rolling(20).max() / c - 1, "roc_ratio": pct[5] / pct[20], "up_share": flag(delta > 0).rolling(10).sum() / 10,
        "interaction": z(c, 20) * pct[5], "time_corr": corr(c, number, 20), "higher_high": either(((h > h.shift()) & (l > l.shift()), 1.0), ((h < h.shift()) & (l < l.shift()), -1.0)), **{f"pct{k}": x for k, x in pct.items()}, "logp": np.log(c), "rootp": np.sqrt(c),
    }


def engineered():
    o1, c1, body, vol = o.shift(), c.shift(), (c - o).abs(), sd(ret, 10)
    low, high = vol.mean() - vol.std(), vol.mean() + vol.std()
    return {
        "doji": flag(body / o < 0.001), "hammer": flag((np.minimum(o, c) - l > 2 * body) & (h - np.maximum(o, c) < 0.5 * body)), "engulf": either(((c1 < o1) & (c > o) & (o < c1) & (c > o1), 1.0), ((c1 > o1) & (c < o) & (o > c1) & (c < o1), -1.0)),
        "sup": c1.rolling(20).min() / c, "res": c1.rolling(20).max() / c, "strength": corr(number, c, 20), "le_rank": c.rolling(20).apply(lambda w: np.mean(w <= w[-1]), raw=True), "z50": z(c, 50), "sk": ret.rolling(20).skew(), "ku": ret.rolling(20).kurt(), "mn": mean(ret, 20),
        "parkinson": np.sqrt((np.log(h / l) ** 2).rolling(20).sum() / (4 * np.log(2) * 20)), "vprev": v / v.shift().rolling(20).mean(), "cvc": corr(c, v, 20), "vol_regime": either((vol < low, 0.0), (vol > high, 2.0), other=1.0).where(vol.notna()),
        "ac_ahead1": corr(ret, ret.shift(-1), 20), "ac_ahead2": corr(ret, ret.shift(-2), 20), "vov": sd(vol, 10),
    }


def regime_family():
    p = c.shift()
    grown = (1 + ret).shift().rolling(20).apply(np.prod, raw=True) - 1
    vol, m1, m2, s1, s2 = sd(ret, 20).shift(), mean(p, 20), mean(c.shift(21), 20), sd(p, 20), sd(c.shift(21), 20)
    market = either((vol > 0.5, 2.0), (grown > 0.05, 1.0), (grown < -0.05, -1.0)).where(grown.notna())
    r2 = corr(p, number, 20) ** 2
    trend = slope(p, 20) / m1
    q1, q3 = (vol.expanding().quantile(k).shift() for k in (0.25, 0.75))
    stay, counts = [], {}
    for before, now in zip(market.shift(), market, strict=True):
        key = None if np.isnan(before) else before
        kept = counts.setdefault(key, [])
        stay.append(np.mean([x for x in kept if x is not None]) if any(x is not None for x in kept) else np.nan)
        kept.append(None if key is None else float(now == before))
    return {
        "cumret": grown, "vol20": vol, "market": market, "persistence": run_length(market), "vol_regime": either((vol > q3, 2.0), (vol < q1, 0.0), other=1.0).where(vol.notna() & q1.notna()), "trend": trend, "r2": r2,
        "trend_regime": either(((r2 > 0.5) & (trend > 0), 1.0), ((r2 > 0.5) & (trend < 0), -1.0)).where(r2.notna()), "broke": flag(((m1 - m2).abs() > 2 * s2) | (s1 > 2 * s2) | (s1 < 0.5 * s2)).where(m2.notna()), "stay_probability": pd.Series(stay),
    }


DEFINITIONS = {
    "feature_pipeline": pipeline, "microstructure_spread_flow": spread_flow, "microstructure_impact_volatility": impact_volatility, "bollinger_extended": bollinger, "rsi_extended": rsi_family, "micro_patterns": micro,
    "liquidity_extended": liquidity, "volatility_extended": volatility, "calendar_harmonics": calendar, "precision_features": precision, "engineered_features": engineered, "regimes": regime_family,
}


def test_every_family_is_defined_anew():
    assert set(DEFINITIONS) == set(FAMILIES)
    for name, family in FAMILIES.items():
        assert set(family.out) - set(DEFINITIONS[name]()) == set(), name


@pytest.mark.parametrize("name", sorted(DEFINITIONS))
def test_family_is_its_definition(name, spark):
    rows = [("A", r[0].to_pydatetime(), *r[1:]) for r in T[["bar_ts", "open", "high", "low", "close", "volume"]].itertuples(index=False, name=None)]
    got = apply(spark.createDataFrame(rows, BAR_SCHEMA), name).orderBy("bar_ts").select(*FAMILIES[name].out).toPandas()
    wrong = {}
    for column, want in DEFINITIONS[name]().items():
        if column not in FAMILIES[name].out or want is None:
            continue
        a, b = got[column].astype(float).to_numpy(), np.asarray(want, float)
        apart = ~((np.isnan(a) & np.isnan(b)) | np.isclose(a, b, rtol=1e-6, atol=1e-7))
        if apart.any():
            k = int(np.flatnonzero(apart)[0])
            wrong[column] = (int(apart.sum()), k, a[k], b[k])
    assert not wrong
