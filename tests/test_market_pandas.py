"""Feature columns against an independent pandas restatement on awkward series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom import schemas as S
from barloom.plans import market as M


def bars_of(code, close, high=None, low=None, open_=None, volume=None, amount=None):
    n = len(close)
    close = np.asarray(close, dtype=float)
    high = close + 1 if high is None else np.asarray(high, dtype=float)
    low = close - 1 if low is None else np.asarray(low, dtype=float)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in range(n)]
    return pd.DataFrame({
        "trade_date": days, "index_code": code, "open": close if open_ is None else open_, "high": high,
        "low": low, "close": close, "volume": np.full(n, 10.0) if volume is None else volume,
        "amount": np.full(n, 5.0) if amount is None else amount})


def rng_walk(n, seed):
    r = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))


def cases():
    r = np.random.default_rng(3)
    walk = rng_walk(150, 1)
    gap = rng_walk(120, 2)
    gap[40] = np.nan
    lead = rng_walk(100, 4)
    lead[:5] = np.nan
    spread = np.abs(r.normal(1, 0.5, 150))
    return {
        "walk": bars_of("walk", walk, walk + spread, walk - spread, walk + r.normal(0, 0.3, 150),
                        r.uniform(1, 9, 150), r.uniform(1, 9, 150)),
        "gap": bars_of("gap", gap), "lead": bars_of("lead", lead),
        "short": bars_of("short", rng_walk(30, 5)),
        "flat_range": bars_of("flat_range", rng_walk(90, 6), high=rng_walk(90, 6), low=rng_walk(90, 6)),
        "zero_volume": bars_of("zero_volume", rng_walk(90, 7), volume=np.zeros(90)),
        "up": bars_of("up", np.arange(1.0, 101.0)),
        "alternating": bars_of("alternating", [100 + (i % 2) for i in range(100)]),
    }


def restated(df):
    """The formulas again, written directly on pandas."""
    C, H, L, V = df.close, df.high, df.low, df.volume
    out = pd.DataFrame(index=df.index)
    ret = C / C.shift(1) - 1
    out["ret_1d"], out["ret_10d"] = ret, C / C.shift(10) - 1
    ma20, ma60, sd = C.rolling(20).mean(), C.rolling(60).mean(), C.rolling(20).std()
    out["ma20_gap"] = C / ma20 - 1
    d = C.diff()
    gain, loss = d.clip(lower=0).rolling(14).mean(), (-d).clip(lower=0).rolling(14).mean()
    out["rsi14"] = 100 - 100 / (1 + gain / loss.where(loss != 0))
    pc = C.shift(1)
    tr = np.fmax(np.fmax(H - L, (H - pc).abs()), (L - pc).abs())
    out["atr14"] = tr.rolling(14).mean() / C
    out["boll_width"] = 4 * sd / ma20
    out["volatility_20d"] = ret.rolling(20).std()
    v_sd = V.rolling(20).std()
    out["volume_zscore_20d"] = ((V - V.rolling(20).mean()) / v_sd.where(v_sd != 0))
    out["volume_percentile_60d"] = V.rolling(60).rank(pct=True)
    out["drawdown_60d"] = C / C.rolling(60).max() - 1
    ema = {n: C.ewm(span=n, adjust=False).mean() for n in (12, 26, 50)}
    out["macd"] = ema[12] - ema[26]
    out["macd_signal"] = out.macd.ewm(span=9, adjust=False).mean()
    out["expma12_gap"] = ema[12] / ema[50] - 1
    lo, hi = L.rolling(9, min_periods=1).min(), H.rolling(9, min_periods=1).max()
    rsv = (C - lo) / (hi - lo).where(hi != lo) * 100
    out["kdj_k"] = rsv.ewm(alpha=1 / 3, adjust=False).mean()
    out["kdj_d"] = out.kdj_k.ewm(alpha=1 / 3, adjust=False).mean()
    tp = (H + L + C) / 3
    md = (tp - tp.rolling(14).mean()).abs().rolling(14).mean()
    out["cci14"] = (tp - tp.rolling(14).mean()) / (0.015 * md.where(md > 1e-12))
    out["wr14"] = (H.rolling(14).max() - C) / (H.rolling(14).max() - L.rolling(14).min()) * -100
    rr = (H - L).where(H != L) / C
    out["large_range_day"] = (rr > rr.rolling(60).quantile(0.8)).astype(int)
    out["gap_up"] = (df.open > pc * 1.005).astype(int)

    def run(mask):
        count, res = 0, []
        for m in mask.fillna(False):
            count = count + 1 if m else 0
            res.append(float(count))
        return res

    out["above_ma20_days"] = run(C > ma20)
    s20, s60 = ma20 / ma20.shift(5) - 1, ma60 / ma60.shift(10) - 1
    votes = sum(np.where(x, 1, -1) for x in (C > ma20, C > ma60, s20 > 0, s60 > 0))
    known = ma20.notna() & ma60.notna() & s20.notna() & s60.notna()
    out["regime_trend_score"] = pd.Series(votes, index=df.index, dtype=float).where(known)
    state = np.where(out.regime_trend_score >= 2, 1, np.where(out.regime_trend_score <= -2, -1, 0))
    days, prev, count = [], 0, 0
    for x in state:
        count = count + 1 if x == prev else 1
        days.append(float(count) if x else 0.0)
        prev = x
    out["regime_state_days"] = days
    return out.replace([np.inf, -np.inf], np.nan)


@pytest.fixture(scope="module")
def features(spark):
    # all series at once, interleaved and shuffled
    raw = pd.concat(cases().values()).sample(frac=1, random_state=0)
    raw = raw.astype(object).where(raw.notna(), None)
    df = spark.createDataFrame(raw, "trade_date date, index_code string, open double, high double, low double, "
                                    "close double, volume double, amount double")
    return M.market_features(df, "walk", {"relative_hs300": "gap", "relative_zz500": "up", "relative_cyb": "none"}) \
        .toPandas().sort_values(["index_code", "trade_date"])


@pytest.mark.parametrize("name", list(cases()))
def test_formulas(features, name):
    got = features[features.index_code == name].reset_index(drop=True)
    want = restated(cases()[name].reset_index(drop=True))
    assert len(got) == len(want)
    for col in want:
        if name == "alternating" and col in ("cci14",):
            continue  # division of rounding noise
        np.testing.assert_allclose(got[col].astype(float), want[col].astype(float), rtol=1e-7, atol=1e-7,
                                   err_msg=f"{name}.{col}")


def test_no_nan_and_all_columns(features):
    assert set(S.MARKET_FEATURES) <= set(features.columns)
    flags = features[["doji", "gap_up", "is_bull_trend", "macd_golden_cross"]]
    assert flags.notna().all().all() and set(np.unique(flags)) <= {0, 1}


def test_relative_strength_is_per_date(features):
    merged = features.pivot(index="trade_date", columns="index_code", values="relative_hs300")
    first = merged.iloc[50].dropna()
    assert first.nunique() == 1
    assert features.relative_cyb.isna().all()


def test_counts():
    assert len(S.MARKET_FEATURES) == len(set(S.MARKET_FEATURES)) == 93
    assert len(S.event_features()) == 30 and len(S.rolled_event_features()) == 90
    manifest = S.feature_manifest()
    assert len(manifest) == len(set(manifest)) == 211
    assert len(S.SIGNAL_COLUMNS) == 12
