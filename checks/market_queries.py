"""Market feature families: Spark query and DuckDB SQL side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import schemas as S
from barloom.plans import market as M
from checks import fixtures as fx
from checks import oracle_views as ov

KEYS = ["trade_date", "index_code"]
INTS = {"regime_trend_score", "upper_probe", "lower_probe", "doji", "long_upper_shadow", "long_lower_shadow",
        "heavy_upper_shadow", "heavy_lower_shadow", "gap_up", "gap_down", "large_range_day",
        "macd_golden_cross", "macd_dead_cross", "macd_hist_turn_positive", "macd_hist_turn_negative",
        "kdj_golden_cross", "kdj_dead_cross", "kdj_j_overbought", "kdj_j_oversold",
        "kdj_j_overbought_turn_down", "expma_golden_cross", "expma_dead_cross", "cci14_overbought",
        "cci14_turn_down", "cci14_overbought_turn_down", "ma20_slope_5d_negative",
        "ma60_slope_10d_negative", "close_above_ma20", "close_above_ma60", "is_bull_trend",
        "is_bear_trend", "down_with_volume", "up_with_volume", "shrink_rebound", "boll_lower_break",
        "boll_upper_break"}

ROLLING_FAMILIES = {
    "returns": ["ret_1d", "ret_3d", "ret_5d", "ret_10d"],
    "ma_gap": ["ma5_gap", "ma10_gap", "ma20_gap"],
    "rsi": ["rsi6", "rsi14"],
    "atr_boll": ["atr14", "atr_expand", "boll_width", "boll_lower_break", "boll_upper_break",
                 "boll_band_position"],
    "volatility": ["volatility_5d", "volatility_10d", "volatility_20d", "volatility_expand"],
    "zscores": ["amount_zscore_20d", "volume_zscore_20d", "volume_ratio_5d_20d"],
    "candle_shape": ["upper_shadow_ratio", "lower_shadow_ratio", "body_ratio", "intraday_range"],
    "candle_flags": ["upper_probe", "lower_probe", "doji", "long_upper_shadow", "long_lower_shadow",
                     "heavy_upper_shadow", "heavy_lower_shadow"],
    "gap_flags": ["gap_up", "gap_down"],
    "range_quantile_flag": ["large_range_day"],
    "pct_rank_60": ["amount_percentile_60d", "volume_percentile_60d"],
    "cci_wr": ["cci14", "cci14_overbought", "cci14_turn_down", "cci14_overbought_turn_down", "wr14"],
    "ma_slopes": ["ma20_slope_5d", "ma60_slope_10d", "ma20_slope_5d_negative", "ma60_slope_10d_negative",
                  "close_above_ma20", "close_above_ma60", "ma20_ma60_gap"],
    "islands": ["above_ma20_days", "below_ma20_days", "above_ma60_days", "below_ma60_days"],
    "drawdown": ["drawdown_20d", "drawdown_60d"],
    "volume_flags": ["down_with_volume", "up_with_volume", "shrink_rebound"],
    "regime_score": ["regime_trend_score", "is_bull_trend", "is_bear_trend"],
    "regime_days": ["regime_state_days"],
}
EMA_FAMILIES = {
    "macd": ["macd", "macd_signal", "macd_hist"],
    "kdj": ["kdj_k", "kdj_d", "kdj_j", "kdj_k_minus_d", "kdj_j_overbought", "kdj_j_oversold",
            "kdj_j_overbought_turn_down"],
    "expma": ["expma12", "expma50", "expma12_gap"],
    "crossings": ["macd_golden_cross", "macd_dead_cross", "macd_golden_cross_days", "macd_dead_cross_days",
                  "macd_hist_turn_positive", "macd_hist_turn_negative", "kdj_golden_cross",
                  "kdj_dead_cross", "kdj_golden_cross_days", "kdj_dead_cross_days",
                  "expma_golden_cross", "expma_dead_cross", "expma_golden_cross_days",
                  "expma_dead_cross_days"],
}


def spark_cols(names):
    return [F.expr(n if n in INTS else f"round({n}, 6) AS {n}") for n in names]


def duck_cols(names, prefix=""):
    return ", ".join(f"{prefix}{n}" if n in INTS else f"round({prefix}{n}, 6) AS {n}" for n in names)


def _rolling(names):
    def run(spark, sf_dir):
        return M.rolling_features(fx.bars(spark, sf_dir)).select(*KEYS, *spark_cols(names))
    return run


def _ema(names):
    def run(spark, sf_dir):
        df = M.recurrence_features(M.with_recurrences(fx.bars(spark, sf_dir)))
        return df.select(*KEYS, *spark_cols(names))
    return run


def relative_strength(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    df = M.with_relative_strength(bars.select(*KEYS), bars, fx.TARGET, fx.BENCHMARKS)
    return df.select(*KEYS, *spark_cols(S.STYLE_FEATURES))


def market_features(spark, sf_dir):
    df = M.market_features(fx.bars(spark, sf_dir), fx.TARGET, fx.BENCHMARKS)
    return df.select(*KEYS, *spark_cols(S.MARKET_FEATURES))


QUERIES = {
    **{n: _rolling(cols) for n, cols in ROLLING_FAMILIES.items()},
    **{n: _ema(cols) for n, cols in EMA_FAMILIES.items()},
    "relative_strength": relative_strength,
    "market_features": market_features,
}
_own = [n for n in S.MARKET_FEATURES if n not in S.STYLE_FEATURES]
_ema_names = {n for cols in EMA_FAMILIES.values() for n in cols}
ORACLES = {
    **{n: ov.with_(ov.ROLLING) + f"SELECT trade_date, index_code, {duck_cols(cols)} FROM rolling"
       for n, cols in ROLLING_FAMILIES.items()},
    **{n: ov.with_(ov.EMA, recursive=True) + f"SELECT trade_date, index_code, {duck_cols(cols)} FROM ema_cols"
       for n, cols in EMA_FAMILIES.items()},
    "relative_strength": ov.with_(ov.BARS, ov.REL)
    + f"SELECT b.trade_date, b.index_code, {duck_cols(S.STYLE_FEATURES, 'r.')} FROM bars b LEFT JOIN rel r USING (trade_date)",
    "market_features": ov.with_(ov.ROLLING, ov.EMA, ov.REL, recursive=True)
    + "SELECT a.trade_date, a.index_code, "
    + ", ".join(duck_cols([n], {True: "e.", False: "a."}[n in _ema_names]) for n in _own) + ", "
    + duck_cols(S.STYLE_FEATURES, "r.")
    + " FROM rolling a JOIN ema_cols e USING (trade_date, index_code) LEFT JOIN rel r USING (trade_date)",
}
