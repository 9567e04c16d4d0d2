"""Table layouts, feature names and default settings."""

from __future__ import annotations

# --- Fixed values: feature names by research group. They are the public column
# --- names of the market feature table.
BASIC_FEATURES = [
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "upper_shadow_ratio", "lower_shadow_ratio", "body_ratio",
    "intraday_range", "upper_probe", "lower_probe", "doji", "long_upper_shadow", "long_lower_shadow",
    "heavy_upper_shadow", "heavy_lower_shadow", "gap_up", "gap_down", "large_range_day",
]
TECHNICAL_FEATURES = [
    "ma5_gap", "ma10_gap", "ma20_gap", "macd", "macd_signal", "macd_hist", "macd_golden_cross",
    "macd_dead_cross", "macd_golden_cross_days", "macd_dead_cross_days", "macd_hist_turn_positive",
    "macd_hist_turn_negative", "rsi6", "rsi14", "kdj_k", "kdj_d", "kdj_j", "kdj_k_minus_d",
    "kdj_golden_cross", "kdj_dead_cross", "kdj_golden_cross_days", "kdj_dead_cross_days",
    "kdj_j_overbought", "kdj_j_oversold", "kdj_j_overbought_turn_down", "expma12", "expma50",
    "expma12_gap", "expma_golden_cross", "expma_dead_cross", "expma_golden_cross_days",
    "expma_dead_cross_days", "cci14", "cci14_overbought", "cci14_turn_down", "cci14_overbought_turn_down",
    "wr14", "atr14", "boll_width", "boll_band_position",
]
TREND_FEATURES = [
    "ma20_slope_5d", "ma60_slope_10d", "ma20_slope_5d_negative", "ma60_slope_10d_negative",
    "close_above_ma20", "close_above_ma60", "above_ma20_days", "below_ma20_days", "above_ma60_days",
    "below_ma60_days", "ma20_ma60_gap", "drawdown_20d", "drawdown_60d", "regime_trend_score",
    "is_bull_trend", "is_bear_trend", "regime_state_days",
]
VOLUME_FEATURES = [
    "amount_zscore_20d", "amount_percentile_60d", "volume_zscore_20d", "volume_ratio_5d_20d",
    "volume_percentile_60d", "down_with_volume", "up_with_volume", "shrink_rebound",
]
VOLATILITY_FEATURES = [
    "volatility_5d", "volatility_10d", "volatility_20d", "volatility_expand", "atr_expand",
    "boll_lower_break", "boll_upper_break",
]
STYLE_FEATURES = ["relative_hs300", "relative_zz500", "relative_cyb"]

MARKET_FEATURES = (
    BASIC_FEATURES + TECHNICAL_FEATURES + TREND_FEATURES + VOLUME_FEATURES
    + VOLATILITY_FEATURES + STYLE_FEATURES
)
#: The two turnover columns are computed but not part of the released manifest.
AMOUNT_FEATURES = ["amount_zscore_20d", "amount_percentile_60d"]
FORUM_FEATURES = ["heat_score", "heat_zscore_20d", "sentiment_score", "disagreement"]

EVENT_GROUPS = ["index_style", "liquidity", "policy_market", "growth_industry", "macro"]
EVENT_MEASURES = ["score", "count", "positive_count", "negative_count", "max_strength"]
ROLL_WINDOWS = [3, 5, 10]


def event_features(groups: list[str] | None = None) -> list[str]:
    """Daily event columns: one set over all events, one set per keyword group."""
    prefixes = ["event"] + [f"event_{g}" for g in (EVENT_GROUPS if groups is None else groups)]
    return [f"{p}_{m}" for p in prefixes for m in EVENT_MEASURES]


def rolled_event_features(groups: list[str] | None = None,
                          windows: list[int] | None = None) -> list[str]:
    return [f"{c}_roll_{n}d" for n in (windows or ROLL_WINDOWS) for c in event_features(groups)]


def feature_manifest(prefix: str = "f_") -> list[str]:
    """The frozen model input list: every market and event column but turnover, shorter names first, then by name."""
    market = [c for c in MARKET_FEATURES if c not in AMOUNT_FEATURES]
    return sorted((prefix + c for c in market + event_features() + rolled_event_features()), key=lambda n: (len(n), n))


# --- Fixed values: default instruments, horizons and thresholds.
TARGET_CODE = "000852"
BENCHMARK_CODES = {"relative_hs300": "000300", "relative_zz500": "000905", "relative_cyb": "399006"}
HORIZONS = [3, 5, 7]
SIGNAL_HORIZON = 7
BUY_LABEL_THRESHOLDS = {5: 0.0, 7: 0.005}
SHORT_LABEL_THRESHOLDS = {5: 0.0, 7: 0.0}
SIGNAL_THRESHOLD = 0.60
DEFAULT_SPLITS = {
    "train_start": "2015-01-01", "train_end": "2020-12-31",
    "valid_start": "2021-01-01", "valid_end": "2022-12-31",
    "test_start": "2023-01-01",
}
EVALUATION_START = "2021-01-01"
BEAR_PERIODS = [("2021-07-01", "2024-08-24")]
MODEL_VERSION = "buy-signal-v1.0"
FEATURE_VERSION = "buy-features-v1.0"
MODEL_TAG = "buy_v1_7d"

SIGNAL_COLUMNS = [
    "trade_date", "model_version", "feature_version", "model_tag", "horizon", "causal_regime",
    "buy_proba", "buy_threshold", "direction", "signal_strength", "pred_ret", "future_ret_7d",
]


#: Table layouts as DDL, the form ``spark.read.schema`` and ``from_json`` take.
INDEX_BARS = (
    "trade_date date, index_code string, index_name string, open double, high double, low double, "
    "close double, pre_close double, pct_chg double, volume double, amount double, data_source string")
ETF_BARS = (
    "trade_date date, etf_code string, etf_name string, open double, high double, low double, "
    "close double, pct_chg double, volume double, amount double, turnover double, data_source string")
FUTURES_BARS = (
    "trade_date date, future_code string, future_name string, category string, open double, "
    "high double, low double, close double, settle double, pct_chg double, volume double, "
    "open_interest double, amount double, data_source string")
POSTS = (
    "post_id string, source string, bar_name string, publish_time timestamp, trade_date date, "
    "title string, content string, read_count int, comment_count int, like_count int, "
    "author string, url string")
COMMENTS = (
    "comment_id string, post_id string, source string, bar_name string, publish_time timestamp, "
    "trade_date date, author string, content string, like_count int, reply_count int, url string")
NEWS = (
    "news_id string, source string, publish_time timestamp, trade_date date, title string, "
    "content string, url string, matched_keywords string, matched_groups string")
EVENTS = (
    "trade_date date, event_name string, event_type string, event_stage string, "
    "expectation_level string, surprise_level string, affected_style string, "
    "impact_direction string, impact_strength int, event_score double, llm_reason string, "
    "source_ids string, matched_keywords string, matched_groups string")

#: Natural key of every table; upserts and partition layouts are derived from it.
NATURAL_KEYS = {
    "market_index_daily": ["trade_date", "index_code"],
    "market_etf_daily": ["trade_date", "etf_code"],
    "market_futures_daily": ["trade_date", "future_code"],
    "market_feature_daily": ["trade_date", "index_code"],
    "forum_post": ["post_id"],
    "forum_comment": ["comment_id"],
    "news": ["news_id"],
    "sentiment_feature_daily": ["trade_date", "topic", "source"],
    "event_daily": ["source_ids"],
    "model_dataset_daily": ["trade_date", "index_code"],
    "prediction_result": ["trade_date", "horizon"],
    "buy_signal_daily": ["trade_date", "model_version", "horizon"],
}
