"""Market feature table: about ninety indicator columns per instrument and day.

The physical shape is two narrow exchanges on the instrument: one that feeds the
recurrences (seven numbers per row), one that feeds every rolling window.  The
wide result is never shuffled again; the relative-strength columns come from a
per-date table of four instruments and are joined by broadcast, because that
table has one row per calendar date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.nulls import to_number, to_storage
from barloom.operators.frames import (Series, flag, percent_rank_of_last, quantile_of, ratio,
                                      spread_series, stage)
from barloom.operators.recurrence import exponential_averages
from barloom.schemas import BENCHMARK_CODES, MARKET_FEATURES, STYLE_FEATURES, TARGET_CODE

PRICE_COLUMNS = ["open", "high", "low", "close", "volume", "amount"]
KEYS = ["trade_date", "index_code"]
c = F.col
s = Series("index_code", "trade_date")


def with_recurrences(bars: DataFrame) -> DataFrame:
    """Append the moving-average family that feeds MACD, KDJ and EXPMA."""
    low9, high9 = s.over("min(low)", 9), s.over("max(high)", 9)
    base = bars.select(*KEYS, *[to_number(c(p)).alias(p) for p in PRICE_COLUMNS])
    base = stage(spread_series(base, "index_code"),
                 {"_rsv": ratio(f"close - {low9}", f"{high9} - {low9}") + " * 100"})
    return exponential_averages(
        base, ["index_code"], "trade_date",
        steps=[
            ("expma12", "close", {"span": 12}),
            ("_ema26", "close", {"span": 26}),
            ("macd_signal", "macd", {"span": 9}),
            ("expma50", "close", {"span": 50}),
            ("kdj_k", "_rsv", {"alpha": 1.0 / 3.0}),
            ("kdj_d", "kdj_k", {"alpha": 1.0 / 3.0}),
        ],
        differences=[("macd", "expma12", "_ema26")],
    ).drop("_rsv", "_ema26")


def recurrence_features(df: DataFrame) -> DataFrame:
    """MACD, KDJ and EXPMA crossings and run lengths."""
    df = stage(spread_series(df, "index_code"), {
        "macd_hist": "macd - macd_signal",
        "kdj_j": "3 * kdj_k - 2 * kdj_d",
        "kdj_k_minus_d": "kdj_k - kdj_d",
        "expma12_gap": ratio("expma12", "expma50") + " - 1",
        "_pos": s.position(),
    })
    crossings: dict[str, str] = {}
    for name, x in (("macd", "macd_hist"), ("kdj", "kdj_k_minus_d"), ("expma", "expma12_gap")):
        crossings[f"{name}_golden_cross"] = s.crosses_up(x)
        crossings[f"{name}_dead_cross"] = s.crosses_down(x)
        crossings[f"{name}_golden_cross_days"] = s.run_length(f"{x} > 0")
        crossings[f"{name}_dead_cross_days"] = s.run_length(f"{x} < 0")
    prev_j = s.lag("kdj_j")
    return stage(df, {
        **crossings,
        "macd_hist_turn_positive": s.crosses_up("macd_hist"),
        "macd_hist_turn_negative": s.crosses_down("macd_hist"),
        "kdj_j_overbought": flag("kdj_j > 100"),
        "kdj_j_oversold": flag("kdj_j < 0"),
        "kdj_j_overbought_turn_down": flag(f"{prev_j} > 100 AND kdj_j < {prev_j}"),
    })


def rolling_features(bars: DataFrame, bull_score: float = 2, bear_score: float = -2) -> DataFrame:
    """Every indicator that is a finite window over the raw bar columns.

    Numeric columns that are not prices pass through, so the function also runs on
    the output of :func:`recurrence_features` without another exchange.
    """
    df = bars
    if "_pos" not in df.columns:
        df = df.withColumns({p: to_number(c(p)) for p in PRICE_COLUMNS})
        df = stage(spread_series(df, "index_code"), {"_pos": s.position()})

    # 1. windows over raw columns
    tp = "(high + low + close) / 3"
    df = stage(df, {
        "_pc": s.lag("close"),
        **{f"ret_{n}d": s.change("close", n) for n in (1, 3, 5, 10)},
        **{f"_ma{n}": s.mean("close", n) for n in (5, 10, 20, 60)},
        "_sd20": s.std("close", 20),
        "_amt_mean": s.mean("amount", 20), "_amt_std": s.std("amount", 20),
        "_vol_mean": s.mean("volume", 20), "_vol_std": s.std("volume", 20),
        "_vol_mean5": s.mean("volume", 5),
        "_high14": s.highest("high", 14), "_low14": s.lowest("low", 14),
        "_max20": s.highest("close", 20), "_max60": s.highest("close", 60),
        "_amt60": s.values("amount", 60), "_vol60": s.values("volume", 60),
        "_tp": tp, "_tp_mean": s.mean(tp, 14),
        "_range": "nullif(high - low, 0D)",
        "intraday_range": ratio("nullif(high - low, 0D)", "close"),
    })

    # 2. row expressions
    df = stage(df, {
        **{f"ma{n}_gap": ratio("close", f"_ma{n}") + " - 1" for n in (5, 10, 20)},
        "_gain": "CASE WHEN close - _pc IS NOT NULL THEN greatest(close - _pc, 0D) END",
        "_loss": "CASE WHEN close - _pc IS NOT NULL THEN greatest(_pc - close, 0D) END",
        "_tr": "greatest(high - low, abs(high - _pc), abs(low - _pc))",
        "_boll_low": "_ma20 - 2 * _sd20",
        "_boll_high": "_ma20 + 2 * _sd20",
        "boll_width": ratio("4 * _sd20", "_ma20"),
        "amount_zscore_20d": ratio("amount - _amt_mean", "_amt_std"),
        "volume_zscore_20d": ratio("volume - _vol_mean", "_vol_std"),
        "volume_ratio_5d_20d": ratio("_vol_mean5", "_vol_mean"),
        "amount_percentile_60d": percent_rank_of_last("_amt60", "amount"),
        "volume_percentile_60d": percent_rank_of_last("_vol60", "volume"),
        "upper_shadow_ratio": ratio("high - greatest(open, close)", "_range"),
        "lower_shadow_ratio": ratio("least(open, close) - low", "_range"),
        "body_ratio": ratio("abs(close - open)", "_range"),
        "gap_up": flag("open > _pc * 1.005D"),
        "gap_down": flag("open < _pc * 0.995D"),
        "wr14": ratio("_high14 - close", "_high14 - _low14") + " * -100",
        "close_above_ma20": flag("close > _ma20"),
        "close_above_ma60": flag("close > _ma60"),
        "ma20_ma60_gap": ratio("_ma20", "_ma60") + " - 1",
        "drawdown_20d": ratio("close", "_max20") + " - 1",
        "drawdown_60d": ratio("close", "_max60") + " - 1",
        "_tp_dev": "abs(_tp - _tp_mean)",
    })

    # 3. windows over derived columns
    df = stage(df, {
        **{f"volatility_{n}d": s.std("ret_1d", n) for n in (5, 10, 20)},
        **{f"{x}{n}": s.mean(x, n) for x in ("_gain", "_loss") for n in (6, 14)},
        "_tr_mean": s.mean("_tr", 14),
        "_range60": s.values("intraday_range", 60),
        "_tp_md": s.mean("_tp_dev", 14),
        "ma20_slope_5d": s.change("_ma20", 5),
        "ma60_slope_10d": s.change("_ma60", 10),
        **{f"{side}_ma{n}_days": s.run_length(f"close {sign} _ma{n}")
           for n in (20, 60) for side, sign in (("above", ">"), ("below", "<"))},
    })

    # 4. row expressions
    heavy = "volume_zscore_20d > 1"
    votes = ["close > _ma20", "close > _ma60", "ma20_slope_5d > 0", "ma60_slope_10d > 0"]
    score = " + ".join(f"(CASE WHEN {v} THEN 1 ELSE -1 END)" for v in votes)
    ready = " AND ".join(f"{x} IS NOT NULL" for x in ("_ma20", "_ma60", "ma20_slope_5d", "ma60_slope_10d"))
    df = stage(df, {
        **{f"rsi{n}": "100 - " + ratio("100D", "1 + " + ratio(f"_gain{n}", f"_loss{n}")) for n in (6, 14)},
        "atr14": ratio("_tr_mean", "close"),
        "boll_lower_break": flag("close < _boll_low"),
        "boll_upper_break": flag("close > _boll_high"),
        "boll_band_position": ratio("close - _boll_low", "_boll_high - _boll_low"),
        "volatility_expand": ratio("volatility_5d", "volatility_20d"),
        "upper_probe": flag("upper_shadow_ratio > 0.55D AND body_ratio < 0.35D"),
        "lower_probe": flag("lower_shadow_ratio > 0.55D AND body_ratio < 0.35D"),
        "doji": flag("body_ratio < 0.1D"),
        "long_upper_shadow": flag("upper_shadow_ratio > 0.5D"),
        "long_lower_shadow": flag("lower_shadow_ratio > 0.5D"),
        "heavy_upper_shadow": flag(f"upper_shadow_ratio > 0.5D AND {heavy}"),
        "heavy_lower_shadow": flag(f"lower_shadow_ratio > 0.5D AND {heavy}"),
        "large_range_day": flag(f"intraday_range > {quantile_of('_range60', 60, 0.8)}"),
        "cci14": ratio("_tp - _tp_mean", "0.015D * _tp_md"),
        "ma20_slope_5d_negative": flag("ma20_slope_5d < 0"),
        "ma60_slope_10d_negative": flag("ma60_slope_10d < 0"),
        "regime_trend_score": f"CASE WHEN {ready} THEN {score} END",
        "down_with_volume": flag(f"ret_1d < 0 AND {heavy}"),
        "up_with_volume": flag(f"ret_1d > 0 AND {heavy}"),
        "shrink_rebound": flag("ret_1d > 0 AND volume_ratio_5d_20d < 0.8D"),
    })

    # 5. windows over indicators
    bull, bear = f"regime_trend_score >= {bull_score}", f"regime_trend_score <= {bear_score}"
    prev_cci = s.lag("cci14")
    df = stage(df, {
        "is_bull_trend": flag(bull),
        "is_bear_trend": flag(bear),
        "atr_expand": ratio("atr14", s.mean("atr14", 20)),
        "cci14_overbought": flag("cci14 > 100"),
        "cci14_turn_down": flag(f"cci14 < {prev_cci}"),
        "cci14_overbought_turn_down": flag(f"{prev_cci} > 100 AND cci14 < {prev_cci}"),
        # a row that counts as bear is not in a bull run
        "regime_state_days": s.run_length(f"{bull} AND NOT coalesce({bear}, false)")
        + " + " + s.run_length(bear),
    })
    return df


def relative_strength(bars: DataFrame, target: str = TARGET_CODE,
                      benchmarks: dict[str, str] | None = None) -> DataFrame:
    """Target one-day return minus each benchmark's, one row per trading date.

    Only the named instruments are read; the result has one row per calendar
    date, which is the size bound behind its broadcast in :func:`market_features`.
    """
    benchmarks = BENCHMARK_CODES if benchmarks is None else benchmarks
    returns = stage(bars.filter(c("index_code").isin([target, *benchmarks.values()]))
                    .select(*KEYS, to_number(c("close")).alias("close")),
                    {"_ret": s.change("close", 1)})

    def of(code: str) -> F.Column:
        return F.max(F.when(c("index_code") == code, c("_ret")))

    return returns.groupBy("trade_date").agg(
        *[(of(target) - of(code)).alias(name) for name, code in benchmarks.items()])


def with_relative_strength(features: DataFrame, bars: DataFrame, target: str = TARGET_CODE,
                           benchmarks: dict[str, str] | None = None) -> DataFrame:
    """Repeat the per-date relative strength on every instrument's row."""
    per_date = relative_strength(bars, target, benchmarks)
    return features.join(F.broadcast(per_date), "trade_date", "left")


def market_features(bars: DataFrame, target: str = TARGET_CODE,
                    benchmarks: dict[str, str] | None = None, bull_score: float = 2,
                    bear_score: float = -2, storage_scale: int | None = None,
                    keep_close: bool = False) -> DataFrame:
    """The full feature table: keys plus the 93 indicator columns.

    ``storage_scale`` rounds like the stored table.  ``keep_close`` carries the close
    along, so that the dataset can be built on the same partitioning without a join.
    """
    wide = rolling_features(recurrence_features(with_recurrences(bars)), bull_score, bear_score)
    names = [n for n in MARKET_FEATURES if n not in STYLE_FEATURES]
    kept = [*KEYS, "close"] if keep_close else KEYS
    wide = with_relative_strength(wide.select(*kept, *names), bars, target, benchmarks)
    columns = names + list(BENCHMARK_CODES if benchmarks is None else benchmarks)
    if storage_scale is None:
        return wide.select(*kept, *columns)
    doubles = {f.name for f in wide.schema.fields if f.dataType.simpleString() == "double"}
    return wide.select(*kept, *[
        to_storage(c(n), storage_scale).alias(n) if n in doubles else c(n) for n in columns])
