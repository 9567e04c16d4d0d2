"""DuckDB twins of the fixture views, as composable common table expressions."""

from __future__ import annotations

from checks import fixtures as fx

BARS = """
bars_raw AS (
  SELECT CAST(l_shipdate AS DATE) AS trade_date, CAST(l_linenumber AS VARCHAR) AS index_code,
         round(1000 + l_extendedprice / 1000, 5) AS p,
         CAST(l_orderkey AS HUGEINT) * 1000000000000000 + l_partkey * 100000 + l_suppkey AS k,
         l_quantity, l_extendedprice
  FROM lineitem),
bars AS (
  SELECT trade_date, index_code, arg_min(p, k) AS open, max(p) AS high, min(p) AS low,
         arg_max(p, k) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM bars_raw GROUP BY 1, 2)"""

# rolling mean / deviation over n rows that must all be known
_PART = "PARTITION BY index_code ORDER BY trade_date"


def rows(n: int, extra: str = _PART) -> str:
    return f"({extra} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, col: str, n: int, extra: str = _PART) -> str:
    w = rows(n, extra)
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {fn.format(x=col)} OVER {w} END"


def mean(col: str, n: int) -> str:
    return full("avg({x})", col, n)


def std(col: str, n: int) -> str:
    return full("stddev_samp({x})", col, n)


def lag(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) OVER ({_PART})"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def run(cond: str) -> str:
    return (f"CAST(CASE WHEN coalesce({cond}, false) THEN pos - coalesce(max(CASE WHEN NOT coalesce({cond}, false) "
            f"THEN pos END) OVER ({_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) ELSE 0 END AS DOUBLE)")


def up(col: str) -> str:
    return flag(f"{col} > 0 AND {lag(col)} <= 0")


def down(col: str) -> str:
    return flag(f"{col} < 0 AND {lag(col)} >= 0")


def _pct(col: str) -> str:
    return (f"CASE WHEN len(w_{col}) = 60 THEN (len(list_filter(w_{col}, lambda e: e < {col})) + "
            f"(len(list_filter(w_{col}, lambda e: e = {col})) + 1) / 2.0) / 60 END")


ROLLING = BARS + f""",
r1 AS (
  SELECT *, row_number() OVER ({_PART}) AS pos, {lag('close')} AS pc,
    {', '.join(f"{ratio('close', lag('close', n))} - 1 AS ret_{n}d" for n in (1, 3, 5, 10))},
    {', '.join(f"{mean('close', n)} AS ma{n}" for n in (5, 10, 20, 60))},
    {std('close', 20)} AS sd20,
    {mean('amount', 20)} AS a_mean, {std('amount', 20)} AS a_std,
    {mean('volume', 20)} AS v_mean, {std('volume', 20)} AS v_std, {mean('volume', 5)} AS v_mean5,
    {full('max({x})', 'high', 14)} AS h14, {full('min({x})', 'low', 14)} AS l14,
    {full('max({x})', 'close', 20)} AS mx20, {full('max({x})', 'close', 60)} AS mx60,
    list(amount) OVER {rows(60)} AS w_amount, list(volume) OVER {rows(60)} AS w_volume,
    (high + low + close) / 3 AS tp, nullif(high - low, 0) AS rng,
    {mean('((high + low + close) / 3)', 14)} AS tp_ma
  FROM bars),
r2 AS (
  SELECT *, {', '.join(f"{ratio('close', f'ma{n}')} - 1 AS ma{n}_gap" for n in (5, 10, 20))},
    CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain,
    CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    ma20 - 2 * sd20 AS b_low, ma20 + 2 * sd20 AS b_high,
    {ratio('4 * sd20', 'ma20')} AS boll_width,
    {ratio('amount - a_mean', 'a_std')} AS amount_zscore_20d,
    {ratio('volume - v_mean', 'v_std')} AS volume_zscore_20d,
    {ratio('v_mean5', 'v_mean')} AS volume_ratio_5d_20d,
    {_pct('amount')} AS amount_percentile_60d, {_pct('volume')} AS volume_percentile_60d,
    {ratio('high - greatest(open, close)', 'rng')} AS upper_shadow_ratio,
    {ratio('least(open, close) - low', 'rng')} AS lower_shadow_ratio,
    {ratio('abs(close - open)', 'rng')} AS body_ratio,
    {ratio('rng', 'close')} AS intraday_range,
    {flag('open > pc * 1.005::DOUBLE')} AS gap_up, {flag('open < pc * 0.995::DOUBLE')} AS gap_down,
    {ratio('h14 - close', 'h14 - l14')} * -100 AS wr14,
    {flag('close > ma20')} AS close_above_ma20, {flag('close > ma60')} AS close_above_ma60,
    {ratio('ma20', 'ma60')} - 1 AS ma20_ma60_gap,
    {ratio('close', 'mx20')} - 1 AS drawdown_20d, {ratio('close', 'mx60')} - 1 AS drawdown_60d,
    abs(tp - tp_ma) AS tp_dev
  FROM r1),
r3 AS (
  SELECT *, {', '.join(f"{std('ret_1d', n)} AS volatility_{n}d" for n in (5, 10, 20))},
    {', '.join(f"{mean(k, n)} AS {k}{n}" for k in ('gain', 'loss') for n in (6, 14))},
    {mean('tr', 14)} AS tr_mean,
    {full('quantile_cont({x}, 0.8)', 'intraday_range', 60)} AS range_q80,
    {mean('tp_dev', 14)} AS tp_md,
    {ratio('ma20', lag('ma20', 5))} - 1 AS ma20_slope_5d,
    {ratio('ma60', lag('ma60', 10))} - 1 AS ma60_slope_10d,
    {run('close > ma20')} AS above_ma20_days, {run('close < ma20')} AS below_ma20_days,
    {run('close > ma60')} AS above_ma60_days, {run('close < ma60')} AS below_ma60_days
  FROM r2),
r4 AS (
  SELECT *, {', '.join(f"100 - 100 / nullif(1 + {ratio(f'gain{n}', f'loss{n}')}, 0) AS rsi{n}" for n in (6, 14))},
    {ratio('tr_mean', 'close')} AS atr14,
    {flag('close < b_low')} AS boll_lower_break, {flag('close > b_high')} AS boll_upper_break,
    {ratio('close - b_low', 'b_high - b_low')} AS boll_band_position,
    {ratio('volatility_5d', 'volatility_20d')} AS volatility_expand,
    {flag('upper_shadow_ratio > 0.55 AND body_ratio < 0.35')} AS upper_probe,
    {flag('lower_shadow_ratio > 0.55 AND body_ratio < 0.35')} AS lower_probe,
    {flag('body_ratio < 0.1')} AS doji,
    {flag('upper_shadow_ratio > 0.5')} AS long_upper_shadow, {flag('lower_shadow_ratio > 0.5')} AS long_lower_shadow,
    {flag('upper_shadow_ratio > 0.5 AND volume_zscore_20d > 1')} AS heavy_upper_shadow,
    {flag('lower_shadow_ratio > 0.5 AND volume_zscore_20d > 1')} AS heavy_lower_shadow,
    {flag('intraday_range > range_q80')} AS large_range_day,
    {ratio('tp - tp_ma', '0.015::DOUBLE * tp_md')} AS cci14,
    {flag('ma20_slope_5d < 0')} AS ma20_slope_5d_negative, {flag('ma60_slope_10d < 0')} AS ma60_slope_10d_negative,
    CASE WHEN ma20 IS NOT NULL AND ma60 IS NOT NULL AND ma20_slope_5d IS NOT NULL AND ma60_slope_10d IS NOT NULL THEN
      CAST((CASE WHEN close > ma20 THEN 1 ELSE -1 END) + (CASE WHEN close > ma60 THEN 1 ELSE -1 END)
      + (CASE WHEN ma20_slope_5d > 0 THEN 1 ELSE -1 END) + (CASE WHEN ma60_slope_10d > 0 THEN 1 ELSE -1 END) AS INTEGER)
      END AS regime_trend_score,
    {flag('ret_1d < 0 AND volume_zscore_20d > 1')} AS down_with_volume,
    {flag('ret_1d > 0 AND volume_zscore_20d > 1')} AS up_with_volume,
    {flag('ret_1d > 0 AND volume_ratio_5d_20d < 0.8')} AS shrink_rebound
  FROM r3),
r5 AS (
  SELECT *, {flag('regime_trend_score >= 2')} AS is_bull_trend, {flag('regime_trend_score <= -2')} AS is_bear_trend,
    {mean('atr14', 20)} AS atr_mean,
    {flag('cci14 > 100')} AS cci14_overbought, {flag('cci14 < ' + lag('cci14'))} AS cci14_turn_down,
    {flag(lag('cci14') + ' > 100 AND cci14 < ' + lag('cci14'))} AS cci14_overbought_turn_down
  FROM r4),
rolling AS (
  SELECT *, {ratio('atr14', 'atr_mean')} AS atr_expand,
    {run('is_bull_trend = 1')} + {run('is_bear_trend = 1')} AS regime_state_days
  FROM r5)"""



def _decay(span: float | None = None, alpha: float | None = None) -> float:
    """Weight of a new value, with the rounding of the centre-of-mass form."""
    com = (span - 1) / 2 if span else (1 - alpha) / alpha
    return 1 / (1 + com)


def _step(old: str, new: str, a: float, weight: str = "1") -> str:
    """One step of a recursive average; an equal value leaves it untouched."""
    o = f"({1 - a!r}::DOUBLE * {weight})"
    return f"CASE WHEN {old} = {new} THEN {old} ELSE ({o} * {old} + {a!r}::DOUBLE * {new}) / ({o} + {a!r}::DOUBLE) END"


_A3 = _decay(alpha=1.0 / 3.0)
# exponential averages as a recursion over the row position
EMA = BARS + f""",
e0 AS (
  SELECT *, row_number() OVER ({_PART}) AS pos,
    {ratio(f"close - min(low) OVER {rows(9)}", f"max(high) OVER {rows(9)} - min(low) OVER {rows(9)}")} * 100 AS rsv
  FROM bars),
ema(index_code, pos, e12, e26, e50, sig, k, kw, d) AS (
  SELECT index_code, pos, close, close, close, CAST(0 AS DOUBLE), rsv, CAST(1 AS DOUBLE), rsv FROM e0 WHERE pos = 1
  UNION ALL
  SELECT index_code, pos, e12, e26, e50, {_step('sig', '(e12 - e26)', _decay(9))}, k, kw,
         CASE WHEN k IS NULL THEN NULL WHEN d IS NULL THEN k ELSE {_step('d', 'k', _A3)} END
  FROM (
    SELECT n.index_code, n.pos,
      {_step('p.e12', 'n.close', _decay(12))} AS e12, {_step('p.e26', 'n.close', _decay(26))} AS e26,
      {_step('p.e50', 'n.close', _decay(50))} AS e50, p.sig AS sig, p.d AS d,
      CASE WHEN p.k IS NULL THEN n.rsv WHEN n.rsv IS NULL THEN p.k ELSE {_step('p.k', 'n.rsv', _A3, 'p.kw')} END AS k,
      CASE WHEN p.k IS NULL OR n.rsv IS NOT NULL THEN 1.0::DOUBLE ELSE p.kw * {1 - _A3!r}::DOUBLE END AS kw
    FROM ema p JOIN e0 n ON n.index_code = p.index_code AND n.pos = p.pos + 1)),
e1 AS (
  SELECT e0.trade_date, e0.index_code, e0.pos, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_hist,
    k AS kdj_k, d AS kdj_d, 3 * k - 2 * d AS kdj_j, k - d AS kdj_k_minus_d,
    e12 AS expma12, e50 AS expma50, e12 / e50 - 1 AS expma12_gap
  FROM ema JOIN e0 USING (index_code, pos)),
ema_cols AS (
  SELECT *, {', '.join(f"{up(v)} AS {n}_golden_cross, {down(v)} AS {n}_dead_cross, "
                       f"{run(v + ' > 0')} AS {n}_golden_cross_days, {run(v + ' < 0')} AS {n}_dead_cross_days"
                       for n, v in (('macd', 'macd_hist'), ('kdj', 'kdj_k_minus_d'), ('expma', 'expma12_gap')))},
    {up('macd_hist')} AS macd_hist_turn_positive, {down('macd_hist')} AS macd_hist_turn_negative,
    {flag('kdj_j > 100')} AS kdj_j_overbought, {flag('kdj_j < 0')} AS kdj_j_oversold,
    {flag(lag('kdj_j') + ' > 100 AND kdj_j < ' + lag('kdj_j'))} AS kdj_j_overbought_turn_down
  FROM e1)"""

REL = f""",
rel_ret AS (SELECT trade_date, index_code, {ratio('close', lag('close'))} - 1 AS ret FROM bars),
rel AS (
  SELECT trade_date, {', '.join(
      f"max(CASE WHEN index_code = '{fx.TARGET}' THEN ret END) - max(CASE WHEN index_code = '{b}' THEN ret END) AS {n}"
      for n, b in fx.BENCHMARKS.items())}
  FROM rel_ret GROUP BY trade_date)"""


def without_bars(view: str) -> str:
    return view.replace(BARS, "", 1).lstrip(",\n ")


def with_(*views: str, recursive: bool = False) -> str:
    """WITH clause from views; only the first may carry the bars."""
    body = views[0] + "".join(",\n" + without_bars(v) if v.startswith(BARS) else v for v in views[1:])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + body.lstrip() + "\n"
