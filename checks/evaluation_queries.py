"""Labels, selection and metric families on synthetic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import labels as L
from barloom.operators import selection as sel
from barloom.plans import dataset as D
from barloom.plans import evaluation as E
from barloom.plans import market as M
from checks import fixtures as fx
from checks import oracle_views as ov

c = F.col


def rounded(df, digits=9, keep=()):
    """Round double columns the same way the SQL side does."""
    return df.selectExpr(*[
        f"round(`{f.name}`, {digits}) AS `{f.name}`"
        if f.dataType.simpleString() == "double" and f.name not in keep else f"`{f.name}`"
        for f in df.schema.fields])


def r9(expr, name):
    return f"round({expr}, 9) AS {name}"


def _feats(spark, sf_dir):
    return M.rolling_features(fx.bars(spark, sf_dir))


# --- Spark side -----------------------------------------------------------------------------

def forward_returns(spark, sf_dir):
    return rounded(D.forward_returns(fx.bars(spark, sf_dir), [3, 5, 7]).select(
        "trade_date", "index_code", "future_ret_3d", "future_ret_5d", "future_ret_7d"))


def labels_3class(spark, sf_dir):
    df = D.forward_returns(_feats(spark, sf_dir).select("trade_date", "index_code", "close", "volatility_20d"))
    return df.select("trade_date", "index_code", *[
        L.direction_label(c(f"future_ret_{h}d"), c("volatility_20d"), h).alias(f"label_{h}d") for h in (3, 5, 7)])


def labels_binary(spark, sf_dir):
    df = D.forward_returns(fx.bars(spark, sf_dir), [5, 7])
    return df.select("trade_date", "index_code", *[
        fn(c(f"future_ret_{h}d"), t).alias(f"{side}_label_{h}d")
        for side, fn, t5, t7 in (("buy", L.buy_label, 0.0, 0.005), ("short", L.short_label, 0.0, 0.0))
        for h, t in ((5, t5), (7, t7))])


def signal_gate(spark, sf_dir):
    df = fx.scores(spark, sf_dir)
    return df.select(
        "trade_date", "index_code", "causal_regime", "evaluation_regime",
        L.sample_scope(c("trade_date"), fx.SPLITS).alias("sample_scope"),
        L.signal_direction(c("causal_regime"), c("buy_proba"), F.lit(0.6)).alias("direction"),
        *[F.coalesce(L.gate_passes(g, c("causal_regime"), c("buy_proba"), F.lit(0.6)), F.lit(False))
          .cast("int").alias(g) for g in L.GATES])


def trade_positions(spark, sf_dir):
    return fx.scores(spark, sf_dir).select("trade_date", "index_code", "test_year", "trade_pos")


def non_overlap(spark, sf_dir):
    df = fx.scores(spark, sf_dir).filter(c("buy_proba") >= 0.6).select(
        "index_code", "test_year", "horizon", "trade_date", "trade_pos")
    return sel.non_overlapping(df, ["index_code", "test_year", "horizon"], 7)


def purge(spark, sf_dir):
    df = fx.scores(spark, sf_dir).select("index_code", "test_year", "trade_date")
    return sel.purge_tail(fx.late_series(df), 7, ["index_code", "test_year"])


def prob_buckets(spark, sf_dir):
    return rounded(fx.scores(spark, sf_dir).select(
        "index_code", "future_ret", "buy_proba", L.probability_bucket(c("buy_proba")).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(L.logit(c("buy_proba"))).alias("avg_logit")), 6)


def _experiment_rows(spark, sf_dir):
    """Three copies of the scores, one per label threshold, with shifted probabilities."""
    df = fx.scores(spark, sf_dir).withColumnRenamed("is_bull_trend", "f_is_bull_trend").drop("label_threshold")
    marks = F.array(*[F.struct(F.lit(t).alias("label_threshold"), F.lit(k).alias("_k"))
                      for k, t in enumerate((0.0, 0.005, 0.01))])
    df = df.select("*", F.inline(marks))
    return df.withColumn("buy_proba", ((c("trade_pos") * 13 + c("_k") * 29 + c("index_code").cast("int") * 7) % 101) / 100.0)


def label_thresholds(spark, sf_dir):
    return rounded(E.label_threshold_comparison(_experiment_rows(spark, sf_dir)),
                   keep=("label_threshold", "probability_threshold"))


def label_threshold_buckets(spark, sf_dir):
    return rounded(E.label_threshold_buckets(_experiment_rows(spark, sf_dir)), keep=("label_threshold",))


def _calibration_rows(spark, sf_dir):
    df = fx.scores(spark, sf_dir).withColumnRenamed("is_bull_trend", "f_is_bull_trend")
    df = df.withColumn("actual_label", (c("future_ret") > 0.005).cast("int"))
    kinds = F.array(F.struct(F.lit("raw").alias("calibration_method"), c("buy_proba").alias("_p")),
                    F.struct(F.lit("shrunk").alias("calibration_method"),
                             (0.25 + c("buy_proba") / 2).alias("_p")))
    return df.select("*", F.inline(kinds)).withColumn("buy_proba", c("_p")).drop("_p")


def brier_calibration(spark, sf_dir):
    return rounded(E.calibration_quality(_calibration_rows(spark, sf_dir)))


def calibration_signals(spark, sf_dir):
    return rounded(E.calibration_signals(_calibration_rows(spark, sf_dir)), keep=("probability_threshold",))


def calibration_buckets(spark, sf_dir):
    return rounded(E.calibration_buckets(_calibration_rows(spark, sf_dir)))


def _ablation_rows(spark, sf_dir):
    df = fx.scores(spark, sf_dir).withColumnRenamed("is_bull_trend", "f_is_bull_trend")
    kinds = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(n).alias("feature_count"), F.lit(k).alias("_k"))
                      for k, (v, n) in enumerate((("1_basic", 18), ("2_technical", 58)))])
    df = df.select("*", F.inline(kinds))
    return df.withColumn("buy_proba", ((c("trade_pos") * 17 + c("_k") * 31 + c("index_code").cast("int") * 5) % 101) / 100.0)


def ablation_metrics(spark, sf_dir):
    return rounded(E.ablation_metrics(_ablation_rows(spark, sf_dir), 0.005),
                   keep=("label_threshold", "probability_threshold"))


def walk_forward_grid(spark, sf_dir):
    return rounded(E.walk_forward_summary(fx.scores(spark, sf_dir)), keep=("threshold", "label_threshold"))


def weighted_aggregate(spark, sf_dir):
    return rounded(E.aggregate_years(E.walk_forward_summary(fx.scores(spark, sf_dir))),
                   keep=("threshold", "label_threshold"))


def gate_compare(spark, sf_dir):
    return rounded(E.gate_comparison(fx.scores(spark, sf_dir)), keep=("base_buy_threshold", "label_threshold"))


def _rule_rows(spark, sf_dir):
    return fx.scores(spark, sf_dir).withColumnsRenamed({"ret_5d": "f_ret_5d", "ma20_gap": "f_ma20_gap"})


def rule_metrics_buy(spark, sf_dir):
    return rounded(E.binary_rule_metrics(_rule_rows(spark, sf_dir)), keep=("threshold",))


def rule_metrics_short(spark, sf_dir):
    return rounded(E.binary_rule_metrics(_rule_rows(spark, sf_dir), side="short", thresholds=(0.35, 0.5, 0.6)),
                   keep=("threshold",))


def _three(spark, sf_dir):
    rows = fx.three_class(spark, sf_dir).withColumnsRenamed({"ret_5d": "f_ret_5d", "ma20_gap": "f_ma20_gap"})
    base = E.momentum_baseline(fx.bars(spark, sf_dir), fx.TARGET)
    return rows.join(F.broadcast(base), "trade_date", "left")  # one row per date


def up_signal_metrics(spark, sf_dir):
    return rounded(E.up_signal_metrics(_three(spark, sf_dir)), keep=("threshold",))


def long_short_metrics(spark, sf_dir):
    rows = E.with_position(fx.three_class(spark, sf_dir)).withColumn(
        "direction_proba", F.greatest("buy_proba", "short_proba"))
    return rounded(E.long_short_metrics(rows), keep=("threshold",))


def conflict_metrics(spark, sf_dir):
    return rounded(E.conflict_metrics(fx.scores(spark, sf_dir)), keep=("threshold",))


def conflict_details(spark, sf_dir):
    return rounded(E.conflict_rows(fx.scores(spark, sf_dir)).select(
        "threshold", "trade_date", "index_code", "buy_proba", "short_proba", "future_ret"), keep=("threshold",))


def regime_metrics(spark, sf_dir):
    return rounded(E.regime_metrics(fx.scores(spark, sf_dir), fx.SPLITS), keep=("threshold",))


def class_metrics(spark, sf_dir):
    return rounded(E.class_metrics(fx.three_class(spark, sf_dir)))


def class_summary(spark, sf_dir):
    return rounded(E.class_summary(fx.three_class(spark, sf_dir)))


def ic_rank_ic(spark, sf_dir):
    rows = fx.three_class(spark, sf_dir).withColumn("confidence", F.greatest("buy_proba", 1 - c("buy_proba")))
    return rounded(E.regression_metrics(rows), 6)


def feature_inventory(spark, sf_dir):
    feats = _feats(spark, sf_dir)
    groups = {"shape": ["upper_shadow_ratio", "doji", "rsi14"], "trend": ["regime_trend_score", "is_bull_trend"]}
    return E.feature_inventory(feats, groups)


QUERIES = {f.__name__: f for f in (
    forward_returns, labels_3class, labels_binary, signal_gate, trade_positions, non_overlap, purge,
    prob_buckets, label_thresholds, label_threshold_buckets, brier_calibration, calibration_signals,
    calibration_buckets, ablation_metrics, walk_forward_grid, weighted_aggregate, gate_compare,
    rule_metrics_buy, rule_metrics_short, up_signal_metrics, long_short_metrics, conflict_metrics,
    conflict_details, regime_metrics, class_metrics, class_summary, ic_rank_ic, feature_inventory)}

# --- DuckDB side ----------------------------------------------------------------------------

BEAR = " OR ".join(f"trade_date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in fx.BEAR)


def scores(horizon=7):
    return ov.ROLLING + f""",
sc0 AS (
  SELECT trade_date, index_code, ret_5d, ma20_gap, volatility_20d, is_bull_trend, is_bear_trend,
    {ov.ratio(f"lead(close, {horizon}) OVER ({ov._PART})", "close")} - 1 AS future_ret,
    CAST(year(trade_date) AS INTEGER) AS test_year, dayofyear(trade_date) AS doy, CAST(index_code AS INTEGER) AS code
  FROM rolling),
sc1 AS (
  SELECT *, {horizon} AS horizon, CAST(0.005 AS DOUBLE) AS label_threshold,
    CAST((doy * 37 + test_year * 11 + code * 17) % 101 AS DOUBLE) / 100 AS buy_proba,
    CAST((doy * 53 + test_year * 7 + code * 29) % 101 AS DOUBLE) / 100 AS short_proba,
    CASE WHEN {BEAR} THEN 'bear' WHEN trade_date >= DATE '{fx.EVAL_START}' THEN 'bull' ELSE 'outside' END AS evaluation_regime,
    CASE WHEN is_bear_trend = 1 THEN 'bear' WHEN is_bull_trend = 1 THEN 'bull' ELSE 'neutral' END AS causal_regime,
    CAST(future_ret > 0.005::DOUBLE AS INTEGER) AS buy_label, CAST(future_ret < 0 AS INTEGER) AS short_label
  FROM sc0 WHERE future_ret IS NOT NULL),
scores AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY index_code, test_year, horizon ORDER BY trade_date) - 1 AS INTEGER) AS trade_pos
  FROM sc1)"""


def label_sql(ret, vol, h):
    band = (f"(CASE WHEN {vol} IS NOT NULL AND {vol} <> 0 THEN 0.4::DOUBLE * {vol} * sqrt({h}) ELSE 0.008::DOUBLE END)")
    return (f"CASE WHEN {ret} IS NULL THEN NULL WHEN {ret} > {band} THEN '{L.UP}' WHEN {ret} < -{band} THEN '{L.DOWN}' "
            f"ELSE '{L.FLAT}' END")


def three(horizon=5):
    return scores(horizon) + f""",
t0 AS (SELECT *, {label_sql('future_ret', 'volatility_20d', horizon)} AS label FROM scores),
three AS (SELECT *, lag(label) OVER ({ov._PART}) AS pred_label, buy_proba - 0.5::DOUBLE AS pred_ret, buy_proba AS up_proba FROM t0)"""


def independent(src, keys, h=7, name="picked"):
    k = ", ".join(keys)
    on = " AND ".join(f"n.{x} = ch_{name}.{x}" for x in keys)
    return f""",
nx_{name} AS (
  SELECT *, min(trade_pos) OVER (PARTITION BY {k} ORDER BY trade_pos RANGE BETWEEN {h} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM {src}),
ch_{name} AS (
  SELECT {k}, min(trade_pos) AS pos FROM {src} GROUP BY {k}
  UNION ALL
  SELECT {', '.join('n.' + x for x in keys)}, n.nxt FROM ch_{name} JOIN nx_{name} n ON {on} AND n.trade_pos = ch_{name}.pos
  WHERE n.nxt IS NOT NULL),
{name} AS (SELECT s.* FROM {src} s JOIN ch_{name} USING ({k}) WHERE s.trade_pos = ch_{name}.pos)"""


def values(name, items):
    cells = ", ".join(f"({v!r}::DOUBLE)" if isinstance(v, float) else f"('{v}')" for v in items)
    return f"(VALUES {cells}) AS {name}_t({name})"


def b(cond):
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


PROBA_BUCKET = ("CASE WHEN {p} < 0 THEN NULL WHEN {p} < 0.5::DOUBLE THEN '<0.50' WHEN {p} < 0.6::DOUBLE THEN '0.50-0.60' "
                "WHEN {p} < 0.7::DOUBLE THEN '0.60-0.70' WHEN {p} < 0.8::DOUBLE THEN '0.70-0.80' "
                "WHEN {p} < 1.000001::DOUBLE THEN '>=0.80' END").format(p="buy_proba")
SCOPED = "(SELECT 'year' AS scope, {y} AS yr UNION ALL SELECT 'aggregate', NULL)"


def both_scopes(src, cols):
    return (f"SELECT 'year' AS scope, test_year, {cols} FROM {src} UNION ALL "
            f"SELECT 'aggregate', CAST(NULL AS INTEGER), {cols} FROM {src}")


def experiment(rows_cte, keys, mark_join, mark, marks, aggs, extra_cols):
    """Hard-gated independent signals by (keys, scope, year, mark) joined to the full grid."""
    k = ", ".join(keys)
    cond = " AND ".join(f"p.{x} IS NOT DISTINCT FROM g.{x}" for x in [*keys, "scope", "test_year", mark])
    src = rows_cte + f""",
ex_bull AS (SELECT e.*, {mark_join} WHERE f_is_bull_trend = 1)""" + independent(
        "ex_bull", [*keys, "test_year", "index_code", mark])
    grid = values(mark, marks)
    out = ", ".join(f"p.{n}" for n in extra_cols)
    return f"WITH RECURSIVE {src.strip()}" + f""",
ex_scoped AS ({both_scopes('picked', f'{k}, {mark}, future_ret, buy_proba' + (', label_threshold AS lt' if 'label_threshold' in keys else ', actual_label'))}),
ex_got AS (SELECT {k}, scope, test_year, {mark}, count(*) AS signal_count, {aggs} FROM ex_scoped GROUP BY ALL),
ex_present AS (SELECT DISTINCT * FROM ({both_scopes('ex_rows', k)})),
ex_grid AS (SELECT * FROM ex_present, {grid})
SELECT {', '.join('g.' + x for x in keys)}, g.scope, g.test_year, g.{mark}, coalesce(p.signal_count, 0) AS signal_count, {out}
FROM ex_grid g LEFT JOIN ex_got p ON {cond}"""


EX_ROWS = scores() + """,
ex_rows AS (
  SELECT trade_date, index_code, test_year, trade_pos, future_ret, is_bull_trend AS f_is_bull_trend, t.label_threshold,
    CAST((trade_pos * 13 + t.k * 29 + code * 7) % 101 AS DOUBLE) / 100 AS buy_proba
  FROM scores, (VALUES (0.0::DOUBLE, 0), (0.005::DOUBLE, 1), (0.01::DOUBLE, 2)) AS t(label_threshold, k))"""
CAL_ROWS = scores() + """,
ex_rows AS (
  SELECT trade_date, index_code, test_year, trade_pos, future_ret, is_bull_trend AS f_is_bull_trend,
    CAST(future_ret > 0.005::DOUBLE AS INTEGER) AS actual_label, m.calibration_method,
    CASE WHEN m.calibration_method = 'raw' THEN buy_proba ELSE 0.25::DOUBLE + buy_proba / 2 END AS buy_proba
  FROM scores, (VALUES ('raw'), ('shrunk')) AS m(calibration_method))"""
_label_aggs = ", ".join([
    r9(f"avg({b('future_ret > lt')})", "label_precision"), r9(f"avg({b('future_ret > 0')})", "actual_up_rate"),
    r9("avg(future_ret)", "avg_future_ret"), r9("median(future_ret)", "median_future_ret"),
    r9("avg(buy_proba)", "avg_buy_proba")])
_label_out = ["label_precision", "actual_up_rate", "avg_future_ret", "median_future_ret", "avg_buy_proba"]


def over(marks, mark):
    grid = values(mark, marks)
    return f"{mark}_t.{mark} FROM ex_rows e JOIN {grid} ON e.buy_proba >= {mark}_t.{mark}"


def bucketed(mark):
    return f"{PROBA_BUCKET} AS {mark} FROM ex_rows e"


def rule_sql(rules, date_rule, aggs, base="rows"):
    """Rules as (name, threshold, condition); one more rule per calendar year."""
    parts = [f"SELECT '{n}' AS rule, {'NULL' if t is None else repr(t)}::DOUBLE AS threshold, coalesce({cond}, false) AS hit, * FROM {base}"
             for n, t, cond in rules]
    name, cond = date_rule
    parts.append(f"SELECT '{name}_year_' || test_year, NULL::DOUBLE, coalesce({cond}, false), * FROM {base}")
    return f"""SELECT rule, threshold, count(*) FILTER (hit) AS signal_count,
  {r9("count(*) FILTER (hit) / count(*)::DOUBLE", "coverage")}, {aggs}
FROM ({' UNION ALL '.join(parts)}) GROUP BY rule, threshold"""


def hit(expr):
    return f"avg(CASE WHEN hit THEN {expr} END)"


def binary_sql(side, thresholds):
    buy = side == "buy"
    op, word, suffix = (">", "positive", "") if buy else ("<", "negative", "_short")
    rules = [(f"baseline_all_rows{suffix}", None, "true"), (f"baseline_ret_5d_{word}", None, f"ret_5d {op} 0"),
             (f"baseline_ma20_gap_{word}", None, f"ma20_gap {op} 0"),
             (f"predicted_{side}_label", None, f"{side}_proba > 0.5::DOUBLE")]
    rules += [(f"{side}_probability", t, f"{side}_proba >= {t!r}::DOUBLE") for t in thresholds]
    aggs = [r9(f"CASE WHEN count(*) FILTER (hit) > 0 THEN count(*) FILTER (hit AND {side}_label = 1) / (count(*) FILTER (hit))::DOUBLE END", f"{side}_precision"),
            r9(f"CASE WHEN count(*) FILTER (hit) > 0 THEN coalesce(count(*) FILTER (hit AND {side}_label = 1) / nullif(count(*) FILTER ({side}_label = 1), 0)::DOUBLE, 0) END", f"{side}_recall"),
            r9(hit(b(f"future_ret {op} 0")), f"{word}_ret_rate"), r9(hit("future_ret"), "avg_future_ret"),
            r9("median(CASE WHEN hit THEN future_ret END)", "median_future_ret"),
            r9(hit(f"{side}_proba"), f"avg_{side}_proba")]
    if not buy:
        aggs += [r9(hit("-future_ret"), "avg_short_strategy_ret"),
                 r9("-median(CASE WHEN hit THEN future_ret END)", "median_short_strategy_ret")]
    return "WITH " + scores().strip() + ", rows AS (SELECT * FROM scores) " + rule_sql(
        rules, (f"predicted_{side}_label", f"{side}_proba > 0.5::DOUBLE"), ", ".join(aggs))


EXTREMES = """,
means AS (SELECT label, avg(future_ret) AS m FROM three WHERE label IS NOT NULL GROUP BY label),
ext AS (SELECT arg_max(label, m) AS up_l, arg_min(label, m) AS down_l FROM means)"""


def up_sql():
    rules = [("baseline_all_rows", None, "true"), ("always_up", None, "true"), ("ma20_trend_up", None, "ma20_gap > 0"),
             ("momentum_5d_positive", None, "ret_5d > 0"), ("ret_20d_positive", None, "baseline_ret_20d > 0"),
             ("predicted_up_label", None, "pred_label = up_label")]
    rules += [("up_probability", t, f"up_proba >= {t!r}::DOUBLE") for t in (0.35, 0.4, 0.45, 0.5, 0.55, 0.6)]
    aggs = ", ".join([
        "max(up_label) AS up_label", r9(hit(b("label = up_label")), "actual_up_rate"),
        r9(hit(b("future_ret > 0")), "positive_ret_rate"), r9(hit("future_ret"), "avg_future_ret"),
        r9("median(CASE WHEN hit THEN future_ret END)", "median_future_ret"), r9(hit("pred_ret"), "avg_pred_ret"),
        r9(hit("up_proba"), "avg_up_proba")])
    return "WITH " + three().strip() + EXTREMES + f""",
mom AS (SELECT trade_date, {ov.ratio('close', ov.lag('close', 20))} - 1 AS baseline_ret_20d FROM bars WHERE index_code = '{fx.TARGET}'),
rows AS (SELECT three.*, up_l AS up_label, baseline_ret_20d FROM three CROSS JOIN ext LEFT JOIN mom USING (trade_date)) """ + rule_sql(
        rules, ("predicted_up_label", "pred_label = up_label"), aggs)


def long_short_sql():
    base = "SELECT {rule} AS rule, {t}::DOUBLE AS threshold, {side} AS side, {p} AS p, {cond} AS hit, * FROM rows"
    parts = [base.format(rule="'baseline_always_long'", t="NULL", side="1", p="NULL::DOUBLE", cond="true"),
             base.format(rule="'baseline_always_short'", t="NULL", side="-1", p="NULL::DOUBLE", cond="true"),
             base.format(rule="'predicted_long_short_label'", t="NULL", side="position", p="dp", cond="position <> 0"),
             base.format(rule="'predicted_long_short_label_year_' || test_year", t="NULL", side="position", p="dp", cond="position <> 0")]
    parts += [base.format(rule="'long_short_probability'", t=repr(t), side="position", p="dp",
                          cond=f"(position <> 0 AND dp >= {t!r}::DOUBLE)") for t in (0.4, 0.45, 0.5, 0.55, 0.6)]
    return "WITH " + three().strip() + EXTREMES + f""",
rows AS (
  SELECT three.* EXCLUDE (short_label), up_l AS long_label, down_l AS short_label, greatest(buy_proba, short_proba) AS dp,
    CASE WHEN pred_label = up_l THEN 1 WHEN pred_label = down_l THEN -1 ELSE 0 END AS position
  FROM three CROSS JOIN ext)
SELECT rule, threshold, max(long_label) AS long_label, max(short_label) AS short_label,
  count(*) FILTER (hit) AS signal_count, {r9("count(*) FILTER (hit) / count(*)::DOUBLE", "coverage")},
  count(*) FILTER (hit AND side = 1) AS long_count, count(*) FILTER (hit AND side = -1) AS short_count,
  {r9(hit(b("side * future_ret > 0")), "direction_accuracy")},
  {r9("avg(CASE WHEN hit AND side = 1 THEN " + b("future_ret > 0") + " END)", "long_precision")},
  {r9("avg(CASE WHEN hit AND side = -1 THEN " + b("future_ret < 0") + " END)", "short_precision")},
  {r9(hit("side * future_ret"), "avg_strategy_ret")},
  {r9("median(CASE WHEN hit THEN side * future_ret END)", "median_strategy_ret")},
  {r9("avg(CASE WHEN hit AND side = 1 THEN future_ret END)", "avg_future_ret_when_long")},
  {r9("avg(CASE WHEN hit AND side = -1 THEN future_ret END)", "avg_future_ret_when_short")},
  {r9(hit("p"), "avg_direction_proba")}
FROM ({' UNION ALL '.join(parts)}) GROUP BY rule, threshold"""


def grid_sql():
    keys = ["test_year", "horizon", "regime"]
    sig = ", ".join(keys)
    return scores() + f""",
wf AS (SELECT 'all' AS regime, * FROM scores UNION ALL SELECT evaluation_regime, * FROM scores WHERE evaluation_regime IN ('bull', 'bear')),
wf_sig AS (SELECT wf.*, threshold FROM wf JOIN {values('threshold', [0.6, 0.7, 0.8])} ON buy_proba >= threshold)""" + independent(
        "wf_sig", [*keys, "index_code", "threshold"]) + f""",
wf_modes AS (SELECT 'all_signals' AS sample_mode, * FROM wf_sig UNION ALL SELECT 'non_overlapping', * FROM picked),
wf_uni AS (
  SELECT {sig}, max(label_threshold) AS label_threshold, count(*) AS regime_rows,
    avg({b('future_ret > label_threshold')}) AS natural_precision, avg({b('future_ret > 0')}) AS natural_actual_up_rate,
    avg(future_ret) AS natural_avg_strategy_ret FROM wf GROUP BY ALL),
wf_got AS (
  SELECT {sig}, threshold, sample_mode, count(*) AS signal_count, avg({b('future_ret > label_threshold')}) AS precision,
    avg({b('future_ret > 0')}) AS actual_up_rate, avg(future_ret) AS avg_strategy_ret, median(future_ret) AS median_strategy_ret,
    avg(buy_proba) AS avg_proba FROM wf_modes GROUP BY ALL),
wf_grid AS (
  SELECT u.*, t.threshold, m.sample_mode, 'buy' AS side, coalesce(g.signal_count, 0) AS signal_count, g.precision, g.actual_up_rate,
    g.avg_strategy_ret, g.median_strategy_ret, g.avg_proba
  FROM wf_uni u CROSS JOIN {values('threshold', [0.6, 0.7, 0.8]).replace('threshold_t', 't')}
  CROSS JOIN {values('sample_mode', ['all_signals', 'non_overlapping']).replace('sample_mode_t', 'm')}
  LEFT JOIN wf_got g ON g.test_year = u.test_year AND g.horizon = u.horizon AND g.regime = u.regime
    AND g.threshold = t.threshold AND g.sample_mode = m.sample_mode)"""


def gate_sql():
    return "WITH RECURSIVE " + (scores() + f""",
gt AS (SELECT *, 0.6::DOUBLE AS base_buy_threshold FROM scores),
gt_sig AS (
  SELECT 'no_gate' AS gate, * FROM gt WHERE buy_proba >= 0.6::DOUBLE
  UNION ALL SELECT 'hard_gate', * FROM gt WHERE causal_regime = 'bull' AND buy_proba >= 0.6::DOUBLE
  UNION ALL SELECT 'soft_gate', * FROM gt WHERE buy_proba >= CASE causal_regime WHEN 'bull' THEN 0.6::DOUBLE WHEN 'bear' THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END)"""
        + independent("gt_sig", ["test_year", "horizon", "index_code", "gate"])).strip() + f""",
gt_modes AS (SELECT 'all_signals' AS sample_mode, * FROM gt_sig UNION ALL SELECT 'non_overlapping', * FROM picked),
gt_uni AS (
  SELECT scope, test_year, horizon, max(label_threshold) AS label_threshold, max(base_buy_threshold) AS base_buy_threshold, count(*) AS universe_rows
  FROM ({both_scopes('gt', 'horizon, label_threshold, base_buy_threshold')}) GROUP BY ALL),
gt_got AS (
  SELECT scope, test_year, horizon, gate, sample_mode, count(*) AS signal_count, {r9('avg(' + b('future_ret > label_threshold') + ')', 'precision')},
    {r9('avg(' + b('future_ret > 0') + ')', 'actual_up_rate')}, {r9('avg(future_ret)', 'avg_future_ret')},
    {r9('median(future_ret)', 'median_future_ret')}, {r9('avg(buy_proba)', 'avg_buy_proba')},
    {', '.join(f"count(*) FILTER (causal_regime = '{r}') AS {r}_signal_count" for r in ('bull', 'neutral', 'bear'))}
  FROM ({both_scopes('gt_modes', 'horizon, gate, sample_mode, future_ret, label_threshold, buy_proba, causal_regime')}) GROUP BY ALL)
SELECT u.scope, u.test_year, u.horizon, u.label_threshold, u.base_buy_threshold, u.universe_rows, a.gate, m.sample_mode,
  coalesce(g.signal_count, 0) AS signal_count, {', '.join(f'coalesce(g.{r}_signal_count, 0) AS {r}_signal_count' for r in ('bull', 'neutral', 'bear'))},
  {r9('coalesce(g.signal_count, 0) / u.universe_rows::DOUBLE', 'coverage')}, g.precision, g.actual_up_rate, g.avg_future_ret,
  g.median_future_ret, g.avg_buy_proba
FROM gt_uni u CROSS JOIN {values('gate', L.GATES).replace('gate_t', 'a')}
CROSS JOIN {values('sample_mode', ['all_signals', 'non_overlapping']).replace('sample_mode_t', 'm')}
LEFT JOIN gt_got g ON g.scope = u.scope AND g.test_year IS NOT DISTINCT FROM u.test_year AND g.horizon = u.horizon
  AND g.gate = a.gate AND g.sample_mode = m.sample_mode"""


def ablation_sql():
    return "WITH RECURSIVE " + (scores() + """,
ab AS (
  SELECT trade_date, index_code, test_year, trade_pos, future_ret, is_bull_trend, v.variant, v.feature_count,
    CAST((trade_pos * 17 + v.k * 31 + code * 5) % 101 AS DOUBLE) / 100 AS buy_proba
  FROM scores, (VALUES ('1_basic', 18, 0), ('2_technical', 58, 1)) AS v(variant, feature_count, k)),
ab_sig AS (SELECT * FROM ab WHERE is_bull_trend = 1 AND buy_proba >= 0.6::DOUBLE)"""
        + independent("ab_sig", ["variant", "test_year", "index_code"])).strip() + f""",
ab_uni AS (
  SELECT variant, scope, test_year, max(feature_count) AS feature_count, count(*) FILTER (is_bull_trend = 1) AS universe_rows,
    {r9('avg(CASE WHEN is_bull_trend = 1 THEN ' + b('future_ret > 0.005::DOUBLE') + ' END)', 'natural_precision')},
    {r9('avg(CASE WHEN is_bull_trend = 1 THEN ' + b('future_ret > 0') + ' END)', 'natural_actual_up_rate')},
    {r9('avg(CASE WHEN is_bull_trend = 1 THEN future_ret END)', 'natural_avg_future_ret')}
  FROM ({both_scopes('ab', 'variant, feature_count, is_bull_trend, future_ret')}) GROUP BY variant, scope, test_year),
ab_got AS (
  SELECT variant, scope, test_year, count(*) AS signal_count, {r9('avg(' + b('future_ret > 0.005::DOUBLE') + ')', 'precision')},
    {r9('avg(' + b('future_ret > 0') + ')', 'actual_up_rate')}, {r9('avg(future_ret)', 'avg_future_ret')},
    {r9('median(future_ret)', 'median_future_ret')}, {r9('avg(buy_proba)', 'avg_buy_proba')}
  FROM ({both_scopes('picked', 'variant, future_ret, buy_proba')}) GROUP BY variant, scope, test_year)
SELECT u.*, 0.005::DOUBLE AS label_threshold, 0.6::DOUBLE AS probability_threshold, coalesce(g.signal_count, 0) AS signal_count,
  {r9('coalesce(coalesce(g.signal_count, 0) / nullif(u.universe_rows, 0)::DOUBLE, 0)', 'coverage')}, g.precision, g.actual_up_rate, g.avg_future_ret, g.median_future_ret, g.avg_buy_proba
FROM ab_uni u LEFT JOIN ab_got g ON g.variant = u.variant AND g.scope = u.scope AND g.test_year IS NOT DISTINCT FROM u.test_year"""


def conflict_sql():
    n = "count(*) FILTER (hit)"
    return "WITH " + scores().strip() + f""",
cf AS (SELECT *, (buy_proba >= threshold AND short_proba >= threshold) AS hit FROM scores, {values('threshold', [0.5, 0.55, 0.6])})
SELECT threshold, count(*) AS test_rows, count(*) FILTER (buy_proba >= threshold) AS buy_signal_count,
  count(*) FILTER (short_proba >= threshold) AS short_signal_count, {n} AS conflict_count,
  {r9(f'{n} / count(*)::DOUBLE', 'conflict_rate_in_rows')},
  {r9(f'{n} / nullif(count(*) FILTER (buy_proba >= threshold), 0)::DOUBLE', 'conflict_rate_in_buy_signals')},
  {r9(f'{n} / nullif(count(*) FILTER (short_proba >= threshold), 0)::DOUBLE', 'conflict_rate_in_short_signals')},
  {r9(hit('future_ret'), 'conflict_avg_future_ret')}, {r9('median(CASE WHEN hit THEN future_ret END)', 'conflict_median_future_ret')},
  {r9(hit(b('future_ret > 0')), 'conflict_actual_up_rate')}, {r9(hit(b('future_ret < 0')), 'conflict_actual_down_rate')}
FROM cf GROUP BY threshold"""


SCOPE_SQL = (f"CASE WHEN trade_date >= DATE '{fx.SPLITS['test_start']}' THEN 'test' WHEN trade_date BETWEEN DATE '{fx.SPLITS['valid_start']}' "
             f"AND DATE '{fx.SPLITS['valid_end']}' THEN 'valid' WHEN trade_date BETWEEN DATE '{fx.SPLITS['train_start']}' AND "
             f"DATE '{fx.SPLITS['train_end']}' THEN 'train' ELSE 'outside' END")


def regime_sql():
    return "WITH " + scores().strip() + f""",
rg AS (
  SELECT {SCOPE_SQL} AS sample_scope, evaluation_regime AS regime, 'buy' AS side, buy_proba AS proba, future_ret AS strategy_ret FROM scores
  WHERE evaluation_regime IN ('bull', 'bear')
  UNION ALL SELECT {SCOPE_SQL}, evaluation_regime, 'short', short_proba, -future_ret FROM scores WHERE evaluation_regime IN ('bull', 'bear')),
rh AS (SELECT *, proba >= threshold AS hit FROM rg, {values('threshold', [0.5, 0.55, 0.6])})
SELECT sample_scope, regime, side, threshold, count(*) AS regime_rows, count(*) FILTER (hit) AS signal_count,
  {r9('count(*) FILTER (hit) / count(*)::DOUBLE', 'coverage')}, {r9(hit(b('strategy_ret > 0')), 'precision')},
  {r9(hit('strategy_ret'), 'avg_strategy_ret')}, {r9('median(CASE WHEN hit THEN strategy_ret END)', 'median_strategy_ret')},
  {r9(hit('proba'), 'avg_proba')}
FROM rh GROUP BY ALL"""


_wf_cols = ["natural_precision", "natural_actual_up_rate", "natural_avg_strategy_ret", "precision", "actual_up_rate",
            "avg_strategy_ret", "median_strategy_ret", "avg_proba"]
_fr = ", ".join(f"{ov.ratio(f'lead(close, {h}) OVER ({ov._PART})', 'close')} - 1 AS future_ret_{h}d" for h in (3, 5, 7))
ORACLES = {
    "forward_returns": ov.with_(ov.BARS) + f"SELECT trade_date, index_code, {', '.join(r9(f'future_ret_{h}d', f'future_ret_{h}d') for h in (3, 5, 7))} FROM (SELECT *, {_fr} FROM bars)",
    "labels_3class": ov.with_(ov.ROLLING) + "SELECT trade_date, index_code, "
    + ", ".join(f"{label_sql(f'future_ret_{h}d', 'volatility_20d', h)} AS label_{h}d" for h in (3, 5, 7))
    + f" FROM (SELECT *, {_fr} FROM rolling)",
    "labels_binary": ov.with_(ov.BARS) + f"""SELECT trade_date, index_code, CAST(future_ret_5d > 0 AS INTEGER) AS buy_label_5d,
  CAST(future_ret_7d > 0.005::DOUBLE AS INTEGER) AS buy_label_7d, CAST(future_ret_5d < 0 AS INTEGER) AS short_label_5d,
  CAST(future_ret_7d < 0 AS INTEGER) AS short_label_7d FROM (SELECT *, {_fr} FROM bars)""",
    "signal_gate": "WITH " + scores().strip() + f"""
SELECT trade_date, index_code, causal_regime, evaluation_regime, {SCOPE_SQL} AS sample_scope,
  CASE WHEN causal_regime = 'bull' AND buy_proba >= 0.6::DOUBLE THEN 'long' ELSE 'neutral' END AS direction,
  CAST(buy_proba >= 0.6::DOUBLE AS INTEGER) AS no_gate,
  CAST(causal_regime = 'bull' AND buy_proba >= 0.6::DOUBLE AS INTEGER) AS hard_gate,
  CAST(buy_proba >= CASE causal_regime WHEN 'bull' THEN 0.6::DOUBLE WHEN 'bear' THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS INTEGER) AS soft_gate
FROM scores""",
    "trade_positions": "WITH " + scores().strip() + " SELECT trade_date, index_code, test_year, trade_pos FROM scores",
    "non_overlap": "WITH RECURSIVE " + (scores() + ", so AS (SELECT * FROM scores WHERE buy_proba >= 0.6::DOUBLE)"
                                         + independent("so", ["index_code", "test_year", "horizon"])).strip()
    + " SELECT index_code, test_year, horizon, trade_date, trade_pos FROM picked",
    "purge": "WITH " + scores().strip() + f""", panel AS (SELECT index_code, test_year, trade_date FROM scores
  UNION ALL SELECT 'late', test_year, trade_date FROM scores WHERE index_code = '1' AND dayofyear(trade_date) > 356)
SELECT index_code, test_year, trade_date FROM (
  SELECT *, row_number() OVER (PARTITION BY index_code, test_year ORDER BY trade_date DESC) AS back FROM panel) WHERE back > 7""",
    "prob_buckets": "WITH " + scores().strip() + f"""
SELECT {PROBA_BUCKET} AS bucket, count(*) AS n,
  round(avg(ln(greatest(least(buy_proba, 0.999999::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(buy_proba, 0.999999::DOUBLE), 0.000001::DOUBLE)))), 6) AS avg_logit
FROM scores GROUP BY 1""",
    "label_thresholds": experiment(EX_ROWS, ["label_threshold"], over([0.5, 0.6, 0.7, 0.8], "probability_threshold"),
                                   "probability_threshold", [0.5, 0.6, 0.7, 0.8], _label_aggs, _label_out),
    "label_threshold_buckets": experiment(EX_ROWS, ["label_threshold"], bucketed("probability_bucket"),
                                          "probability_bucket", L.BUCKET_NAMES, _label_aggs, _label_out),
    "brier_calibration": "WITH " + CAL_ROWS.strip() + f""",
cq AS (SELECT * FROM ex_rows WHERE f_is_bull_trend = 1)
SELECT scope, test_year, calibration_method, count(*) AS sample_count, {r9('avg(buy_proba)', 'avg_predicted_probability')},
  {r9('avg(actual_label)', 'actual_target_rate')}, {r9('avg((buy_proba - actual_label) * (buy_proba - actual_label))', 'brier_score')},
  {r9('avg(buy_proba) - avg(actual_label)', 'calibration_gap')}
FROM ({both_scopes('cq', 'calibration_method, buy_proba, actual_label')}) GROUP BY scope, test_year, calibration_method""",
    "calibration_signals": experiment(
        CAL_ROWS, ["calibration_method"], over([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8], "probability_threshold"),
        "probability_threshold", [0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8],
        ", ".join([r9("avg(actual_label)", "target_precision"), r9(f"avg({b('future_ret > 0')})", "actual_up_rate"),
                   r9("avg(future_ret)", "avg_future_ret"), r9("median(future_ret)", "median_future_ret"),
                   r9("avg(buy_proba)", "avg_buy_proba")]),
        ["target_precision", "actual_up_rate", "avg_future_ret", "median_future_ret", "avg_buy_proba"]),
    "calibration_buckets": experiment(
        CAL_ROWS, ["calibration_method"], bucketed("probability_bucket"), "probability_bucket", L.BUCKET_NAMES,
        ", ".join([r9("avg(buy_proba)", "avg_predicted_probability"), r9("avg(actual_label)", "target_precision"),
                   r9(f"avg({b('future_ret > 0')})", "actual_up_rate"), r9("avg(future_ret)", "avg_future_ret")]),
        ["avg_predicted_probability", "target_precision", "actual_up_rate", "avg_future_ret"]),
    "ablation_metrics": ablation_sql(),
    "walk_forward_grid": "WITH RECURSIVE " + grid_sql().strip() + f"""
SELECT test_year, horizon, regime, label_threshold, threshold, sample_mode, side, regime_rows, signal_count,
  {', '.join(r9(n, n) for n in _wf_cols)}, {r9('signal_count / regime_rows::DOUBLE', 'coverage')},
  {r9('precision - natural_precision', 'precision_lift')}, {r9('avg_strategy_ret - natural_avg_strategy_ret', 'avg_strategy_ret_lift')}
FROM wf_grid""",
    "weighted_aggregate": "WITH RECURSIVE " + grid_sql().strip() + f""",
wa AS (
  SELECT horizon, regime, side, threshold, label_threshold, sample_mode, count(DISTINCT test_year) AS evaluated_years,
    CAST(sum(regime_rows) AS BIGINT) AS regime_rows, CAST(sum(signal_count) AS BIGINT) AS signal_count,
    sum(signal_count) / sum(regime_rows)::DOUBLE AS coverage,
    {', '.join(f"coalesce(sum({n} * signal_count), 0) / nullif(sum(signal_count), 0)::DOUBLE AS {n}" for n in ('precision', 'actual_up_rate', 'avg_strategy_ret'))},
    {', '.join(f"coalesce(sum({n} * regime_rows), 0) / nullif(sum(regime_rows), 0)::DOUBLE AS {n}" for n in ('natural_precision', 'natural_actual_up_rate', 'natural_avg_strategy_ret'))}
  FROM wf_grid GROUP BY horizon, regime, side, threshold, label_threshold, sample_mode)
SELECT horizon, regime, side, threshold, label_threshold, sample_mode, evaluated_years, regime_rows, signal_count,
  {', '.join(r9(n, n) for n in ('coverage', 'precision', 'actual_up_rate', 'avg_strategy_ret', 'natural_precision', 'natural_actual_up_rate', 'natural_avg_strategy_ret'))},
  {r9('precision - natural_precision', 'precision_lift')}, {r9('avg_strategy_ret - natural_avg_strategy_ret', 'avg_strategy_ret_lift')} FROM wa""",
    "gate_compare": gate_sql(),
    "rule_metrics_buy": binary_sql("buy", (0.50, 0.55, 0.60, 0.65, 0.70, 0.80)),
    "rule_metrics_short": binary_sql("short", (0.35, 0.5, 0.6)),
    "up_signal_metrics": up_sql(),
    "long_short_metrics": long_short_sql(),
    "conflict_metrics": conflict_sql(),
    "conflict_details": "WITH " + scores().strip() + f""" SELECT threshold, trade_date, index_code, round(buy_proba, 9) AS buy_proba,
  round(short_proba, 9) AS short_proba, {r9('future_ret', 'future_ret')} FROM scores, {values('threshold', [0.5, 0.55, 0.6])}
  WHERE buy_proba >= threshold AND short_proba >= threshold""",
    "regime_metrics": regime_sql(),
    "class_metrics": "WITH " + three().strip() + f""",
cl AS (SELECT DISTINCT label AS class FROM three WHERE label IS NOT NULL UNION SELECT DISTINCT pred_label FROM three WHERE pred_label IS NOT NULL),
cm AS (SELECT class, (SELECT count(*) FROM three t WHERE t.label = cl.class) AS support, (SELECT count(*) FROM three t WHERE t.pred_label = cl.class) AS pred_count,
  (SELECT count(*) FROM three t WHERE t.label = cl.class AND t.pred_label = cl.class) AS n FROM cl),
cp AS (SELECT *, coalesce(n / nullif(pred_count, 0)::DOUBLE, 0) AS p, coalesce(n / nullif(support, 0)::DOUBLE, 0) AS r FROM cm)
SELECT class, support, pred_count, {r9('p', 'precision')}, {r9('r', 'recall')}, {r9('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM cp""",
    "class_summary": "WITH " + three().strip() + f" SELECT {r9('avg(' + b('label = pred_label') + ')', 'accuracy')}, {r9('avg(abs(future_ret - pred_ret))', 'mae')} FROM three",
    "ic_rank_ic": "WITH " + three().strip() + f""",
rk AS (SELECT *, rank() OVER (ORDER BY future_ret) + (count(*) OVER (PARTITION BY future_ret) - 1) / 2.0 AS rr,
  rank() OVER (ORDER BY pred_ret) + (count(*) OVER (PARTITION BY pred_ret) - 1) / 2.0 AS rp, greatest(buy_proba, 1 - buy_proba) AS confidence FROM three)
SELECT round(avg({b('label = pred_label')}), 6) AS accuracy, round(avg(abs(future_ret - pred_ret)), 6) AS mae,
  round(sqrt(avg((future_ret - pred_ret) * (future_ret - pred_ret))), 6) AS rmse, round(corr(pred_ret, future_ret), 6) AS ic,
  round(corr(rp, rr), 6) AS rank_ic, count(*) FILTER (confidence >= 0.6::DOUBLE) AS high_confidence_count,
  round(avg(CASE WHEN confidence >= 0.6::DOUBLE THEN {b('label = pred_label')} END), 6) AS high_confidence_accuracy FROM rk""",
    "feature_inventory": ov.with_(ov.ROLLING) + " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", '{n}' AS feature, count({n}) AS non_null_rows, count(*) FILTER ({n} <> 0) AS non_zero_rows FROM rolling"
        for g, n in (("shape", "upper_shadow_ratio"), ("shape", "doji"), ("shape", "rsi14"), ("trend", "regime_trend_score"), ("trend", "is_bull_trend"))),
}
