"""Signal, rule, regime and model metrics over scored rows.

Scored rows hold one instrument and day each.  The pooled numbers of a panel come
from map-side combined aggregates and from bucketed exact medians; only the greedy
non-overlap choice needs the rows of one instrument and year together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.labels import (BUCKET_NAMES, GATES, gate_passes, probability_bucket,
                                      sample_scope)
from barloom.functions.nulls import holds
from barloom.operators.metrics import (Rule, expand_rules, explode_values, hit_count, hit_mean,
                                       hit_rate, pool_scopes, rate, rule_item, scope_year, share,
                                       with_median, yearly_name)
from barloom.operators.ranking import average_ranks
from barloom.operators.selection import non_overlapping
from barloom.schemas import SIGNAL_HORIZON
from barloom.session import cut_lineage

c = F.col
ALL_SIGNALS, INDEPENDENT = "all_signals", "non_overlapping"



# --- rule families over a split -------------------------------------------------------------

def _rule_family(rows: DataFrame, keys: list[str], rules: list[Rule], yearly: tuple[str, Column],
                 aggs: list[Column], ret: str, median: str, date: str) -> DataFrame:
    """A rule family over the slice plus one rule per calendar year."""
    ruled = expand_rules(rows, rules, yearly, date)
    ids = [*keys, "rule", "_t"]
    out = ruled.groupBy(*ids).agg(
        F.max("threshold").alias("threshold"), hit_count().alias("signal_count"),
        share(hit_count(), F.count(F.lit(1))).alias("coverage"), *aggs)
    return with_median(out, ruled.filter("hit"), ids, ret, median).drop("_t")


def binary_rule_metrics(rows: DataFrame, side: str = "buy", keys: list[str] | None = None,
                        thresholds: Sequence[float] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.80),
                        label: str | None = None, ret: str = "future_ret", proba: str | None = None,
                        predicted: str | None = None, momentum: str = "f_ret_5d",
                        trend: str = "f_ma20_gap", date: str = "trade_date") -> DataFrame:
    """Baselines, predicted label, probability thresholds and years of a binary model.

    ``side`` is ``buy`` or ``short``; the short family mirrors every sign.  Without a
    ``predicted`` column the label is the more probable class.
    """
    keys, label, proba = keys or [], label or f"{side}_label", proba or f"{side}_proba"
    buy = side == "buy"
    hit_class = c(predicted) == 1 if predicted else c(proba) > 0.5
    word, suffix = ("positive", "") if buy else ("negative", "_short")

    def signed(name: str) -> Column:
        return c(name) > 0 if buy else c(name) < 0

    rules: list[Rule] = [(f"baseline_all_rows{suffix}", None, F.lit(True))]
    if momentum in rows.columns:
        rules.append((f"baseline_ret_5d_{word}", None, signed(momentum)))
    if trend in rows.columns:
        rules.append((f"baseline_ma20_gap_{word}", None, signed(trend)))
    rules.append((f"predicted_{side}_label", None, hit_class))
    rules += [(f"{side}_probability", float(t), c(proba) >= t) for t in thresholds]
    truth = c(label) == 1
    found = F.count_if(c("hit") & holds(truth))
    aggs = [
        F.when(hit_count() > 0, share(found, hit_count())).alias(f"{side}_precision"),
        F.when(hit_count() > 0, share(found, F.count_if(holds(truth)))).alias(f"{side}_recall"),
        hit_rate(signed(ret)).alias(f"{word}_ret_rate"),
        hit_mean(c(ret)).alias("avg_future_ret"),
        hit_mean(c(proba)).alias(f"avg_{side}_proba"),
    ]
    if not buy:
        aggs.append(hit_mean(-c(ret)).alias("avg_short_strategy_ret"))
    out = _rule_family(rows, keys, rules, (f"predicted_{side}_label", hit_class), aggs, ret,
                       "median_future_ret", date)
    return out if buy else out.withColumn("median_short_strategy_ret", -c("median_future_ret"))


def with_extreme_labels(rows: DataFrame, label: str = "label", ret: str = "future_ret",
                        keys: list[str] | None = None) -> DataFrame:
    """Append ``_labels``: the labels with the highest and the lowest mean return, for each key of its own."""
    keys = keys or []
    means = rows.filter(c(label).isNotNull()).groupBy(*keys, label).agg(F.avg(ret).alias("_m")) \
        .filter(c("_m").isNotNull())
    ends = F.struct(F.max_by(label, "_m").alias("high"), F.min_by(label, "_m").alias("low")).alias("_labels")
    if not keys:
        return rows.withColumn("_labels", means.agg(ends).scalar())
    found = means.groupBy(*[c(k).alias(f"_k_{k}") for k in keys]).agg(ends)
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys])
    return rows.join(found, same, "left").drop(*[f"_k_{k}" for k in keys])


def probability_of(label: Column, classes: Sequence[str], prefix: str = "proba_") -> Column:
    """The class probability column that belongs to a label held in another column."""
    return F.coalesce(*[F.when(label == F.lit(name), c(f"{prefix}{name}")) for name in classes])


def momentum_baseline(bars: DataFrame, code: str, n: int = 20) -> DataFrame:
    """n-row momentum of one instrument, one row per date."""
    from barloom.operators.frames import Series, stage
    one = bars.filter(c("index_code") == code).select("trade_date", "index_code",
                                                      c("close").cast("double").alias("close"))
    return stage(one, {f"baseline_ret_{n}d": Series().change("close", n)}) \
        .select("trade_date", f"baseline_ret_{n}d")


def up_signal_metrics(rows: DataFrame, keys: list[str] | None = None,
                      thresholds: Sequence[float] = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6),
                      ret: str = "future_ret", label: str = "label", trend: str = "f_ma20_gap",
                      momentum: str = "f_ret_5d", long_momentum: str = "baseline_ret_20d",
                      date: str = "trade_date") -> DataFrame:
    """Three-class signal quality with the up class inferred from the data of each key.

    Rows carry ``up_proba``, or one ``proba_<label>`` column per class, of which the up
    class's is taken.
    """
    keys = keys or []
    rows = with_extreme_labels(rows, label, ret, keys).withColumn("up_label", c("_labels.high"))
    if "up_proba" not in rows.columns:
        rows = rows.withColumn("up_proba", probability_of(c("up_label"), class_names(rows)))
    is_up = c("pred_label") == c("up_label")
    rules: list[Rule] = [("baseline_all_rows", None, F.lit(True)), ("always_up", None, F.lit(True))]
    for name, column in (("ma20_trend_up", trend), ("momentum_5d_positive", momentum),
                         ("ret_20d_positive", long_momentum)):
        if column in rows.columns:
            rules.append((name, None, c(column) > 0))
    rules.append(("predicted_up_label", None, is_up))
    rules += [("up_probability", float(t), c("up_proba") >= t) for t in thresholds]
    aggs = [
        F.max("up_label").alias("up_label"),
        hit_rate(c(label) == c("up_label")).alias("actual_up_rate"),
        hit_rate(c(ret) > 0).alias("positive_ret_rate"),
        hit_mean(c(ret)).alias("avg_future_ret"),
        hit_mean(c("pred_ret")).alias("avg_pred_ret"),
        hit_mean(c("up_proba")).alias("avg_up_proba"),
    ]
    return _rule_family(rows, keys, rules, ("predicted_up_label", is_up), aggs, ret,
                        "median_future_ret", date)


def class_names(rows: DataFrame, prefix: str = "proba_") -> list[str]:
    return [n.removeprefix(prefix) for n in rows.columns if n.startswith(prefix)]


def with_position(rows: DataFrame, label: str = "label", ret: str = "future_ret",
                  predicted: str = "pred_label", keys: list[str] | None = None) -> DataFrame:
    """Position +1/-1/0 from the predicted label and the long and short labels inferred for each key.

    With class probabilities the columns ``long_proba``, ``short_proba`` and
    ``direction_proba`` (the larger of the two) are added.
    """
    rows = with_extreme_labels(rows, label, ret, keys).withColumns({
        "long_label": c("_labels.high"), "short_label": c("_labels.low")}).drop("_labels")
    position = F.when(c(predicted) == c("long_label"), 1) \
        .when(c(predicted) == c("short_label"), -1).otherwise(0)
    out = rows.withColumn("position", position)
    names = class_names(rows)
    if not names:
        return out
    return out.withColumns({"long_proba": probability_of(c("long_label"), names),
                            "short_proba": probability_of(c("short_label"), names)}).withColumn(
        "direction_proba", F.greatest("long_proba", "short_proba"))


def long_short_metrics(rows: DataFrame, keys: list[str] | None = None,
                       thresholds: Sequence[float] = (0.4, 0.45, 0.5, 0.55, 0.6),
                       ret: str = "future_ret", proba: str = "direction_proba",
                       date: str = "trade_date") -> DataFrame:
    """Long/short quality of rows that carry ``position``, labels and a probability."""
    keys = keys or []

    moved, side, p = c("position") != 0, c("position"), c(proba)

    def item(rule: Column, threshold: float | None, hit: Column, side: Column, p: Column) -> Column:
        return rule_item(rule, threshold, hit, _side=side.cast("int"), _ret=side * c(ret),
                         _p=p.cast("double"))

    items = [
        item(F.lit("baseline_always_long"), None, F.lit(True), F.lit(1), F.lit(None)),
        item(F.lit("baseline_always_short"), None, F.lit(True), F.lit(-1), F.lit(None)),
        item(F.lit("predicted_long_short_label"), None, moved, side, p),
        item(yearly_name("predicted_long_short_label", date), None, moved, side, p),
        *[item(F.lit("long_short_probability"), float(t), moved & (p >= t), side, p) for t in thresholds],
    ]
    ruled = rows.select("*", F.inline(F.array(*items)))
    ids = [*keys, "rule", "_t"]
    longs, shorts = c("_side") == 1, c("_side") == -1

    def side_mean(value: Column, side: Column) -> Column:
        return F.avg(F.when(c("hit") & side, value))

    out = ruled.groupBy(*ids).agg(
        F.max("threshold").alias("threshold"), F.max("long_label").alias("long_label"), F.max("short_label").alias("short_label"),
        hit_count().alias("signal_count"), share(hit_count(), F.count(F.lit(1))).alias("coverage"),
        hit_count(longs).alias("long_count"), hit_count(shorts).alias("short_count"),
        hit_rate(c("_ret") > 0).alias("direction_accuracy"),
        side_mean(holds(c(ret) > 0).cast("double"), longs).alias("long_precision"),
        side_mean(holds(c(ret) < 0).cast("double"), shorts).alias("short_precision"),
        hit_mean(c("_ret")).alias("avg_strategy_ret"),
        side_mean(c(ret), longs).alias("avg_future_ret_when_long"),
        side_mean(c(ret), shorts).alias("avg_future_ret_when_short"),
        hit_mean(c("_p")).alias("avg_direction_proba"))
    return with_median(out, ruled.filter("hit"), ids, "_ret", "median_strategy_ret").drop("_t")


# --- conflicts and regimes ------------------------------------------------------------------

def conflict_rows(rows: DataFrame, thresholds: Sequence[float] = (0.5, 0.55, 0.6)) -> DataFrame:
    """Rows on which the buy and the short model both fire, per threshold."""
    return explode_values(rows, "threshold", [float(t) for t in thresholds]).filter(
        (c("buy_proba") >= c("threshold")) & (c("short_proba") >= c("threshold")))


def conflict_metrics(rows: DataFrame, thresholds: Sequence[float] = (0.5, 0.55, 0.6),
                     keys: list[str] | None = None, ret: str = "future_ret") -> DataFrame:
    keys = [*(keys or []), "threshold"]
    grid = explode_values(rows, "threshold", [float(t) for t in thresholds])
    buy, short = c("buy_proba") >= c("threshold"), c("short_proba") >= c("threshold")
    grid = grid.withColumn("hit", holds(buy & short))
    buys, shorts = F.count_if(holds(buy)), F.count_if(holds(short))
    out = grid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_rows"), buys.alias("buy_signal_count"),
        shorts.alias("short_signal_count"), hit_count().alias("conflict_count"),
        share(hit_count(), F.count(F.lit(1))).alias("conflict_rate_in_rows"),
        F.try_divide(hit_count().cast("double"), buys.cast("double")).alias("conflict_rate_in_buy_signals"),
        F.try_divide(hit_count().cast("double"), shorts.cast("double")).alias("conflict_rate_in_short_signals"),
        hit_mean(c(ret)).alias("conflict_avg_future_ret"),
        hit_rate(c(ret) > 0).alias("conflict_actual_up_rate"),
        hit_rate(c(ret) < 0).alias("conflict_actual_down_rate"))
    return with_median(out, grid.filter("hit"), keys, ret, "conflict_median_future_ret")


def regime_metrics(rows: DataFrame, splits: dict | None = None,
                   thresholds: Sequence[float] = (0.5, 0.55, 0.6), keys: list[str] | None = None,
                   ret: str = "future_ret") -> DataFrame:
    """Sample scope x evaluation regime x side x threshold over bull and bear rows."""
    sides = F.array(
        F.struct(F.lit("buy").alias("side"), c("buy_proba").alias("proba"), c(ret).alias("strategy_ret")),
        F.struct(F.lit("short").alias("side"), c("short_proba").alias("proba"), (-c(ret)).alias("strategy_ret")))
    base = rows.filter(c("evaluation_regime").isin("bull", "bear")).withColumns({
        "sample_scope": sample_scope(c("trade_date"), splits), "regime": c("evaluation_regime")})
    grid = explode_values(base.select(*(keys or []), "sample_scope", "regime", F.inline(sides)),
                          "threshold", [float(t) for t in thresholds])
    grid = grid.withColumn("hit", holds(c("proba") >= c("threshold")))
    ids = [*(keys or []), "sample_scope", "regime", "side", "threshold"]
    out = grid.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("regime_rows"), hit_count().alias("signal_count"),
        share(hit_count(), F.count(F.lit(1))).alias("coverage"),
        hit_rate(c("strategy_ret") > 0).alias("precision"),
        hit_mean(c("strategy_ret")).alias("avg_strategy_ret"),
        hit_mean(c("proba")).alias("avg_proba"))
    return with_median(out, grid.filter("hit"), ids, "strategy_ret", "median_strategy_ret")


# --- walk-forward grids ---------------------------------------------------------------------

def _both_modes(signals: DataFrame, keys: list[str], horizon: Column) -> DataFrame:
    """All signals and the greedy independent ones, tagged by sample mode."""
    picked = non_overlapping(signals, keys, horizon)
    return signals.withColumn("sample_mode", F.lit(ALL_SIGNALS)).unionByName(
        picked.withColumn("sample_mode", F.lit(INDEPENDENT)))


def kept_once(details: DataFrame, names: Sequence[str]) -> DataFrame:
    """A narrow copy of the scored rows in the shared checkpoint folder.

    Universe, both sample modes and the medians all read it, so the windows behind the
    scores run once.
    """
    return cut_lineage(details.select(*[n for n in names if n in details.columns]))


def walk_forward_summary(details: DataFrame, thresholds: Sequence[float] = (0.6, 0.7, 0.8),
                         series: Sequence[str] = ("index_code",), ret: str = "future_ret") -> DataFrame:
    """Year x horizon x regime x threshold x sample mode against the whole slice."""
    keys = ["test_year", "horizon", "regime"]
    details = kept_once(details, ["test_year", "horizon", *series, "trade_pos", ret, "label_threshold", "buy_proba",
                                  "evaluation_regime", "train_start", "train_end", "train_rows"])
    regimes = F.array_compact(F.array(
        F.lit("all"), F.when(c("evaluation_regime").isin("bull", "bear"), c("evaluation_regime"))))
    rows = details.withColumn("regime", F.explode(regimes))
    extra = [n for n in ("train_start", "train_end", "train_rows") if n in details.columns]
    correct, up = c(ret) > c("label_threshold"), c(ret) > 0
    universe = rows.groupBy(*keys).agg(
        F.max("label_threshold").alias("label_threshold"), *[F.max(n).alias(n) for n in extra],
        F.count(F.lit(1)).alias("regime_rows"), rate(correct).alias("natural_precision"),
        rate(up).alias("natural_actual_up_rate"), F.avg(ret).alias("natural_avg_strategy_ret"))
    marks = [float(t) for t in thresholds]
    signals = explode_values(rows, "threshold", marks).filter(c("buy_proba") >= c("threshold"))
    signals = signals.select(*keys, *series, "threshold", "trade_pos", ret, "label_threshold", "buy_proba")
    modes = _both_modes(signals, [*keys, *series, "threshold"], c("horizon"))
    ids = [*keys, "threshold", "sample_mode"]
    got = modes.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("signal_count"), rate(correct).alias("precision"),
        rate(up).alias("actual_up_rate"), F.avg(ret).alias("avg_strategy_ret"),
        F.avg("buy_proba").alias("avg_proba"))
    got = with_median(got, modes, ids, ret, "median_strategy_ret")
    grid = explode_values(explode_values(universe, "threshold", marks), "sample_mode",
                          [ALL_SIGNALS, INDEPENDENT])
    out = grid.join(got, ids, "left")
    count = F.coalesce(c("signal_count"), F.lit(0))
    return out.withColumns({
        "side": F.lit("buy"), "signal_count": count, "coverage": share(count, c("regime_rows")),
        "precision_lift": c("precision") - c("natural_precision"),
        "avg_strategy_ret_lift": c("avg_strategy_ret") - c("natural_avg_strategy_ret"),
    })


def aggregate_years(summary: DataFrame) -> DataFrame:
    """Pool yearly summary rows by weighting every rate with its own count."""
    keys = ["horizon", "regime", "side", "threshold", "label_threshold", "sample_mode"]
    signal = ["precision", "actual_up_rate", "avg_strategy_ret"]
    natural = ["natural_precision", "natural_actual_up_rate", "natural_avg_strategy_ret"]

    def pooled(name: str, weight: str) -> Column:
        total = F.coalesce(F.sum(c(name) * c(weight)), F.lit(0.0))
        return F.try_divide(total, F.sum(weight).cast("double"))

    out = summary.groupBy(*keys).agg(
        F.countDistinct("test_year").alias("evaluated_years"),
        F.sum("regime_rows").alias("regime_rows"), F.sum("signal_count").alias("signal_count"),
        F.try_divide(F.sum("signal_count").cast("double"), F.sum("regime_rows").cast("double")).alias("coverage"),
        *[pooled(n, "signal_count").alias(n) for n in signal],
        *[pooled(n, "regime_rows").alias(n) for n in natural])
    return out.withColumns({
        "precision_lift": c("precision") - c("natural_precision"),
        "avg_strategy_ret_lift": c("avg_strategy_ret") - c("natural_avg_strategy_ret"),
    })


def gate_comparison(details: DataFrame, thresholds: dict[int, float] | None = None,
                    series: Sequence[str] = ("index_code",), ret: str = "future_ret") -> DataFrame:
    """Gate x sample mode, per year and pooled; selection restarts every year."""
    thresholds = thresholds or {SIGNAL_HORIZON: 0.60}
    details = kept_once(details, ["test_year", "horizon", *series, "trade_pos", ret, "label_threshold", "buy_proba",
                                  "causal_regime"])
    base = F.create_map(*[F.lit(x) for h, t in thresholds.items() for x in (int(h), float(t))])
    rows = details.filter(c("horizon").isin(list(thresholds))).withColumn(
        "base_buy_threshold", base[c("horizon")])
    gates = [F.when(gate_passes(g, c("causal_regime"), c("buy_proba"), c("base_buy_threshold")), F.lit(g))
             for g in GATES]
    passed = rows.withColumn("gate", F.explode(F.array_compact(F.array(*gates)))).select(
        "test_year", "horizon", *series, "gate", "trade_pos", ret, "label_threshold", "buy_proba",
        "causal_regime")
    modes = pool_scopes(_both_modes(passed, ["test_year", "horizon", *series, "gate"], c("horizon")))
    ids = ["scope", "_year", "horizon"]
    universe = pool_scopes(rows.select("test_year", "horizon", "label_threshold", "base_buy_threshold")) \
        .groupBy(*ids).agg(F.max("label_threshold").alias("label_threshold"),
                           F.max("base_buy_threshold").alias("base_buy_threshold"),
                           F.count(F.lit(1)).alias("universe_rows"))
    full = [*ids, "gate", "sample_mode"]
    got = modes.groupBy(*full).agg(
        F.count(F.lit(1)).alias("signal_count"), rate(c(ret) > c("label_threshold")).alias("precision"),
        rate(c(ret) > 0).alias("actual_up_rate"), F.avg(ret).alias("avg_future_ret"),
        F.avg("buy_proba").alias("avg_buy_proba"),
        *[F.count_if(c("causal_regime") == r).alias(f"{r}_signal_count") for r in ("bull", "neutral", "bear")])
    got = with_median(got, modes, full, ret, "median_future_ret")
    grid = explode_values(explode_values(universe, "gate", GATES), "sample_mode", [ALL_SIGNALS, INDEPENDENT])
    out = grid.join(got, full, "left")
    counts = ["signal_count", "bull_signal_count", "neutral_signal_count", "bear_signal_count"]
    out = out.withColumns({n: F.coalesce(c(n), F.lit(0)) for n in counts})
    return out.withColumns({"coverage": share(c("signal_count"), c("universe_rows")),
                            "test_year": scope_year()}).drop("_year")


def _experiment(details: DataFrame, keys: list[str], marks: Column, mark: str, values: Sequence,
                series: Sequence[str], horizon: int, payload: list[str], aggs: list[Column],
                ret: str, median: str | None) -> DataFrame:
    """Hard-gated, non-overlapping signals per mark, by year and pooled.

    ``marks`` is the array of marks a row qualifies for (thresholds or buckets).
    """
    present = pool_scopes(details.select(*keys, "test_year")).groupBy(*keys, "scope", "_year").agg(
        F.count(F.lit(1)).alias("_n")).drop("_n")
    bull = details.filter(c("f_is_bull_trend") == 1).withColumn(mark, F.explode(marks)).select(
        *keys, "test_year", *series, mark, "trade_pos", *payload)
    chosen = pool_scopes(non_overlapping(bull, [*keys, "test_year", *series, mark], horizon))
    ids = [*keys, "scope", "_year", mark]
    got = chosen.groupBy(*ids).agg(F.count(F.lit(1)).alias("signal_count"), *aggs)
    if median:
        got = with_median(got, chosen, ids, ret, median)
    out = explode_values(present, mark, values).join(got, ids, "left")
    return out.withColumns({"signal_count": F.coalesce(c("signal_count"), F.lit(0)),
                            "test_year": scope_year()}).drop("_year")


def _reached(proba: Column, values: Sequence[float]) -> Column:
    return F.array_compact(F.array(*[F.when(proba >= v, F.lit(float(v))) for v in values]))


def label_threshold_comparison(details: DataFrame, probability_thresholds: Sequence[float] = (0.5, 0.6, 0.7, 0.8),
                               series: Sequence[str] = ("index_code",), horizon: int = SIGNAL_HORIZON,
                               ret: str = "future_ret") -> DataFrame:
    """Signals of models trained on different label thresholds."""
    values = [float(v) for v in probability_thresholds]
    return _experiment(
        details, ["label_threshold"], _reached(c("buy_proba"), values), "probability_threshold", values,
        series, horizon, [ret, "buy_proba"], _label_aggs(ret), ret, "median_future_ret")


def _label_aggs(ret: str) -> list[Column]:
    return [rate(c(ret) > c("label_threshold")).alias("label_precision"),
            rate(c(ret) > 0).alias("actual_up_rate"), F.avg(ret).alias("avg_future_ret"),
            F.avg("buy_proba").alias("avg_buy_proba")]


def label_threshold_buckets(details: DataFrame, series: Sequence[str] = ("index_code",),
                            horizon: int = SIGNAL_HORIZON, ret: str = "future_ret") -> DataFrame:
    """The same comparison per probability bucket."""
    bucket = F.array_compact(F.array(probability_bucket(c("buy_proba"))))
    return _experiment(details, ["label_threshold"], bucket, "probability_bucket", BUCKET_NAMES, series,
                       horizon, [ret, "buy_proba"], _label_aggs(ret), ret, "median_future_ret")


def calibration_quality(details: DataFrame, method: str = "calibration_method",
                        proba: str = "buy_proba", label: str = "actual_label") -> DataFrame:
    """Predicted against actual rate and Brier score on bull rows, by year and pooled."""
    rows = pool_scopes(details.filter(c("f_is_bull_trend") == 1).select("test_year", method, proba, label))
    y = c(label).cast("double")
    out = rows.groupBy("scope", "_year", method).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(proba).alias("avg_predicted_probability"),
        F.avg(y).alias("actual_target_rate"), F.avg((c(proba) - y) * (c(proba) - y)).alias("brier_score"))
    return out.withColumns({
        "calibration_gap": c("avg_predicted_probability") - c("actual_target_rate"),
        "test_year": scope_year()}).drop("_year")


def calibration_signals(details: DataFrame, thresholds: Sequence[float] = (0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8),
                        series: Sequence[str] = ("index_code",), horizon: int = SIGNAL_HORIZON,
                        ret: str = "future_ret") -> DataFrame:
    values = [float(v) for v in thresholds]
    aggs = [F.avg(c("actual_label").cast("double")).alias("target_precision"),
            rate(c(ret) > 0).alias("actual_up_rate"), F.avg(ret).alias("avg_future_ret"),
            F.avg("buy_proba").alias("avg_buy_proba")]
    return _experiment(details, ["calibration_method"], _reached(c("buy_proba"), values),
                       "probability_threshold", values, series, horizon,
                       [ret, "buy_proba", "actual_label"], aggs, ret, "median_future_ret")


def calibration_buckets(details: DataFrame, series: Sequence[str] = ("index_code",),
                        horizon: int = SIGNAL_HORIZON, ret: str = "future_ret") -> DataFrame:
    aggs = [F.avg("buy_proba").alias("avg_predicted_probability"),
            F.avg(c("actual_label").cast("double")).alias("target_precision"),
            rate(c(ret) > 0).alias("actual_up_rate"), F.avg(ret).alias("avg_future_ret")]
    bucket = F.array_compact(F.array(probability_bucket(c("buy_proba"))))
    return _experiment(details, ["calibration_method"], bucket, "probability_bucket", BUCKET_NAMES,
                       series, horizon, [ret, "buy_proba", "actual_label"], aggs, ret, None)


def ablation_metrics(details: DataFrame, label_threshold: float, probability_threshold: float = 0.60,
                     series: Sequence[str] = ("index_code",), horizon: int = SIGNAL_HORIZON,
                     ret: str = "future_ret") -> DataFrame:
    """Hard-gated, non-overlapping signals per feature-set variant against the bull rows."""
    bull = details.filter(c("f_is_bull_trend") == 1)
    correct, up = c(ret) > label_threshold, c(ret) > 0
    ids = ["variant", "scope", "_year"]
    every = pool_scopes(details.select("variant", "test_year", "feature_count", "f_is_bull_trend", ret))
    in_bull = c("f_is_bull_trend") == 1
    universe = every.groupBy(*ids).agg(
        F.max("feature_count").alias("feature_count"), F.count_if(in_bull).alias("universe_rows"),
        F.avg(F.when(in_bull, holds(correct).cast("double"))).alias("natural_precision"),
        F.avg(F.when(in_bull, holds(up).cast("double"))).alias("natural_actual_up_rate"),
        F.avg(F.when(in_bull, c(ret))).alias("natural_avg_future_ret"))
    signals = bull.filter(c("buy_proba") >= probability_threshold).select(
        "variant", "test_year", *series, "trade_pos", ret, "buy_proba")
    chosen = pool_scopes(non_overlapping(signals, ["variant", "test_year", *series], horizon))
    got = chosen.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("signal_count"), rate(correct).alias("precision"),
        rate(up).alias("actual_up_rate"), F.avg(ret).alias("avg_future_ret"),
        F.avg("buy_proba").alias("avg_buy_proba"))
    got = with_median(got, chosen, ids, ret, "median_future_ret")
    count = F.coalesce(c("signal_count"), F.lit(0))
    return universe.join(got, ids, "left").withColumns({
        "label_threshold": F.lit(float(label_threshold)),
        "probability_threshold": F.lit(float(probability_threshold)),
        "signal_count": count, "coverage": share(count, c("universe_rows")),
        "test_year": scope_year()}).drop("_year")


# --- model metrics --------------------------------------------------------------------------

def class_metrics(rows: DataFrame, label: str = "label", predicted: str = "pred_label",
                  keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, support and predicted count per class."""
    keys = keys or []
    confusion = rows.groupBy(*keys, label, predicted).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(c(label).alias("class"), c("_n").alias("_support"), F.lit(0).cast("long").alias("_pred"),
                 F.lit(0).cast("long").alias("_right")),
        F.struct(c(predicted).alias("class"), F.lit(0).cast("long").alias("_support"), c("_n").alias("_pred"),
                 F.when(c(label) == c(predicted), c("_n")).otherwise(0).cast("long").alias("_right")))
    out = confusion.select(*keys, F.inline(sides)).filter(c("class").isNotNull()).groupBy(*keys, "class").agg(
        F.sum("_support").alias("support"), F.sum("_pred").alias("pred_count"), F.sum("_right").alias("_right"))
    out = out.withColumns({"precision": share(c("_right"), c("pred_count")),
                           "recall": share(c("_right"), c("support"))})
    f1 = share(2 * c("precision") * c("recall"), c("precision") + c("recall"))
    return out.withColumn("f1", f1).drop("_right")


def class_summary(rows: DataFrame, label: str = "label", predicted: str = "pred_label",
                  ret: str = "future_ret", pred_ret: str = "pred_ret",
                  keys: list[str] | None = None) -> DataFrame:
    """Accuracy and mean absolute return error."""
    return rows.groupBy(*(keys or [])).agg(
        rate(c(label) == c(predicted)).alias("accuracy"),
        F.avg(F.abs(c(ret) - c(pred_ret))).alias("mae"))


def regression_metrics(rows: DataFrame, keys: list[str] | None = None, ret: str = "future_ret",
                       pred_ret: str = "pred_ret", label: str = "label", predicted: str = "pred_label",
                       confidence: str = "confidence", high: float = 0.6) -> DataFrame:
    """Error, information coefficient and its rank form, high-confidence accuracy."""
    keys = keys or []
    df = rows.withColumn("_all", F.lit(1))
    ids = [*keys, "_all"]
    # both rank tables come from the rows themselves; AQE splits hot values in the joins
    ranks = [average_ranks(df, ids, ret, "_rr"), average_ranks(df, ids, pred_ret, "_rp")]
    df = df.join(ranks[0], [*ids, ret], "left").join(ranks[1], [*ids, pred_ret], "left")
    err = c(ret) - c(pred_ret)
    sure = c(confidence) >= high
    return df.groupBy(*ids).agg(
        rate(c(label) == c(predicted)).alias("accuracy"), F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.corr(pred_ret, ret).alias("ic"),
        F.corr("_rp", "_rr").alias("rank_ic"), F.count_if(holds(sure)).alias("high_confidence_count"),
        F.avg(F.when(sure, holds(c(label) == c(predicted)).cast("double"))).alias("high_confidence_accuracy"),
    ).drop("_all")


def feature_inventory(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Known and non-zero rows of every feature, one wide aggregate turned long."""
    names = sorted({n for ns in groups.values() for n in ns})
    counts = df.agg(*[F.count(n).alias(f"n_{n}") for n in names],
                    *[F.count_if(c(n) != 0).alias(f"z_{n}") for n in names])
    items = [F.struct(F.lit(g).alias("group"), F.lit(n).alias("feature"),
                      c(f"n_{n}").alias("non_null_rows"), c(f"z_{n}").alias("non_zero_rows"))
             for g, ns in groups.items() for n in ns]
    return counts.select(F.inline(F.array(*items)))
