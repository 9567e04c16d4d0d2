"""Labels, regimes, gates and scores as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.nulls import holds
from barloom.schemas import BEAR_PERIODS, DEFAULT_SPLITS, EVALUATION_START

# --- Fixed values: label texts, emotion stages, probability buckets, gate floors.
UP, DOWN, FLAT = "上涨", "下跌", "震荡"
COLD, CLIMAX, FERMENT, SPLIT, EBB, WARM = "冷启动", "高潮", "发酵", "分歧", "退潮", "预热"
BUCKET_EDGES = [0.0, 0.5, 0.6, 0.7, 0.8, 1.000001]
BUCKET_NAMES = ["<0.50", "0.50-0.60", "0.60-0.70", "0.70-0.80", ">=0.80"]
GATES = ["no_gate", "hard_gate", "soft_gate"]
SOFT_NEUTRAL_FLOOR, SOFT_BEAR_FLOOR = 0.75, 0.85
REGIME_NAMES = {"bull": "牛市", "bear": "熊市", "neutral": "中性"}
DIRECTION_NAMES = {"long": "做多", "neutral": "观望"}
PENDING, NOT_LONG, HIT, SHORT_OF_TARGET, MISS = (
    "等待验证", "非Long信号", "达到目标", "上涨但未达0.5%", "未命中")


def lit_date(value: str) -> Column:
    return F.lit(str(value)).cast("date")


def display_name(value: Column, names: dict[str, str]) -> Column:
    """Display text of a category; unknown categories keep their own text."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def direction_label(ret: Column, volatility: Column, horizon: int, multiplier: float = 0.4,
                    fallback: float = 0.008) -> Column:
    """Three-class label against a band that widens with volatility and horizon."""
    known = volatility.isNotNull() & (volatility != 0)
    band = F.when(known, multiplier * volatility * math.sqrt(horizon)).otherwise(F.lit(fallback))
    return F.when(ret.isNull(), F.lit(None)).when(ret > band, UP).when(ret < -band, DOWN).otherwise(FLAT)


def buy_label(ret: Column, threshold: float) -> Column:
    return (ret > threshold).cast("int")


def short_label(ret: Column, threshold: float) -> Column:
    return (ret < -threshold).cast("int")


def emotion_stage(zscore: Column, change: Column, disagreement: Column) -> Column:
    """Heat stage of a topic; the first rule that holds decides."""
    return (F.when(zscore.isNull(), COLD)
            .when((zscore > 2) & (change > 0), CLIMAX)
            .when(zscore > 1, FERMENT)
            .when((disagreement > 0.45) & (zscore > 0.8), SPLIT)
            .when(change < -0.2, EBB)
            .when(zscore > 0, WARM)
            .otherwise(COLD))


def evaluation_regime(day: Column, start: str = EVALUATION_START,
                      bear_periods: list[tuple[str, str]] | None = None) -> Column:
    """Research regime by configured periods (known only afterwards)."""
    periods = BEAR_PERIODS if bear_periods is None else bear_periods
    bear = reduce(lambda a, b: a | b,
                  [day.between(lit_date(s), lit_date(e)) for s, e in periods], F.lit(False))
    return F.when(bear, "bear").when(day >= lit_date(start), "bull").otherwise("outside")


def causal_regime(is_bull: Column, is_bear: Column) -> Column:
    """Regime known on the day itself; bear wins when both flags are set."""
    return F.when(holds(is_bear == 1), "bear").when(holds(is_bull == 1), "bull").otherwise("neutral")


def sample_scope(day: Column, splits: dict | None = None) -> Column:
    """train/valid/test/outside; a later split wins where intervals overlap."""
    s = splits or DEFAULT_SPLITS
    return (F.when(day >= lit_date(s["test_start"]), "test")
            .when(day.between(lit_date(s["valid_start"]), lit_date(s["valid_end"])), "valid")
            .when(day.between(lit_date(s["train_start"]), lit_date(s["train_end"])), "train")
            .otherwise("outside"))


def gate_passes(gate: str, regime: Column, proba: Column, base: Column) -> Column:
    """Whether a row passes a probability gate given the causal regime."""
    if gate == "no_gate":
        return proba >= base
    if gate == "hard_gate":
        return (regime == "bull") & (proba >= base)
    if gate == "soft_gate":
        floor = (F.when(regime == "bull", base)
                 .when(regime == "bear", F.greatest(base, F.lit(SOFT_BEAR_FLOOR)))
                 .otherwise(F.greatest(base, F.lit(SOFT_NEUTRAL_FLOOR))))
        return proba >= floor
    raise ValueError(f"Unknown gate: {gate}")


def signal_direction(regime: Column, proba: Column, threshold: Column) -> Column:
    return F.when(holds((regime == "bull") & (proba >= threshold)), "long").otherwise("neutral")


def probability_bucket(proba: Column) -> Column:
    """Left-closed probability bucket; NULL outside [0, 1]."""
    out = F.when(proba < BUCKET_EDGES[0], F.lit(None))
    for edge, name in zip(BUCKET_EDGES[1:], BUCKET_NAMES):
        out = out.when(proba < edge, name)
    return out


def logit(proba: Column, clip: float = 1e-6) -> Column:
    p = F.least(F.greatest(proba, F.lit(clip)), F.lit(1 - clip))
    return F.when(proba.isNotNull(), F.log(p / (1 - p)))


def return_band(pred: Column) -> tuple[Column, Column]:
    """Lower and upper end of the band drawn around a predicted return."""
    width = F.greatest(F.abs(pred) * 0.5, F.lit(0.005))
    return pred - width, pred + width


def mean_of_known(*values: Column) -> Column:
    """Mean over the non-null inputs, NULL when none is known."""
    known = F.array_compact(F.array(*values))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(known))


def percent_text(value: Column, digits: int = 2, unknown: str = PENDING) -> Column:
    return F.when(value.isNull(), unknown).otherwise(F.format_string(f"%.{digits}f%%", value * 100))


def outcome_text(direction: Column, ret: Column, target: float = 0.005) -> Column:
    return (F.when(ret.isNull(), PENDING).when(direction != "long", NOT_LONG)
            .when(ret > target, HIT).when(ret > 0, SHORT_OF_TARGET).otherwise(MISS))


def explanation_text(horizon: Column, label: Column, pred: Column, confidence: Column, tech: Column,
                     sentiment: Column, event: Column, similar: Column) -> Column:
    """One-sentence account of a prediction."""
    return F.concat(
        F.format_string("模型预测%d日方向为%s，预测涨跌幅%.2f%%，置信度%.1f%%。", horizon, label,
                        pred * 100, confidence * 100),
        F.format_string("技术得分%.4f，舆情得分%.4f，事件得分%.4f。", tech, sentiment, event), similar)

