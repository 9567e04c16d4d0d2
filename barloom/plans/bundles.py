"""Saved model bundles scored on the test slice, joined with the metric tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import schemas as S
from barloom.functions.labels import evaluation_regime
from barloom.plans import evaluation as E
from barloom.plans.modeling import Bundle, labelled, time_split, with_class, with_probability, with_return
from barloom.session import cut_lineage

c = F.col
Pairs = dict[int, tuple[Bundle, Bundle]]


def scored_directions(dataset: DataFrame, models: Pairs, splits: dict | None = None) -> DataFrame:
    """Labelled test rows of every horizon with label, class probabilities and return of its two models."""
    parts = []
    for horizon, (classifier, regressor) in models.items():
        _, _, test = time_split(labelled(dataset, horizon, f"label_{horizon}d"), splits)
        rows = with_return(regressor.model, with_class(classifier.model, test, classifier.features), regressor.features)
        parts.append(rows.withColumns({"horizon": F.lit(horizon), "future_ret": c(f"future_ret_{horizon}d"),
                                       "label": c(f"label_{horizon}d")}))
    return cut_lineage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def evaluate_directions(scored: DataFrame, high: float = 0.6) -> DataFrame:
    """Accuracy, errors, information coefficients and high-confidence accuracy per horizon."""
    return E.regression_metrics(scored, keys=["horizon"], high=high)


def evaluate_up_signals(scored: DataFrame, thresholds: Sequence[float] = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6)) -> DataFrame:
    """Quality of the up class of each horizon, inferred from its rows, by rule and probability threshold."""
    return E.up_signal_metrics(scored, ["horizon"], thresholds)


def evaluate_long_short(scored: DataFrame, thresholds: Sequence[float] = (0.4, 0.45, 0.5, 0.55, 0.6)) -> DataFrame:
    """Quality of the positions that each horizon's long and short labels give."""
    return E.long_short_metrics(E.with_position(scored, keys=["horizon"]), ["horizon"], thresholds)


def scored_sides(dataset: DataFrame, buy: Bundle, short: Bundle, splits: dict | None = None,
                 regime_args: dict | None = None) -> DataFrame:
    """Test rows with the probabilities of a buy and a short bundle of one horizon, and their regime."""
    if buy.horizon != short.horizon:
        raise ValueError(f"bundles of horizons {buy.horizon} and {short.horizon} cannot be compared")
    h = buy.horizon
    _, _, test = time_split(dataset.na.drop(subset=[f"future_ret_{h}d"]), splits or S.DEFAULT_SPLITS)
    rows = with_probability(buy.model, test, buy.features, "buy_proba")
    rows = with_probability(short.model, rows, short.features, "short_proba")
    return cut_lineage(rows.withColumns({"future_ret": c(f"future_ret_{h}d"), "horizon": F.lit(h),
                                         "evaluation_regime": evaluation_regime(c("trade_date"), **(regime_args or {}))}))


def evaluate_sides(scored: DataFrame, splits: dict | None = None,
                   thresholds: Sequence[float] = (0.5, 0.55, 0.6)) -> tuple[DataFrame, DataFrame]:
    """(regime table, conflict table) of a buy and a short model on the same rows."""
    return E.regime_metrics(scored, splits, thresholds), E.conflict_metrics(scored, thresholds)
