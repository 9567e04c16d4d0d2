"""Model fits on the derived dataset: full protocol with few trees, rows-only checks.

Boosting is a chain of small jobs per tree and fold, so the walk-forward, label-sweep, calibration and ablation fits
cover the last years, the first three with a feature of every group; the subgroup ablation runs every variant in every
year, and the single fits use the whole manifest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import schemas as S
from barloom.operators.similar import similar_by_date
from barloom.plans import dataset as D
from barloom.plans import evaluation as E
from barloom.plans import modeling as M
from barloom.plans.market import market_features
from barloom.session import cut_lineage
from checks import fixtures as fx

c = F.col
SMALL = M.TreeSettings(trees=4, depth=3, step=0.3)
REGIME = {"start": fx.EVAL_START, "bear_periods": fx.BEAR}
YEARS = [2000, 2001]
#: every year of the bars; one without enough training rows is skipped and logged
ALL_YEARS = list(range(1995, 2003))
#: every group is represented; the full manifest is a library call
FEATURES = ["f_ret_1d", "f_ret_5d", "f_ma5_gap", "f_ma20_gap", "f_macd_hist", "f_rsi14", "f_kdj_k", "f_kdj_d", "f_volatility_20d",
            "f_atr14", "f_body_ratio", "f_regime_trend_score", "f_is_bull_trend", "f_is_bear_trend", "f_relative_hs300",
            "f_event_score", "f_event_count", "f_event_score_roll_5d"]


def dataset(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    feats = market_features(bars, fx.TARGET, fx.BENCHMARKS, storage_scale=6, keep_close=True)
    return D.model_dataset(feats, bars, fx.raw_events(spark, sf_dir), fx.news(spark, sf_dir))


def fit_buy(spark, sf_dir):
    _, scored = M.train_binary(dataset(spark, sf_dir), "buy", splits=fx.SPLITS, trees=SMALL)
    return E.binary_rule_metrics(cut_lineage(scored), "buy", keys=["split"])


def fit_short(spark, sf_dir):
    _, scored = M.train_binary(dataset(spark, sf_dir), "short", splits=fx.SPLITS, trees=SMALL)
    return E.binary_rule_metrics(cut_lineage(scored), "short", keys=["split"])


def fit_direction(spark, sf_dir):
    """Three-class and return models: class metrics and error metrics."""
    _, _, scored = M.train_direction(dataset(spark, sf_dir), 5, fx.SPLITS, trees=SMALL)
    scored = cut_lineage(scored)
    return E.class_metrics(scored, keys=["split"]).join(E.regression_metrics(scored, keys=["split"]), "split")


def walk_forward_fit(spark, sf_dir):
    details = M.walk_forward(dataset(spark, sf_dir), YEARS, train_start="1995-01-01", features=FEATURES,
                             trees=SMALL, regime_args=REGIME)
    return E.walk_forward_summary(cut_lineage(details))


def label_sweep(spark, sf_dir):
    details = M.label_threshold_sweep(dataset(spark, sf_dir), [2001], train_start="1995-01-01", features=FEATURES,
                                      trees=SMALL, regime_args=REGIME)
    return E.label_threshold_comparison(cut_lineage(details))


def calibrate(spark, sf_dir):
    details = M.calibration_walk_forward(dataset(spark, sf_dir), [2001], train_start="1995-01-01", features=FEATURES,
                                         trees=SMALL, regime_args=REGIME)
    return E.calibration_quality(cut_lineage(details))


def ablation(spark, sf_dir):
    data = dataset(spark, sf_dir)
    variants = M.ablation_variants(D.feature_columns(data))
    details = M.feature_set_walk_forward(data, variants, [2001], "1995-01-01", SMALL, regime_args=REGIME)
    return E.ablation_metrics(cut_lineage(details), 0.005, 0.5)


def subgroup_ablation(spark, sf_dir):
    data = dataset(spark, sf_dir)
    variants = M.subgroup_variants(D.feature_columns(data))
    details = M.feature_set_walk_forward(data, variants, ALL_YEARS, "1995-01-01", SMALL, regime_args=REGIME)
    return E.ablation_metrics(cut_lineage(details), 0.005, 0.5)


def predict_multi_horizon(spark, sf_dir):
    """Predictions of the days of June 2001, each with its own similar days."""
    data = cut_lineage(dataset(spark, sf_dir).filter(c("index_code") == fx.TARGET))
    models = {}
    for h in S.HORIZONS:
        cls, reg, _ = M.train_direction(data, h, fx.SPLITS, trees=SMALL)
        models[h] = (cls, reg)
    rows = M.select_rows(data, start="2001-06-01", end="2001-06-15")
    days = [str(r[0]) for r in rows.select("trade_date").orderBy("trade_date").collect()]
    near = similar_by_date(data, days, ["f_ret_1d", "f_ret_5d", "f_ma20_gap", "f_volatility_20d"], code=fx.TARGET)
    return M.predict_horizons(rows, models, near)


def generate_signals(spark, sf_dir):
    data = cut_lineage(dataset(spark, sf_dir).filter(c("index_code") == fx.TARGET))
    bundle = M.train_final(data, trees=SMALL)
    return M.refresh_realized(M.buy_signals(data, bundle), data, fx.TARGET)


QUERIES = {f.__name__: f for f in (
    fit_buy, fit_short, fit_direction, walk_forward_fit, label_sweep, calibrate, ablation,
    subgroup_ablation, predict_multi_horizon, generate_signals)}
ORACLES: dict[str, str] = {}
