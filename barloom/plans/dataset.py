"""Model dataset: features, event and sentiment columns, forward returns, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.labels import buy_label, direction_label, short_label
from barloom.operators.frames import Series, ratio, stage
from barloom.plans.events import attach_daily, daily_event_features, roll_events
from barloom.plans.sentiment import daily_sentiment
from barloom.schemas import (BUY_LABEL_THRESHOLDS, FORUM_FEATURES, HORIZONS, MARKET_FEATURES,
                             SHORT_LABEL_THRESHOLDS, SIGNAL_HORIZON, event_features,
                             feature_manifest, rolled_event_features)

c = F.col
KEYS = ["trade_date", "index_code"]


def forward_returns(df: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """Return over the next h rows of each instrument; the last h rows stay NULL."""
    s = Series("index_code", "trade_date")
    return stage(df, {f"future_ret_{h}d": ratio(s.lead("close", h), "close") + " - 1"
                      for h in horizons or HORIZONS})


def with_labels(df: DataFrame, horizons: list[int] | None = None,
                buy: dict[int, float] | None = None, short: dict[int, float] | None = None,
                multiplier: float = 0.4) -> DataFrame:
    """Three-class and binary labels for forward returns already present."""
    buy = {SIGNAL_HORIZON: BUY_LABEL_THRESHOLDS[SIGNAL_HORIZON]} if buy is None else buy
    short = {SIGNAL_HORIZON: SHORT_LABEL_THRESHOLDS[SIGNAL_HORIZON]} if short is None else short
    return df.withColumns({
        **{f"label_{h}d": direction_label(c(f"future_ret_{h}d"), c("volatility_20d"), h, multiplier)
           for h in horizons or HORIZONS},
        **{f"buy_label_{h}d": buy_label(c(f"future_ret_{h}d"), t) for h, t in buy.items()},
        **{f"short_label_{h}d": short_label(c(f"future_ret_{h}d"), t) for h, t in short.items()},
    })


def dataset_features(use_forum: bool = False) -> list[str]:
    names = MARKET_FEATURES + event_features() + rolled_event_features()
    return names + (FORUM_FEATURES if use_forum else [])


def model_dataset(features: DataFrame, bars: DataFrame, events: DataFrame | None, news: DataFrame | None,
                  sentiment: DataFrame | None = None, index_code: str | None = None,
                  horizons: list[int] | None = None, buy: dict[int, float] | None = None,
                  short: dict[int, float] | None = None) -> DataFrame:
    """Keys, ``f_``-prefixed feature columns, forward returns and labels.

    Features that carry ``close`` are used as they are: every later window keeps their
    partitioning by instrument, so nothing wide is shuffled.  Stored features are joined
    with the bars first.  ``index_code`` restricts the panel to one instrument.  Without events every event
    column is 0.  Passing ``sentiment`` (the daily table per topic) adds its four columns.
    """
    if index_code is not None:
        # the filter reaches the scans of both sides
        features, bars = (d.filter(c("index_code") == index_code) for d in (features, bars))
    df = features
    if "close" not in df.columns:
        df = df.join(bars.select(*KEYS, c("close").cast("double").alias("close")), KEYS)
    if sentiment is not None:
        df = attach_daily(df, daily_sentiment(sentiment), FORUM_FEATURES, fill=None)
    if events is not None:
        df = attach_daily(df, daily_event_features(events, news), event_features())
    else:
        df = stage(df, {n: "0D" for n in event_features()})
    horizons = horizons or HORIZONS
    wanted = sorted({*horizons, *(buy or {SIGNAL_HORIZON: 0}), *(short or {SIGNAL_HORIZON: 0})})
    df = with_labels(roll_events(forward_returns(df, wanted)), horizons, buy, short)
    names = dataset_features(sentiment is not None)
    labels = [n for n in df.columns if n.startswith(("future_ret_", "label_", "buy_label_", "short_label_"))]
    # NaN and infinity never leave the windows: every division there is null-safe
    return df.selectExpr(*KEYS, *[f"double(`{n}`) AS `f_{n}`" for n in names], *labels)


def feature_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n.startswith("f_")]


def pack_features(df: DataFrame, name: str = "feature_json") -> DataFrame:
    """Replace the feature columns by one JSON document that keeps unknown values."""
    feats = feature_columns(df)
    doc = F.to_json(F.struct(*[c(n).alias(n[2:]) for n in feats]), {"ignoreNullFields": "false"})
    return df.select(*[n for n in df.columns if n not in feats], doc.alias(name))


def unpack_features(df: DataFrame, names: list[str], name: str = "feature_json") -> DataFrame:
    """Expand the JSON document to ``f_`` columns; an absent document gives NULLs."""
    schema = ", ".join(f"`{n}` double" for n in names)
    parsed = df.withColumn("_doc", F.from_json(c(name), schema))
    return parsed.select(*[n for n in df.columns if n != name],
                         *[c(f"_doc.{n}").alias(f"f_{n}") for n in names])


def select_manifest(df: DataFrame, manifest: list[str] | None = None) -> list[str]:
    """The frozen feature list, checked for duplicates and for missing columns."""
    names = feature_manifest() if manifest is None else manifest
    if not names or len(names) != len(set(names)):
        raise ValueError("feature manifest must be a non-empty list without duplicates")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"feature manifest columns are missing from the dataset: {missing}")
    return names


def usable_features(df: DataFrame, names: list[str]) -> list[str]:
    """Features with at least one value in the slice (one aggregate over all of them)."""
    counts = df.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if counts[n] > 0]


def without_forum(names: list[str]) -> list[str]:
    drop = {f"f_{n}" for n in FORUM_FEATURES}
    return [n for n in names if n not in drop]


def fill_missing_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Add absent feature columns as 0 before scoring."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})
