"""Report tables: signal dashboard, prediction report and data-quality status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.labels import (DIRECTION_NAMES, REGIME_NAMES, display_name, outcome_text,
                                      percent_text)
from barloom.operators.selection import assert_unique
from barloom.operators.similar import similar_dates

c = F.col


# --- signals --------------------------------------------------------------------------------

def newest(signals: DataFrame, limit: int, model_version: str | None) -> DataFrame:
    """Newest signals, of one model version if named; a date's rows by version and horizon."""
    if model_version is not None:
        signals = signals.filter(c("model_version") == model_version)
    ties = [c(n).asc() for n in ("model_version", "horizon") if n in signals.columns]
    return signals.orderBy(c("trade_date").desc(), *ties).limit(limit)


def latest_signal(signals: DataFrame, model_version: str | None = None) -> DataFrame:
    """Card of the newest signal."""
    return newest(signals, 1, model_version).select(
        c("trade_date").cast("string").alias("trade_date"), "horizon", "direction",
        display_name(c("direction"), DIRECTION_NAMES).alias("direction_text"),
        display_name(c("causal_regime"), REGIME_NAMES).alias("regime_text"),
        F.format_string("%.4f", c("buy_proba").cast("double")).alias("buy_proba"),
        F.format_string("%.2f", c("buy_threshold").cast("double")).alias("buy_threshold"))


def recent_signals(signals: DataFrame, limit: int = 30, model_version: str | None = None) -> DataFrame:
    """Newest signals with display texts and outcome."""
    ret = c("future_ret_7d").cast("double")
    known = c("causal_regime").isin(list(REGIME_NAMES))
    return newest(signals, limit, model_version).select(
        c("trade_date").cast("string").alias("trade_date"),
        display_name(c("causal_regime"), REGIME_NAMES).alias("regime_text"),
        F.when(known, c("causal_regime")).otherwise("neutral-regime").alias("regime_class"),
        F.format_string("%.4f", c("buy_proba").cast("double")).alias("buy_proba"),
        F.format_string("%.2f", c("buy_threshold").cast("double")).alias("buy_threshold"),
        "direction", display_name(c("direction"), DIRECTION_NAMES).alias("direction_text"),
        percent_text(ret).alias("future_ret_7d"), outcome_text(c("direction"), ret).alias("outcome"))


def realized_metrics(signals: DataFrame, target: float = 0.005) -> DataFrame:
    """Count, precision and mean return of long signals whose return is known."""
    ret = c("future_ret_7d").cast("double")
    done = signals.filter((c("direction") == "long") & c("future_ret_7d").isNotNull())
    out = done.agg(F.count(F.lit(1)).alias("realized_long_count"),
                   F.avg((ret > target).cast("double")).alias("precision"),
                   F.avg(ret).alias("avg_future_ret"))
    return out.withColumns({"precision_text": percent_text(c("precision")),
                            "avg_future_ret_text": percent_text(c("avg_future_ret"))})


def price_overlay(bars: DataFrame, signals: DataFrame, code: str) -> DataFrame:
    """Closes of the signal period with the signal of the day, if any; pass the signals of one version and horizon."""
    span = signals.agg(F.struct(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))).scalar()
    closes = bars.filter(c("index_code") == code).withColumn("_span", span) \
        .filter(c("trade_date").between(c("_span.a"), c("_span.b")))
    marks = signals.select("trade_date", "direction", "buy_proba")
    return closes.select("trade_date", c("close").cast("double").alias("close")).join(
        assert_unique(marks, ["trade_date"]), "trade_date", "left")


# --- predictions ----------------------------------------------------------------------------

def prediction_report(predictions: DataFrame, day: str | None = None) -> DataFrame:
    """Predictions of one date, by default the latest."""
    wanted = F.lit(day).cast("date") if day else predictions.agg(F.max("trade_date")).scalar()
    return predictions.filter(c("trade_date") == wanted).orderBy("horizon")


def prediction_similar_days(dataset: DataFrame, day: str, features: list[str], code: str | None = None) -> DataFrame:
    """The ten dates of an instrument most like the predicted one."""
    return similar_dates(dataset, day, features, 10, code)


# --- data quality ---------------------------------------------------------------------------

def _off_board(code: str) -> Column:
    return ~c("url").like(f"%/news,{code},%")


def forum_status(posts: DataFrame, board: str, code: str) -> DataFrame:
    """Coverage and cleanliness of one board.

    URLs that occur more than once are counted in their own two-step aggregate.
    """
    mine = posts.filter(c("bar_name") == board)
    repeated = mine.groupBy("url").count().filter("count > 1").agg(F.count(F.lit(1))).scalar()
    out = mine.agg(
        F.count(F.lit(1)).alias("cnt"), F.min("publish_time").alias("min_time"),
        F.max("publish_time").alias("max_time"), F.countDistinct("trade_date").alias("trade_days"),
        F.sum(F.when(_off_board(code), 1).otherwise(0)).alias("dirty"))
    return out.withColumn("duplicate_url_count", F.coalesce(repeated, F.lit(0)))


def edge_days(rows: DataFrame, n: int = 15, newest: bool = True) -> DataFrame:
    """Row counts of the newest or oldest n days."""
    order = c("trade_date").desc_nulls_last() if newest else c("trade_date").asc_nulls_first()
    return rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias("cnt")).orderBy(order).limit(n)


def comment_status(comments: DataFrame, board: str) -> DataFrame:
    return comments.filter(c("bar_name") == board).agg(
        F.count(F.lit(1)).alias("comment_cnt"), F.countDistinct("post_id").alias("commented_posts"),
        F.min("publish_time").alias("min_time"), F.max("publish_time").alias("max_time"),
        F.countDistinct("trade_date").alias("trade_days"))


def news_status(news: DataFrame, source: str | None = None) -> DataFrame:
    rows = news.filter(c("source") == source) if source else news
    return rows.agg(F.count(F.lit(1)).alias("cnt"), F.min("publish_time").alias("min_time"),
                    F.max("publish_time").alias("max_time"), F.countDistinct("trade_date").alias("trade_days"))


def news_by_source(news: DataFrame) -> DataFrame:
    return news.groupBy("source").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("publish_time").alias("min_time"),
        F.max("publish_time").alias("max_time")).orderBy(c("cnt").desc())


def latest_news(news: DataFrame, n: int = 15, tie: str = "news_id") -> DataFrame:
    return news.orderBy(c("publish_time").desc(), c(tie).asc()).limit(n)


def cleanup_audit(posts: DataFrame, board: str, code: str) -> DataFrame:
    """State of a board after the clean-up."""
    return posts.filter(c("bar_name") == board).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("publish_time").alias("min_time"),
        F.max("publish_time").alias("max_time"),
        F.sum(F.when(_off_board(code), 1).otherwise(0)).alias("dirty"))

