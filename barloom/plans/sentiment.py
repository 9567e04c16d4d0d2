"""Forum heat and sentiment per (date, topic)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.labels import emotion_stage
from barloom.functions.nulls import flag, to_number
from barloom.functions.text import lexicon_score
from barloom.operators.frames import Series, ratio, stage

c = F.col
KEYS = ["trade_date", "topic"]


def _scored(df: DataFrame, text: str, positive: list[str] | None, negative: list[str] | None) -> DataFrame:
    score = lexicon_score(c(text), positive, negative)
    return df.select("trade_date", c("bar_name").alias("topic"), score.alias("score"),
                     flag(score > 0).alias("pos"), flag(score < 0).alias("neg"))


def topic_activity(posts: DataFrame, comments: DataFrame, positive: list[str] | None = None,
                   negative: list[str] | None = None) -> DataFrame:
    """Counts, heat and sentiment per date and topic; comment-only days drop out.

    Distinct counts are planned by Spark in two levels (key and id, then key), so a
    topic holding most of the posts is spread over its ids.
    """
    post_side = posts.groupBy("trade_date", c("bar_name").alias("topic")).agg(
        F.countDistinct("post_id").alias("post_count"),
        F.sum(F.coalesce(to_number(c("comment_count")), F.lit(0.0))).alias("_declared"),
        F.sum(F.coalesce(to_number(c("read_count")), F.lit(0.0))).alias("read_count"))
    comment_side = comments.groupBy("trade_date", c("bar_name").alias("topic")).agg(
        F.countDistinct("comment_id").alias("_observed"))
    moods = _scored(posts, "title", positive, negative).unionByName(
        _scored(comments, "content", positive, negative)).groupBy(*KEYS).agg(
        F.avg("score").alias("sentiment_score"), F.avg("pos").alias("positive_ratio"),
        F.avg("neg").alias("negative_ratio"))
    joined = post_side.join(comment_side, KEYS, "left").join(moods, KEYS, "left")
    count = F.greatest(c("_declared"), F.coalesce(c("_observed"), F.lit(0)).cast("double"))
    return joined.withColumn("comment_count", count).withColumns({
        "heat_score": F.log1p("post_count") + 0.5 * F.log1p("comment_count") + 0.2 * F.log1p("read_count"),
        "disagreement": 1 - F.abs(c("positive_ratio") - c("negative_ratio")),
    }).drop("_declared", "_observed")


def sentiment_features(posts: DataFrame, comments: DataFrame, source: str = "eastmoney_guba",
                       positive: list[str] | None = None,
                       negative: list[str] | None = None) -> DataFrame:
    """The daily sentiment table: activity, heat z-scores over rows present, stage."""
    s = Series("topic", "trade_date")
    df = stage(topic_activity(posts, comments, positive, negative), {
        **{f"heat_zscore_{n}d": ratio(f"heat_score - {s.mean('heat_score', n)}", s.std("heat_score", n))
           for n in (20, 60)},
        "heat_change_3d": s.change("heat_score", 3),
    }).withColumns({"source": F.lit(source), "top_keywords": F.lit("")})
    df = df.withColumn("emotion_stage",
                       emotion_stage(c("heat_zscore_20d"), c("heat_change_3d"), c("disagreement")))
    return df.select(
        *KEYS, "source", "post_count", "comment_count", "read_count", "heat_score",
        "heat_zscore_20d", "heat_zscore_60d", "heat_change_3d", "sentiment_score",
        "positive_ratio", "negative_ratio", "disagreement", "emotion_stage", "top_keywords")


def daily_sentiment(features: DataFrame) -> DataFrame:
    """Mean over topics of the four columns the dataset reads."""
    return features.groupBy("trade_date").agg(*[
        F.avg(n).alias(n) for n in ("heat_score", "heat_zscore_20d", "sentiment_score", "disagreement")])
