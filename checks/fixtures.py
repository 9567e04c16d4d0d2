"""Bars, posts, news and events derived from the given tables (Spark side).

Each view has a DuckDB twin in :mod:`checks.oracle_views`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.labels import causal_regime, evaluation_regime
from barloom.operators.frames import Series
from barloom.session import checkpoint_dir

TARGET = "1"
BENCHMARKS = {"relative_hs300": "2", "relative_zz500": "3", "relative_cyb": "5"}
GROUPS = {"index_style": ["tion"], "liquidity": ["sch"], "policy_market": ["the"],
          "growth_industry": ["eau"], "macro": ["ción"]}
POSITIVE, NEGATIVE = ["the", "que", "und"], ["tion", "sch", "eau"]
SPLITS = {"train_start": "1995-01-01", "train_end": "1998-12-31", "valid_start": "1999-01-01",
          "valid_end": "1999-12-31", "test_start": "2000-01-01"}
EVAL_START = "1998-01-01"
BEAR = [("1999-07-01", "2000-06-30")]
c = F.col


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from line items: partial aggregation first, one row per (date, code)."""
    li = table(spark, sf_dir, "lineitem")
    price = F.round(1000 + c("l_extendedprice") / 1000, 5)
    # one fixed-width ordering number, so that the aggregate stays hash based
    order = (c("l_orderkey").cast("decimal(18,0)") * F.lit(10 ** 15).cast("decimal(16,0)")
             + c("l_partkey") * 100000 + c("l_suppkey"))
    rows = li.select(c("l_shipdate").cast("date").alias("trade_date"),
                     c("l_linenumber").cast("string").alias("index_code"),
                     price.alias("p"), order.alias("k"),
                     "l_quantity", "l_extendedprice")
    return rows.groupBy("trade_date", "index_code").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"))


def late_series(rows: DataFrame) -> DataFrame:
    """The rows and a series that trades on the last days of each year only, so its slices are short and begin late."""
    late = rows.filter((c("index_code") == TARGET) & (F.dayofyear("trade_date") > 356))
    return rows.unionByName(late.withColumn("index_code", F.lit("late")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event; its title is the text of the document at event_id mod n."""
    ev = table(spark, sf_dir, "events")
    docs = table(spark, sf_dir, "documents").select("doc_id", c("text").alias("title"))
    board = F.when(c("event_id") % 13 == 0, F.lit("other")).otherwise(c("event_type"))
    return ev.withColumn("doc_id", c("event_id") % docs.agg(F.count(F.lit(1))).scalar()) \
        .join(docs, "doc_id", "left").select(
        c("event_id").cast("string").alias("post_id"),
        c("event_type").alias("bar_name"),
        c("ts").cast("timestamp_ntz").alias("publish_time"),
        c("ts").cast("date").alias("trade_date"), "title",
        F.floor("value").cast("int").alias("read_count"),
        F.when(c("event_id") % 11 != 0, c("event_id") % 7).cast("int").alias("comment_count"),
        F.lit(None).cast("int").alias("like_count"),
        c("user_id").cast("string").alias("author"),
        F.concat(F.lit("https://x/news,"), board, F.lit(","), c("event_id").cast("string"),
                 F.lit(".html")).alias("url"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with anchors of every kind added: bare, apostrophe, entity, capital and quoted tag ends, no target; every
    hundredth page also holds an anchor with 200,000 characters of attributes and one that never ends."""
    number = c("page_id").cast("string")
    more = F.concat(
        F.lit("<p><a class=t href=/bare/"), number, F.lit(">Bare tion link</a> <a href=\"/it's/"), number,
        F.lit("\">Apostrophe the link</a> <A TITLE='x > y' HREF='?a="), number,
        F.lit("&amp;b=2'>Entity <b>sch</b> &amp; link</A> <a name=x>no target</a> <a title=it's href=/own/"),
        number, F.lit(">Own tion apostrophe</a></p>"))
    long = F.when(c("page_id") % 100 == 0, F.concat(
        F.lit("<a "), F.repeat(F.lit("b "), 100_000), F.lit("href=/long>The long tion link</a> <a "), F.repeat(F.lit("open "), 1000)))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", more, F.coalesce(long, F.lit(""))))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    ev = table(spark, sf_dir, "events").select(
        c("event_id").alias("conv_id"), c("event_type").alias("bar_name"),
        c("ts").cast("date").alias("trade_date"), c("ts").cast("timestamp_ntz").alias("publish_time"))
    return conv.join(ev, "conv_id").select(
        F.concat_ws(":", c("conv_id").cast("string"), c("turn").cast("string")).alias("comment_id"),
        c("conv_id").cast("string").alias("post_id"), "bar_name", "publish_time", "trade_date",
        c("role").alias("author"), c("text").alias("content"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.text import matched_groups, matched_keywords
    docs = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("1995-01-03").cast("date"), ((c("doc_id") * 7) % 2400).cast("int"))
    return docs.select(
        F.sha1(F.concat_ws("|", "source", c("doc_id").cast("string"))).alias("news_id"), "doc_id",
        "source", day.alias("trade_date"), day.cast("timestamp_ntz").alias("publish_time"),
        F.substring("text", 1, 500).alias("title"), c("text").alias("content"),
        F.to_json(matched_keywords(c("text"), GROUPS)).alias("matched_keywords"),
        F.to_json(matched_groups(c("text"), GROUPS)).alias("matched_groups"))


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


EXPECTATIONS = ["预期不足", "中性", "预期充分", "极度过热", "unknown"]
STAGES = ["传闻", "发酵", "确认", "落地", "兑现", "unknown"]
SURPRISES = ["超预期", "符合预期", "不及预期", "尚未落地"]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored event attributes of every labelled document; the others have no event yet."""
    from barloom.functions.text import event_score
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    joined = news(spark, sf_dir).join(docs, "doc_id").join(labels, "doc_id")
    direction = F.when(c("toxic") == 1, "利空").when(c("quality") == 1, "利多").otherwise("中性")
    out = joined.select(
        "doc_id", "trade_date", F.substring("title", 1, 200).alias("event_name"),
        _pick(STAGES, c("doc_id") % 6).alias("event_stage"),
        _pick(EXPECTATIONS, c("doc_id") % 5).alias("expectation_level"),
        _pick(SURPRISES, c("doc_id") % 4).alias("surprise_level"),
        direction.alias("impact_direction"), (c("n_chars") % 7).cast("int").alias("impact_strength"),
        c("news_id").alias("source_ids"), "matched_groups")
    return out.withColumn("event_score", event_score(
        c("impact_direction"), c("impact_strength"), c("expectation_level"), c("event_stage"),
        c("surprise_level")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed model answers in three wrappings; every 17th one is broken."""
    ev = raw_events(spark, sf_dir)
    body = F.to_json(F.struct("event_name", "event_stage", "expectation_level", "surprise_level",
                              "impact_direction", "impact_strength"))
    body = F.when(c("doc_id") % 17 == 0, F.concat(F.substring(body, 1, 40), F.lit(" oops")))\
        .otherwise(body)
    text = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))) \
        .when(c("doc_id") % 3 == 1, F.concat(F.lit("Answer follows: "), body)).otherwise(body)
    return ev.select(c("source_ids").alias("news_id"), text.alias("response"))


def scores(spark: SparkSession, sf_dir: str, horizon: int = 7) -> DataFrame:
    """Walk-forward style detail rows with a synthetic probability."""
    from barloom.plans.dataset import forward_returns
    from barloom.plans.market import rolling_features
    feats = rolling_features(bars(spark, sf_dir)).select(
        "trade_date", "index_code", "close", "ret_5d", "ma20_gap",
        "is_bull_trend", "is_bear_trend", "volatility_20d")
    rows = forward_returns(feats, [horizon]).withColumnRenamed(f"future_ret_{horizon}d", "future_ret")
    year = F.year("trade_date")
    doy, code = F.dayofyear("trade_date"), c("index_code").cast("int")
    rows = rows.filter(c("future_ret").isNotNull()).withColumns({
        "buy_proba": ((doy * 37 + year * 11 + code * 17) % 101) / 100.0,
        "short_proba": ((doy * 53 + year * 7 + code * 29) % 101) / 100.0,
        "test_year": year, "horizon": F.lit(horizon), "label_threshold": F.lit(0.005),
        "evaluation_regime": evaluation_regime(c("trade_date"), EVAL_START, BEAR),
        "causal_regime": causal_regime(c("is_bull_trend"), c("is_bear_trend")),
    })
    rows = rows.withColumns({
        "buy_label": (c("future_ret") > 0.005).cast("int"),
        "short_label": (c("future_ret") < 0).cast("int"),
    })
    from barloom.operators.selection import trade_position
    return trade_position(rows, ["index_code", "test_year", "horizon"])


def three_class(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    """Three-class labels with the previous row's label as the prediction."""
    from barloom.functions.labels import direction_label
    rows = scores(spark, sf_dir, horizon)
    s = Series("index_code", "trade_date")
    rows = rows.withColumn("label", direction_label(c("future_ret"), c("volatility_20d"), horizon))
    return rows.withColumns({"pred_label": F.expr(s.lag("label")), "pred_ret": c("buy_proba") - 0.5,
                             "up_proba": c("buy_proba")})
