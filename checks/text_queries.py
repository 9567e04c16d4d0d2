"""News, forum, event, dataset, upsert, extraction, similarity and report queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from barloom.functions import labels as L
from barloom.functions import text as T
from barloom.operators import similar as sim
from barloom.operators import upsert as up
from barloom.plans import dataset as D
from barloom.plans import events as EV
from barloom.plans import market as M
from barloom.plans import modeling as MD
from barloom.plans import reports as R
from barloom.plans import sentiment as SE
from barloom.schemas import EVENT_GROUPS, MARKET_FEATURES, event_features, rolled_event_features
from barloom.sources import bars as B
from barloom.sources import forum as FO
from barloom.sources import news as NW
from barloom.streaming import refresh as RF
from checks import evaluation_queries as EQ
from checks import fixtures as fx
from checks import market_queries as MQ
from checks import oracle_views as ov
from checks.evaluation_queries import r9, rounded

c = F.col

# --- Spark side -----------------------------------------------------------------------------


def event_daily(spark, sf_dir):
    df = EV.daily_event_features(fx.raw_events(spark, sf_dir), fx.news(spark, sf_dir))
    return rounded(df.select("trade_date", *event_features([])))


def event_group_daily(spark, sf_dir):
    df = EV.daily_event_features(fx.raw_events(spark, sf_dir), fx.news(spark, sf_dir))
    return rounded(df.select("trade_date", *event_features()[5:]))


def event_rolling(spark, sf_dir):
    daily = EV.daily_event_features(fx.raw_events(spark, sf_dir), fx.news(spark, sf_dir))
    days = fx.bars(spark, sf_dir).select("trade_date", "index_code")
    df = EV.roll_events(EV.attach_daily(days, daily, event_features()))
    return rounded(df.select("trade_date", "index_code", *rolled_event_features()))


def event_score(spark, sf_dir):
    return rounded(fx.raw_events(spark, sf_dir).select("source_ids", "event_score"))


def event_answers(spark, sf_dir):
    df = EV.parse_event_answers(fx.responses(spark, sf_dir), fx.news(spark, sf_dir))
    return rounded(df.select("source_ids", "trade_date", "event_name", "event_stage", "expectation_level",
                             "surprise_level", "impact_direction", "impact_strength", "event_score",
                             "matched_groups"))


def keyword_match(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.to_json(T.matched_keywords(c("text"), fx.GROUPS)).alias("keywords"),
                       F.to_json(T.matched_groups(c("text"), fx.GROUPS)).alias("groups"),
                       T.keep_by_keywords(c("text"), fx.GROUPS).cast("int").alias("kept"))


def lexicon_sentiment(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.lexicon_score(c("text"), fx.POSITIVE, fx.NEGATIVE).alias("score"))


def news_ids(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    day = F.lit("1995-01-03").cast("date")
    return docs.select("doc_id", T.news_id(c("source"), c("lang"), c("text")).alias("plain_id"),
                       T.stable_news_id(c("source"), day, c("text"), c("lang")).alias("stable_id"))


def post_ids(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    return posts.select("url", T.post_id(c("url")).alias("derived_id"),
                        T.comment_id(c("post_id"), c("author"), c("trade_date"), c("title"), c("read_count"))
                        .alias("comment_key"))


def _sentiment(spark, sf_dir):
    return SE.sentiment_features(fx.posts(spark, sf_dir), fx.comments(spark, sf_dir),
                                 positive=fx.POSITIVE, negative=fx.NEGATIVE)


def heat_features(spark, sf_dir):
    return rounded(_sentiment(spark, sf_dir).drop("emotion_stage", "top_keywords"), 6)


def emotion_stage(spark, sf_dir):
    return _sentiment(spark, sf_dir).select("trade_date", "topic", "emotion_stage")


def sentiment_daily(spark, sf_dir):
    return rounded(SE.daily_sentiment(_sentiment(spark, sf_dir)), 6)


def candidates_antijoin(spark, sf_dir):
    df = EV.news_candidates(fx.news(spark, sf_dir), fx.raw_events(spark, sf_dir))
    return df.select("news_id", "trade_date", "matched_groups")


def candidates_recent(spark, sf_dir):
    df = EV.recent_candidates(fx.news(spark, sf_dir), fx.raw_events(spark, sf_dir), limit=30)
    return df.select("news_id", "trade_date")


def per_day_cap(spark, sf_dir):
    none = fx.raw_events(spark, sf_dir).filter("false")
    df = EV.history_candidates(fx.news(spark, sf_dir), none, "1995-06-01", "2001-06-30", limit_per_day=2)
    return df.select("news_id", "trade_date")


def prompt_texts(spark, sf_dir):
    df = fx.news(spark, sf_dir)
    return df.select("news_id", T.prompt_text(
        T.json_list(c("matched_groups")), T.json_list(c("matched_keywords")), c("title"), c("content"),
        "<<{news_text}>>").alias("prompt"))


def bars_normalize(spark, sf_dir):
    raw = fx.bars(spark, sf_dir).withColumnsRenamed({
        "trade_date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘",
        "volume": "成交量", "amount": "成交额"})
    df = B.normalize_index_bars(raw, "1996-01-01", "2000-12-31", "fixture").drop("index_name")
    return rounded(df.withColumn("symbol", B.exchange_symbol(c("index_code"))), 6)


def etf_normalize(spark, sf_dir):
    raw = fx.bars(spark, sf_dir).withColumnsRenamed({"index_code": "etf_code", "trade_date": "date", "amount": "换手率"})
    df = B.normalize_etf_bars(raw, "1996-01-01", None, "fixture").drop("etf_name")
    return rounded(df.withColumn("symbol", B.exchange_symbol(c("etf_code"), "etf")), 6)


def futures_normalize(spark, sf_dir):
    raw = fx.bars(spark, sf_dir).withColumn("结算价", (c("high") + c("low")) / 2).withColumnsRenamed(
        {"index_code": "future_code", "trade_date": "date", "volume": "hold"})
    return rounded(B.normalize_futures_bars(raw, "fixture").drop("future_name", "category"), 6)


def source_fallback(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    # source a has code 4 before the asked range only
    early = (c("index_code") == "4") & (c("trade_date") < F.lit("1996-01-01").cast("date"))
    a = bars.filter((c("index_code") <= "3") | early).withColumnsRenamed({
        "trade_date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘",
        "volume": "成交量", "amount": "成交额"}).withColumn("origin", F.lit("a"))
    b = bars.drop("volume", "amount").withColumnRenamed("trade_date", "date").withColumn("origin", F.lit("b"))
    broken = bars.drop("close")
    return rounded(B.first_source([broken, a, b], start="1996-01-01", end="2001-06-30"), 6)


def upsert_latest(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    base = bars.filter(F.year("trade_date").between(1995, 1999))
    batch = bars.filter(F.year("trade_date").between(1999, 2001)).withColumn("close", c("close") * 1.01)
    batch = batch.drop("amount").withColumn("load", F.lit(0))
    again = batch.filter(c("trade_date") == F.lit("2000-03-01").cast("date")).withColumns(
        {"close": c("close") + 1, "load": F.lit(1)})
    return rounded(up.upsert(base, batch.unionByName(again), ["trade_date", "index_code"], "load"), 9)


def upsert_immutable(spark, sf_dir):
    ev = fx.raw_events(spark, sf_dir).select("trade_date", "event_name", "event_score", "source_ids", "doc_id")
    day = F.lit("1998-06-01").cast("date")
    base = ev.filter(c("trade_date") < day)
    batch = ev.filter(c("trade_date") >= F.add_months(day, -12)).withColumns({
        "trade_date": F.date_add("trade_date", 1), "event_name": F.lit("renamed"),
        "event_score": c("event_score") + 1})
    return rounded(up.upsert(base, batch, **EV.EVENT_UPSERT))


def update_join(spark, sf_dir):
    rows = fx.scores(spark, sf_dir).select("trade_date", "index_code", "buy_proba", c("future_ret").alias("future_ret_7d"))
    stored = rows.withColumn("future_ret_7d", F.when(F.year("trade_date") < 2001, c("future_ret_7d")))
    return rounded(up.fill_from(stored, rows, ["trade_date", "index_code"], "future_ret_7d"))


def pattern_delete(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    posts = posts.withColumn("url", F.when(c("post_id").cast("int") % 17 != 0, c("url")))
    return up.delete_foreign_urls(posts, "click", "click").select("post_id", "bar_name", "url")


def dedup_last(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return up.latest_per_key(ev, ["user_id", "event_type"], c("ts"), c("event_id")).select(
        "user_id", "event_type", "event_id", "value")


def json_pack_unpack(spark, sf_dir):
    df = fx.scores(spark, sf_dir).select("trade_date", "index_code", c("ret_5d").alias("f_ret_5d"),
                                         c("volatility_20d").alias("f_volatility_20d"))
    packed = D.pack_features(df)
    return rounded(D.unpack_features(packed, ["ret_5d", "volatility_20d", "absent"]), 6)


def link_extract(spark, sf_dir):
    pages = fx.linked_pages(spark, sf_dir)
    df = NW.extract_links(pages, fx.GROUPS, max_items=3, source="page_id", min_text=6)
    return df.select("news_id", "source", "pos", "title", "url", "matched_groups")


def page_anchors(spark, sf_dir):
    pages = fx.linked_pages(spark, sf_dir)
    df = NW.page_links(pages)
    return df.select("page_id", "pos", "href", "text", T.absolute_url(c("href"), c("url")).alias("link"))


def page_flags(spark, sf_dir):
    df = FO.page_flags(fx.table(spark, sf_dir, "pages"))
    return df.select("page_id", "is_challenge", "is_forbidden")


def forum_list(spark, sf_dir):
    """Board pages written from the events: a stale title, then the row with its counts."""
    ev = fx.table(spark, sf_dir, "events")
    number = c("event_id").cast("string")
    board = F.when(c("event_id") % 13 == 0, F.lit("other")).otherwise(c("event_type"))
    href = F.concat(F.lit("/news,"), board, F.lit(","), number, F.lit(".html"))
    html = F.concat(
        F.lit("<html><body><p><a href='"), href, F.lit("'>stale</a></p><table><TR class='listitem'><td class=\"read\">"),
        F.floor("value").cast("int").cast("string"), F.lit("</td><td><div class='reply'>"),
        (c("event_id") % 7).cast("string"), F.lit("</div></td><td class='title'><a class=t title=it's href=\"//guba.eastmoney.com"),
        href, F.lit("\">Post <b>"), number, F.lit("</b> &amp; more</a></td></TR></table><a href='/about'>about</a></body></html>"))
    pages = ev.select(c("event_id").alias("page_id"), c("event_type").alias("bar_name"),
                      F.concat(F.lit("https://guba.eastmoney.com/list,"), c("event_type"), F.lit("_3.html")).alias("url"),
                      html.alias("html"))
    return FO.list_page_posts(pages).select("post_id", "bar_name", "title", "read_count", "comment_count", "url")


def forum_detail(spark, sf_dir):
    """Detail pages written from the events, applied over list rows, then admitted."""
    ev = fx.table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    known = c("event_id") % 11 != 0
    fields = F.when(known, F.concat(
        F.lit('<script>var d={"post_publish_time" : "'), stamp, F.lit('","post_title":"Fresh '), c("event_type"),
        F.lit('","post_content":"","post_abstract":"Sum '), c("user_id").cast("string"), F.lit('","post_click_count":'),
        F.floor("value").cast("int").cast("string"), F.lit("}</script>"))) \
        .otherwise(F.lit("<div class='y'>no</div><div class='x newstext'><div>Body <i>only</i></div><div>second<div>inner</div></div>"
                         "<p>third</p></div><div>after</div>"))
    pages = ev.select(c("event_id").cast("string").alias("post_id"), F.concat(F.lit("<html>"), fields, F.lit("</html>")).alias("html"))
    posts = ev.select(c("event_id").cast("string").alias("post_id"), F.lit("old").alias("title"),
                      F.lit("old body").alias("content"), (c("event_id") % 5).cast("int").alias("comment_count"))
    got = FO.apply_details(posts, FO.post_details(pages).drop("html"))
    return got.select("post_id", "title", "content", "comment_count", "read_count", "publish_time",
                      c("publish_time").isNotNull().cast("int").alias("admitted"))


def forum_comments(spark, sf_dir):
    """Comment pages written from the conversations: every text twice, one copy kept; nested markup, two lists."""
    conv = fx.table(spark, sf_dir, "conversations")
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "[<>&]", " "), r"\s+", " "))
    author = F.when(c("turn") % 2 == 0, F.concat(F.lit("<a class='author'>"), c("role"))).otherwise(
        F.concat(F.lit("<a href='//i.eastmoney.com/7'>"), c("role")))
    node = F.concat(
        F.lit("<div class='reply_item'>"), author, F.lit("</a><div class='reply_content'><div>"), text,
        F.lit("</div><div>more</div></div> 01-02 03:0"), (c("turn") % 10).cast("string"), F.lit("<ul><li>x</li></ul> like 1"),
        (c("conv_id") % 10).cast("string"), F.lit("</div>"))
    last = F.concat(F.lit("<ul class='comment-list'><li>Second "), c("turn").cast("string"), F.lit("<li>Third </ul>"))
    pages = conv.select(F.concat_ws(":", "conv_id", "turn").alias("post_id"), F.lit("b").alias("bar_name"), F.lit("u").alias("url"),
                        F.concat(F.lit("<body><ul>"), node, node, F.lit("</ul>"), last, F.lit("<footer>like 99</footer></body>")).alias("html"))
    got = FO.page_comments(pages, 2024)
    return got.select("comment_id", "post_id", "content", "author", "publish_time", "like_count", "reply_count")


def lookback_refresh(spark, sf_dir):
    """Land the bars, then the corrected last 15 days, and upsert both by a stream."""
    bars = fx.bars(spark, sf_dir)
    end = str(bars.agg(F.max("trade_date")).first()[0])
    late = RF.look_back(bars, end).withColumn("close", c("close") + 1)
    # every key of the second landing stands in two of its files' rows; the later row wins
    late = late.withColumn("close", c("close") - 5).unionByName(late).coalesce(1)
    root = fx.scratch(spark, "refresh")
    bars.write.parquet(f"{root}/landed")
    for rows in (bars.filter("false"), late):
        rows.write.mode("append").parquet(f"{root}/landed")
        RF.refresh_table(spark, f"{root}/landed", bars.schema, f"{root}/table", ["trade_date", "index_code"],
                         f"{root}/progress")
    return rounded(spark.read.parquet(f"{root}/table").select("trade_date", "index_code", "open", "close"))


def date_spine(spark, sf_dir):
    """Calendar days of the bar history without a bar of the target."""
    bars = fx.bars(spark, sf_dir).filter(c("index_code") == fx.TARGET).select("trade_date")
    first, last = bars.agg(F.min("trade_date").cast("string"), F.max("trade_date").cast("string")).first()
    return B.date_spine(spark, first, last).join(bars, "trade_date", "left_anti")


def similar_dates(spark, sf_dir):
    vecs = fx.table(spark, sf_dir, "embeddings")
    last = vecs.agg(F.max("vec_id")).scalar()
    rows = vecs.withColumn("_last", last)
    df = sim.similar_vectors(rows, "embedding", 64, c("vec_id") == c("_last"), c("vec_id") < c("_last"), 20, "vec_id")
    return rounded(df.select("vec_id", "similarity"), 6)


def similar_every_date(spark, sf_dir):
    """The 20 most similar earlier dates of every date of the target series."""
    feats = M.rolling_features(fx.bars(spark, sf_dir)).filter(c("index_code") == fx.TARGET)
    near = sim.similar_to_every_date(feats, ["ret_1d", "ret_5d", "ma20_gap", "volatility_20d"], block=256)
    return rounded(near.select("trade_date", "rank", "similar_date", "similarity"), 6)


def similar_summary(spark, sf_dir):
    feats = M.rolling_features(fx.bars(spark, sf_dir))
    data = D.forward_returns(feats.select("trade_date", "index_code", "close", "ret_1d", "ret_5d", "ma20_gap",
                                          "volatility_20d"), [3, 5, 7])
    near = sim.similar_dates(data, "2000-06-15", ["ret_1d", "ret_5d", "ma20_gap", "volatility_20d"], code=fx.TARGET)
    return rounded(sim.similar_summary(near).select("count", "score", *[
        f"{n}_{h}d" for h in (3, 5, 7) for n in ("avg_ret", "up_prob")], "dates"), 6)


def _dataset(spark, sf_dir):
    bars = fx.bars(spark, sf_dir)
    feats = M.market_features(bars, fx.TARGET, fx.BENCHMARKS, keep_close=True)
    return D.model_dataset(feats, bars, fx.raw_events(spark, sf_dir), fx.news(spark, sf_dir))


def model_dataset(spark, sf_dir):
    return rounded(_dataset(spark, sf_dir), 6)


def _signals(spark, sf_dir):
    s = fx.scores(spark, sf_dir).filter(c("index_code") == fx.TARGET)
    return s.select("trade_date", F.lit("v1").alias("model_version"), "horizon", "causal_regime", "buy_proba",
                    F.lit(0.6).alias("buy_threshold"),
                    L.signal_direction(c("causal_regime"), c("buy_proba"), F.lit(0.6)).alias("direction"),
                    F.when(F.dayofyear("trade_date") % 5 != 0, c("future_ret")).alias("future_ret_7d"))


def _two_versions(spark, sf_dir):
    """The signals of two model versions a date, of which one is reported."""
    s = _signals(spark, sf_dir)
    other = s.withColumns({"model_version": F.lit("v0"), "direction": F.lit("neutral")})
    return s.unionByName(other)


def report_recent(spark, sf_dir):
    return R.recent_signals(_two_versions(spark, sf_dir), model_version="v1")


def report_latest(spark, sf_dir):
    return R.latest_signal(_two_versions(spark, sf_dir), "v1")


def report_realized(spark, sf_dir):
    return rounded(R.realized_metrics(_signals(spark, sf_dir)))


def report_prices(spark, sf_dir):
    signals = _signals(spark, sf_dir).filter(c("direction") == "long")
    return rounded(R.price_overlay(fx.bars(spark, sf_dir), signals, fx.TARGET), 6)


def forum_status(spark, sf_dir):
    return R.forum_status(fx.posts(spark, sf_dir), "click", "click")


def forum_edge_days(spark, sf_dir):
    posts = fx.posts(spark, sf_dir).filter(c("bar_name") == "click")
    return R.edge_days(posts, newest=True).withColumn("edge", F.lit("newest")).unionByName(
        R.edge_days(posts, newest=False).withColumn("edge", F.lit("oldest")))


def comment_status(spark, sf_dir):
    return R.comment_status(fx.comments(spark, sf_dir), "click")


def cleanup_audit(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    return R.cleanup_audit(up.delete_foreign_urls(posts, "click", "click"), "click", "click")


def news_status(spark, sf_dir):
    return R.news_status(fx.news(spark, sf_dir))


def news_by_source(spark, sf_dir):
    return R.news_by_source(fx.news(spark, sf_dir))


def news_latest(spark, sf_dir):
    return R.latest_news(fx.news(spark, sf_dir)).select("news_id", "source", "trade_date")


def return_bands(spark, sf_dir):
    df = fx.three_class(spark, sf_dir)
    low, high = L.return_band(c("pred_ret"))
    return rounded(df.select("trade_date", "index_code", low.alias("return_low"), high.alias("return_high"),
                             L.mean_of_known(c("ret_5d"), c("ma20_gap"), c("pred_ret")).alias("tech_score")), 6)


def lenient_numbers(spark, sf_dir):
    from barloom.functions.nulls import lenient_int, lenient_number
    ev = fx.table(spark, sf_dir, "events")
    text = F.when(c("event_id") % 5 == 0, F.concat(F.lit("1,"), c("value").cast("string"), F.lit("%"))) \
        .when(c("event_id") % 5 == 1, F.lit("n/a")).when(c("event_id") % 5 == 2, F.lit("")) \
        .otherwise(c("event_id").cast("string"))
    return rounded(ev.select("event_id", lenient_number(text).alias("as_number"), lenient_int(text).alias("as_int")), 6)


def _landed_docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").withColumn("trade_date", F.date_add(
        F.lit("1995-01-03").cast("date"), ((c("doc_id") * 7) % 2400).cast("int")))


def transcripts(spark, sf_dir):
    """Transcript rows: the part before the first full stop is the title."""
    raw = _landed_docs(spark, sf_dir).select(
        "trade_date", F.split_part("text", F.lit("."), F.lit(1)).alias("标题"), c("text").alias("详情"),
        F.when(c("lang") == "en", F.concat(F.lit("https://n/"), c("doc_id").cast("string"))).alias("链接"))
    return NW.normalize_transcripts(raw, groups=fx.GROUPS).withColumn(
        "publish_time", c("publish_time").cast("string"))


def calendar_rows(spark, sf_dir):
    """Calendar rows: every known value joins the content."""
    raw = _landed_docs(spark, sf_dir).select(
        "trade_date", F.when(c("lang") != "de", c("source")).alias("事件"), c("text").alias("value"),
        F.when(c("lang") == "fr", c("lang")).alias("region"), c("n_chars").alias("size"))
    return NW.normalize_calendar(raw, groups=fx.GROUPS).select(
        "news_id", "trade_date", "title", "content", "url", "matched_groups")


def commented_posts(spark, sf_dir):
    return FO.commented_posts(FO.admitted_posts(fx.posts(spark, sf_dir))).select("post_id", "comment_count")


def time_splits(spark, sf_dir):
    parts = MD.time_split(fx.bars(spark, sf_dir), fx.SPLITS)
    counts = [df.groupBy("index_code").agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last"))
              .withColumn("split", F.lit(name)) for name, df in zip(("train", "valid", "test"), parts)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def latest_rows(spark, sf_dir):
    return rounded(MD.select_rows(fx.bars(spark, sf_dir)), 6)


def oof_folds(spark, sf_dir):
    return MD.time_series_folds(fx.late_series(fx.bars(spark, sf_dir)), 3).select("trade_date", "index_code", "fold")


def explanations(spark, sf_dir):
    df = fx.three_class(spark, sf_dir).filter(c("label").isNotNull() & c("ret_5d").isNotNull())
    return df.select("trade_date", "index_code", L.explanation_text(
        c("horizon"), c("label"), c("pred_ret"), c("buy_proba"), c("buy_proba"), F.lit(0.0), c("short_proba"),
        F.lit("。")).alias("explanation"))


QUERIES = {f.__name__: f for f in (
    transcripts, calendar_rows, commented_posts, time_splits, latest_rows, oof_folds, explanations,
    event_daily, event_group_daily, event_rolling, event_score, event_answers, keyword_match,
    lexicon_sentiment, news_ids, post_ids, heat_features, emotion_stage, sentiment_daily,
    candidates_antijoin, candidates_recent, per_day_cap, prompt_texts, bars_normalize, etf_normalize,
    futures_normalize, source_fallback, upsert_latest, upsert_immutable, update_join, pattern_delete,
    dedup_last, json_pack_unpack, link_extract, page_anchors, page_flags, forum_list,
    forum_detail, forum_comments, lookback_refresh, date_spine, similar_dates,
    similar_every_date, similar_summary, model_dataset, report_recent, report_latest, report_realized, report_prices,
    forum_status, forum_edge_days, comment_status, cleanup_audit, news_status, news_by_source,
    news_latest, return_bands, lenient_numbers)}

# --- DuckDB side ----------------------------------------------------------------------------


def any_of(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def groups_sql(text):
    cases = ", ".join(f"CASE WHEN {any_of(text, ws)} THEN '{g}' END" for g, ws in fx.GROUPS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def keywords_sql(text):
    words = sorted({w for ws in fx.GROUPS.values() for w in ws})
    cases = ", ".join(f"CASE WHEN contains({text}, '{w}') THEN '{w}' END" for w in words)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def lexicon_sql(text):
    t = f"coalesce({text}, '')"
    plus = " + ".join(f"CAST(contains({t}, '{w}') AS INTEGER)" for w in fx.POSITIVE)
    minus = " + ".join(f"CAST(contains({t}, '{w}') AS INTEGER)" for w in fx.NEGATIVE)
    return f"(({plus}) - ({minus}))"


NEWS = f"""
news AS (
  SELECT sha1(concat_ws('|', source, CAST(doc_id AS VARCHAR))) AS news_id, doc_id, source, n_chars,
    CAST(DATE '1995-01-03' + CAST((doc_id * 7) % 2400 AS INTEGER) AS DATE) AS trade_date,
    substring(text, 1, 500) AS title, text AS content,
    CAST(to_json({keywords_sql('text')}) AS VARCHAR) AS matched_keywords,
    CAST(to_json({groups_sql('text')}) AS VARCHAR) AS matched_groups, {groups_sql('text')} AS groups
  FROM documents)"""


def pick(values, index):
    return f"([{', '.join(repr(v) for v in values)}])[{index} + 1]"


def factor(values, key, default):
    return "(CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END)"


SCORE = (f"{factor(T.DIRECTION_FACTOR, 'impact_direction', 0.0)} * least(greatest(coalesce(impact_strength, 1), 1), 5) * "
         f"{factor(T.EXPECTATION_FACTOR, 'expectation_level', 1.0)} * {factor(T.STAGE_FACTOR, 'event_stage', 1.0)} * "
         f"{factor(T.SURPRISE_FACTOR, 'surprise_level', 1.0)}")
EVENTS = NEWS + f""",
ev0 AS (
  SELECT n.doc_id, n.trade_date, substring(title, 1, 200) AS event_name, {pick(fx.STAGES, '(n.doc_id % 6)')} AS event_stage,
    {pick(fx.EXPECTATIONS, '(n.doc_id % 5)')} AS expectation_level, {pick(fx.SURPRISES, '(n.doc_id % 4)')} AS surprise_level,
    CASE WHEN toxic = 1 THEN '利空' WHEN quality = 1 THEN '利多' ELSE '中性' END AS impact_direction,
    CAST(n_chars % 7 AS INTEGER) AS impact_strength, news_id AS source_ids, matched_groups, groups
  FROM news n JOIN labels l ON l.doc_id = n.doc_id),
ev AS (SELECT *, {SCORE} AS event_score FROM ev0)"""


def _group_cols():
    out = []
    for g in EVENT_GROUPS:
        m = f"list_contains(groups, '{g}')"
        out += [f"sum(CASE WHEN {m} THEN event_score ELSE 0 END) AS event_{g}_score",
                f"count(*) FILTER ({m}) AS event_{g}_count",
                f"count(*) FILTER ({m} AND event_score > 0) AS event_{g}_positive_count",
                f"count(*) FILTER ({m} AND event_score < 0) AS event_{g}_negative_count",
                f"coalesce(max(CASE WHEN {m} THEN CAST(impact_strength AS DOUBLE) END), 0) AS event_{g}_max_strength"]
    return ", ".join(out)


DAILY = EVENTS + f""",
daily AS (
  SELECT trade_date, avg(event_score) AS event_score, count(*) AS event_count,
    count(*) FILTER (event_score > 0) AS event_positive_count, count(*) FILTER (event_score < 0) AS event_negative_count,
    max(CAST(impact_strength AS DOUBLE)) AS event_max_strength, {_group_cols()}
  FROM ev GROUP BY trade_date)"""


def roll_sql(src="evd", prefix=""):
    out = []
    for n in (3, 5, 10):
        for col in event_features():
            fn = "max" if col.endswith("_max_strength") else "sum"
            out.append(f"{fn}({prefix}{col}) OVER {ov.rows(n)} AS {col}_roll_{n}d")
    return ", ".join(out)


_r = lambda n: f"round(CAST({n} AS DOUBLE), 9) AS {n}"
_counts = {n for n in event_features() if n.endswith("count")}
_d = lambda n: n if n in _counts else _r(n)
EVD = f""",
evd AS (SELECT b.trade_date, b.index_code, {', '.join(f"CAST(coalesce(d.{n}, 0) AS DOUBLE) AS {n}" for n in event_features())}
  FROM bars b LEFT JOIN daily d USING (trade_date))"""

POSTS = """
titles AS (SELECT doc_id, text AS title FROM documents),
posts AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id, event_type AS bar_name, ts AS publish_time, CAST(ts AS DATE) AS trade_date, title,
    CAST(floor(value) AS INTEGER) AS read_count, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 7 AS INTEGER) END AS comment_count,
    CAST(user_id AS VARCHAR) AS author, 'https://x/news,' || CASE WHEN event_id % 13 = 0 THEN 'other' ELSE event_type END || ',' || event_id || '.html' AS url
  FROM events LEFT JOIN titles ON titles.doc_id = event_id % (SELECT count(*) FROM documents))"""
COMMENTS = """
comments AS (
  SELECT conv_id || ':' || turn AS comment_id, CAST(conv_id AS VARCHAR) AS post_id, event_type AS bar_name, ts AS publish_time,
    CAST(ts AS DATE) AS trade_date, role AS author, text AS content
  FROM conversations JOIN events ON event_id = conv_id)"""
_hz = lambda n: ov.ratio(f"heat_score - {ov.full('avg({x})', 'heat_score', n, 'PARTITION BY topic ORDER BY trade_date')}",
                         ov.full("stddev_samp({x})", "heat_score", n, "PARTITION BY topic ORDER BY trade_date"))
SENT = POSTS.strip() + "," + COMMENTS + f""",
pa AS (SELECT trade_date, bar_name AS topic, count(DISTINCT post_id) AS post_count, sum(coalesce(CAST(comment_count AS DOUBLE), 0)) AS declared,
  sum(coalesce(CAST(read_count AS DOUBLE), 0)) AS read_count FROM posts GROUP BY 1, 2),
ca AS (SELECT trade_date, bar_name AS topic, count(DISTINCT comment_id) AS observed FROM comments GROUP BY 1, 2),
moods AS (SELECT trade_date, bar_name AS topic, {lexicon_sql('title')} AS score FROM posts
  UNION ALL SELECT trade_date, bar_name, {lexicon_sql('content')} FROM comments),
ma AS (SELECT trade_date, topic, avg(score) AS sentiment_score, avg(CAST(score > 0 AS INTEGER)) AS positive_ratio,
  avg(CAST(score < 0 AS INTEGER)) AS negative_ratio FROM moods GROUP BY 1, 2),
act AS (SELECT pa.trade_date, pa.topic, post_count, greatest(declared, CAST(coalesce(observed, 0) AS DOUBLE)) AS comment_count, read_count,
  sentiment_score, positive_ratio, negative_ratio, 1 - abs(positive_ratio - negative_ratio) AS disagreement
  FROM pa LEFT JOIN ca USING (trade_date, topic) LEFT JOIN ma USING (trade_date, topic)),
heat AS (SELECT *, ln(1 + post_count) + 0.5::DOUBLE * ln(1 + comment_count) + 0.2::DOUBLE * ln(1 + read_count) AS heat_score FROM act),
sent AS (SELECT *, 'eastmoney_guba' AS source, {_hz(20)} AS heat_zscore_20d, {_hz(60)} AS heat_zscore_60d,
  {ov.ratio('heat_score', 'lag(heat_score, 3) OVER (PARTITION BY topic ORDER BY trade_date)')} - 1 AS heat_change_3d FROM heat)"""
STAGE = (f"CASE WHEN heat_zscore_20d IS NULL THEN '{L.COLD}' WHEN heat_zscore_20d > 2 AND heat_change_3d > 0 THEN '{L.CLIMAX}' "
         f"WHEN heat_zscore_20d > 1 THEN '{L.FERMENT}' WHEN disagreement > 0.45::DOUBLE AND heat_zscore_20d > 0.8::DOUBLE THEN '{L.SPLIT}' "
         f"WHEN heat_change_3d < -0.2::DOUBLE THEN '{L.EBB}' WHEN heat_zscore_20d > 0 THEN '{L.WARM}' ELSE '{L.COLD}' END")
_r6 = lambda n: f"round({n}, 6) AS {n}"

CANDS = EVENTS + """,
cand AS (SELECT n.*, CASE WHEN matched_groups <> '[]' THEN 0 ELSE 1 END AS unmatched FROM news n WHERE news_id NOT IN (SELECT source_ids FROM ev))"""

ANSWERS = EVENTS + f""",
ans AS (
  SELECT *, doc_id % 17 <> 0 AS ok FROM ev),
ans2 AS (SELECT source_ids, trade_date, ok,
    CASE WHEN ok THEN event_name ELSE (SELECT substring(CASE WHEN n.title = '' THEN '{EV.NEUTRAL_NAME}' ELSE n.title END, 1, 200) FROM news n WHERE n.news_id = ans.source_ids) END AS event_name,
    CASE WHEN ok THEN event_stage ELSE '确认' END AS event_stage, CASE WHEN ok THEN expectation_level ELSE '中性' END AS expectation_level,
    CASE WHEN ok THEN surprise_level ELSE '符合预期' END AS surprise_level, CASE WHEN ok THEN impact_direction ELSE '中性' END AS impact_direction,
    CASE WHEN ok AND impact_strength <> 0 THEN impact_strength ELSE 1 END AS impact_strength,
    CASE WHEN ok THEN event_score ELSE 0.0 END AS event_score, matched_groups FROM ans)"""

# the oracle's own pattern: whole attributes, then the target in one of three spellings
ANCHOR = ("""(?is)<a\\s+(?:[a-z-]+(?:\\s*=\\s*(?:"[^"]*"|'[^']*'|[^\\s>"'][^\\s>]*))?\\s+)*?href\\s*=\\s*"""
          """(?:"([^"]*)"|'([^']*)'|([^\\s>"'][^\\s>]*))[^>]*>(.*?)</a\\s*>""").replace("'", "''")


def visible(x):
    out = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for e, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{e}', '{ch}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


ABS = ("CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN "
       "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href WHEN starts_with(href, '/') THEN "
       "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || href WHEN starts_with(href, '#') THEN "
       "regexp_replace(url, '#.*$', '') || href WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href "
       "ELSE CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$') "
       "THEN regexp_replace(url, '[?#].*$', '') || '/' ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') END || href END")
LINKS = f"""
pg AS (SELECT page_id, url, html || '<p><a class=t href=/bare/' || page_id || '>Bare tion link</a> <a href="/it''s/' || page_id ||
  '">Apostrophe the link</a> <A TITLE=''x > y'' HREF=''?a=' || page_id || '&amp;b=2''>Entity <b>sch</b> &amp; link</A> <a name=x>no target</a> <a title=it''s href=/own/' || page_id || '>Own tion apostrophe</a></p>' ||
  CASE WHEN page_id % 100 = 0 THEN '<a ' || repeat('b ', 100000) || 'href=/long>The long tion link</a> <a ' || repeat('open ', 1000) ELSE '' END AS html FROM pages),
tags AS (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) AS h1, regexp_extract_all(html, '{ANCHOR}', 2) AS h2,
  regexp_extract_all(html, '{ANCHOR}', 3) AS h3, regexp_extract_all(html, '{ANCHOR}', 4) AS bs FROM pg),
an0 AS (SELECT page_id, url, unnest(range(len(bs))) AS i, h1, h2, h3, bs FROM tags),
an AS (SELECT page_id, url, CAST(i AS INTEGER) AS pos, replace(coalesce(h1[i + 1], '') || coalesce(h2[i + 1], '') || coalesce(h3[i + 1], ''), '&amp;', '&') AS href, {visible('bs[i + 1]')} AS text FROM an0)"""

VIS = f"lower({visible('html')})"

SIM = """
q AS (SELECT max(vec_id) AS last FROM embeddings),
x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i)),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY i),
z AS (SELECT vec_id, list(coalesce((v - m) / nullif(s, 0), 0) ORDER BY i) AS z FROM x JOIN st USING (i) GROUP BY vec_id)
SELECT h.vec_id, round(list_cosine_similarity(h.z, c.z), 6) AS similarity FROM z h, z c, q
WHERE c.vec_id = q.last AND h.vec_id < q.last ORDER BY list_cosine_similarity(h.z, c.z) DESC, h.vec_id LIMIT 20"""
_sf = ["ret_1d", "ret_5d", "ma20_gap", "volatility_20d"]
SIMSUM = ov.with_(ov.ROLLING).rstrip() + f""",
sd AS (SELECT trade_date, {', '.join(_sf)}, {EQ._fr} FROM rolling WHERE index_code = '{fx.TARGET}'),
su AS (SELECT * FROM sd WHERE trade_date <= DATE '2000-06-15' AND coalesce({', '.join(_sf)}) IS NOT NULL),
ss AS (SELECT {', '.join(f'avg(coalesce({n}, 0)) AS m_{n}, stddev_pop(coalesce({n}, 0)) AS s_{n}' for n in _sf)} FROM su),
sz AS (SELECT su.*, [{', '.join(f'coalesce((coalesce({n}, 0) - m_{n}) / nullif(s_{n}, 0), 0)' for n in _sf)}] AS z FROM su, ss),
near AS (SELECT h.*, list_cosine_similarity(h.z, c.z) AS similarity FROM sz h, sz c WHERE c.trade_date = DATE '2000-06-15'
  AND h.trade_date < c.trade_date ORDER BY similarity DESC, h.trade_date LIMIT 20)
SELECT count(*) AS count, coalesce(round(avg(similarity), 6), 0) AS score,
  {', '.join(f"round(avg(future_ret_{h}d), 6) AS avg_ret_{h}d, round(avg(CAST(coalesce(future_ret_{h}d > 0, false) AS INTEGER)), 6) AS up_prob_{h}d" for h in (3, 5, 7))},
  coalesce(array_to_string(list(CAST(trade_date AS VARCHAR) ORDER BY similarity DESC, trade_date)[1:5], ','), '') AS dates FROM near"""

SIGNALS = EQ.scores().strip() + f""",
sg AS (SELECT trade_date, horizon, causal_regime, buy_proba, 0.6::DOUBLE AS buy_threshold,
  CASE WHEN causal_regime = 'bull' AND buy_proba >= 0.6::DOUBLE THEN 'long' ELSE 'neutral' END AS direction,
  CASE WHEN doy % 5 <> 0 THEN future_ret END AS future_ret_7d FROM scores WHERE index_code = '{fx.TARGET}')"""
_name = lambda col, names: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {col} END"
_OUT = (f"CASE WHEN future_ret_7d IS NULL THEN '{L.PENDING}' WHEN direction <> 'long' THEN '{L.NOT_LONG}' WHEN future_ret_7d > 0.005::DOUBLE "
        f"THEN '{L.HIT}' WHEN future_ret_7d > 0 THEN '{L.SHORT_OF_TARGET}' ELSE '{L.MISS}' END")
_pct = lambda x: f"CASE WHEN {x} IS NULL THEN '{L.PENDING}' ELSE printf('%.2f%%', {x} * 100) END"

ALL_VIEWS = ov.with_(ov.ROLLING, ov.EMA, ov.REL, recursive=True).rstrip() + "," + DAILY + EVD + f""",
evr AS (SELECT *, {roll_sql()} FROM evd),
wide AS (SELECT a.*, {', '.join('e.' + n for n in sorted(MQ._ema_names))}, r.relative_hs300, r.relative_zz500, r.relative_cyb, {EQ._fr.replace('close', 'a.close')}
  FROM rolling a JOIN ema_cols e USING (trade_date, index_code) LEFT JOIN rel r USING (trade_date))"""
ALL_VIEWS = ALL_VIEWS.replace("OVER (PARTITION BY index_code ORDER BY trade_date), 0)) - 1 AS future", "OVER (PARTITION BY a.index_code ORDER BY a.trade_date), 0)) - 1 AS future").replace(
    "lead(a.close, 3) OVER (PARTITION BY index_code ORDER BY trade_date)", "lead(a.close, 3) OVER (PARTITION BY a.index_code ORDER BY a.trade_date)").replace(
    "lead(a.close, 5) OVER (PARTITION BY index_code ORDER BY trade_date)", "lead(a.close, 5) OVER (PARTITION BY a.index_code ORDER BY a.trade_date)").replace(
    "lead(a.close, 7) OVER (PARTITION BY index_code ORDER BY trade_date)", "lead(a.close, 7) OVER (PARTITION BY a.index_code ORDER BY a.trade_date)")

_bars_norm = lambda key: ov.ratio("close", f"lag(close) OVER (PARTITION BY {key} ORDER BY trade_date)")
_b6 = ", ".join(f"round({n}, 6) AS {n}" for n in ("open", "high", "low", "close"))
LANDED = "landed AS (SELECT *, CAST(DATE '1995-01-03' + CAST((doc_id * 7) % 2400 AS INTEGER) AS DATE) AS trade_date FROM documents)"
ORACLES = {
    "transcripts": f"""WITH {LANDED}, tr AS (SELECT *, trim(split_part(text, '.', 1)) AS title, trim(text) AS body,
  CASE WHEN lang = 'en' THEN 'https://n/' || doc_id ELSE '' END AS url FROM landed),
tm AS (SELECT *, title || chr(10) || body AS whole FROM tr WHERE title <> '')
SELECT sha1('{NW.TRANSCRIPT_KEY}|' || trade_date || '|' || title || '|' || url) AS news_id, '{NW.TRANSCRIPT_SOURCE}' AS source,
  trade_date || ' 00:00:00' AS publish_time, trade_date, substring(title, 1, 500) AS title, body AS content, url,
  CAST(to_json({keywords_sql('whole')}) AS VARCHAR) AS matched_keywords, CAST(to_json({groups_sql('whole')}) AS VARCHAR) AS matched_groups
FROM tm WHERE len({groups_sql('whole')}) > 0""",
    "calendar_rows": f"""WITH {LANDED}, ca AS (SELECT *, CASE WHEN lang <> 'de' THEN source END AS title,
  concat_ws(' | ', CASE WHEN lang <> 'de' THEN source END, text, CASE WHEN lang = 'fr' THEN lang END, CAST(n_chars AS VARCHAR)) AS content FROM landed),
cm AS (SELECT *, title || chr(10) || content AS whole FROM ca WHERE title IS NOT NULL)
SELECT sha1('{NW.CALENDAR_KEY}|' || trade_date || '|' || title || '|' || content) AS news_id, trade_date, title, content,
  '{NW.CALENDAR_URL}' AS url, CAST(to_json({groups_sql('whole')}) AS VARCHAR) AS matched_groups FROM cm WHERE len({groups_sql('whole')}) > 0""",
    "commented_posts": "WITH " + POSTS.strip() + " SELECT post_id, comment_count FROM posts WHERE comment_count >= 3",
    "time_splits": ov.with_(ov.BARS) + f", sp AS (SELECT *, {EQ.SCOPE_SQL} AS split FROM bars) SELECT index_code, split, count(*) AS n, max(trade_date) AS last FROM sp WHERE split <> 'outside' GROUP BY 1, 2",
    "latest_rows": ov.with_(ov.BARS) + f"SELECT trade_date, index_code, {_b6}, round(volume, 6) AS volume, round(amount, 6) AS amount FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars)",
    "oof_folds": ov.with_(ov.BARS) + f""", panel AS (SELECT trade_date, index_code FROM bars UNION ALL SELECT trade_date, 'late' FROM bars WHERE index_code = '1' AND dayofyear(trade_date) > 356),
fo AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM panel))
SELECT panel.trade_date, index_code, CAST(CASE WHEN p < n - 3 * (n // 4) THEN 0 ELSE (p - (n - 3 * (n // 4))) // (n // 4) + 1 END AS INTEGER) AS fold
FROM panel JOIN fo ON panel.trade_date = fo.trade_date""",
    "explanations": "WITH " + EQ.three().strip() + """ SELECT trade_date, index_code,
  printf('模型预测%d日方向为%s，预测涨跌幅%.2f%%，置信度%.1f%%。', horizon, label, pred_ret * 100, buy_proba * 100) ||
  printf('技术得分%.4f，舆情得分%.4f，事件得分%.4f。', buy_proba, 0.0::DOUBLE, short_proba) || '。' AS explanation
FROM three WHERE label IS NOT NULL AND ret_5d IS NOT NULL""",
    "event_daily": "WITH " + DAILY.strip() + f" SELECT trade_date, {', '.join(_d(n) for n in event_features([]))} FROM daily",
    "event_group_daily": "WITH " + DAILY.strip() + f" SELECT trade_date, {', '.join(_d(n) for n in event_features()[5:])} FROM daily",
    "event_rolling": "WITH " + ov.BARS.strip() + "," + DAILY + EVD + f" SELECT trade_date, index_code, {', '.join(_r(n) for n in rolled_event_features())} FROM (SELECT *, {roll_sql()} FROM evd)",
    "event_score": "WITH " + EVENTS.strip() + f" SELECT source_ids, {r9('event_score', 'event_score')} FROM ev",
    "event_answers": "WITH " + ANSWERS.strip() + f" SELECT * EXCLUDE (ok, event_score), {r9('event_score', 'event_score')} FROM ans2",
    "keyword_match": f"SELECT doc_id, CAST(to_json({keywords_sql('text')}) AS VARCHAR) AS keywords, CAST(to_json({groups_sql('text')}) AS VARCHAR) AS groups, CAST(len({groups_sql('text')}) > 0 AS INTEGER) AS kept FROM documents",
    "lexicon_sentiment": f"SELECT doc_id, {lexicon_sql('text')} AS score FROM documents",
    "news_ids": "SELECT doc_id, sha1(source || '|' || lang || '|' || text) AS plain_id, sha1(source || '|1995-01-03|' || text || '|' || lang) AS stable_id FROM documents",
    "post_ids": "WITH " + POSTS.strip() + r""" SELECT url, CASE WHEN regexp_matches(url, '/news,([^,]+),(\d+)\.html') THEN regexp_extract(url, '/news,([^,]+),(\d+)\.html', 1) || ':' || regexp_extract(url, '/news,([^,]+),(\d+)\.html', 2) ELSE sha1(url) END AS derived_id,
  sha1(post_id || '|' || coalesce(author, '') || '|' || trade_date || '|' || coalesce(title, '') || '|' || coalesce(CAST(read_count AS VARCHAR), '')) AS comment_key FROM posts""",
    "heat_features": "WITH " + SENT + " SELECT trade_date, topic, source, post_count, " + ", ".join(_r6(n) for n in (
        "comment_count", "read_count", "heat_score", "heat_zscore_20d", "heat_zscore_60d", "heat_change_3d", "sentiment_score",
        "positive_ratio", "negative_ratio", "disagreement")) + " FROM sent",
    "emotion_stage": "WITH " + SENT + f" SELECT trade_date, topic, {STAGE} AS emotion_stage FROM sent",
    "sentiment_daily": "WITH " + SENT + " SELECT trade_date, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in (
        "heat_score", "heat_zscore_20d", "sentiment_score", "disagreement")) + " FROM sent GROUP BY trade_date",
    "candidates_antijoin": "WITH " + CANDS.strip() + " SELECT news_id, trade_date, matched_groups FROM cand",
    "candidates_recent": "WITH " + CANDS.strip() + " SELECT news_id, trade_date FROM cand ORDER BY trade_date DESC, unmatched, news_id DESC LIMIT 30",
    "per_day_cap": "WITH " + NEWS.strip() + """ SELECT news_id, trade_date FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY news_id DESC) AS rn
  FROM news WHERE trade_date BETWEEN DATE '1995-06-01' AND DATE '2001-06-30' AND matched_groups <> '[]') WHERE rn <= 2""",
    "prompt_texts": "WITH " + NEWS.strip() + f""" SELECT news_id, '<<' || substring('{T.PROMPT_LABELS[0]}' || CASE WHEN len(groups) = 0 THEN '{T.PROMPT_NONE}' ELSE array_to_string(groups, ', ') END || chr(10)
  || '{T.PROMPT_LABELS[1]}' || CASE WHEN matched_keywords = '[]' THEN '{T.PROMPT_NONE}' ELSE array_to_string({keywords_sql('content')}, ', ') END || chr(10)
  || '{T.PROMPT_LABELS[2]}' || title || chr(10) || '{T.PROMPT_LABELS[3]}' || content, 1, {T.PROMPT_LIMIT}) || '>>' AS prompt FROM news""",
    "bars_normalize": ov.with_(ov.BARS) + f"""SELECT trade_date, index_code, {_b6}, round(lag(close) OVER ({ov._PART}), 6) AS pre_close,
  round(({_bars_norm('index_code')} - 1) * 100, 6) AS pct_chg, round(volume, 6) AS volume, round(amount, 6) AS amount, 'fixture' AS data_source, 'sh' || index_code AS symbol
  FROM bars WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "etf_normalize": ov.with_(ov.BARS) + f"""SELECT trade_date, index_code AS etf_code, {_b6}, round(({_bars_norm('index_code')} - 1) * 100, 6) AS pct_chg,
  round(volume, 6) AS volume, CAST(NULL AS DOUBLE) AS amount, round(amount, 6) AS turnover, 'fixture' AS data_source,
  CASE WHEN index_code LIKE '5%' OR index_code LIKE '6%' THEN 'sh' ELSE 'sz' END || index_code AS symbol FROM bars WHERE trade_date >= DATE '1996-01-01'""",
    "futures_normalize": ov.with_(ov.BARS) + f"""SELECT trade_date, index_code AS future_code, {_b6}, round((high + low) / 2, 6) AS settle,
  round(({_bars_norm('index_code')} - 1) * 100, 6) AS pct_chg, CAST(NULL AS DOUBLE) AS volume, round(volume, 6) AS open_interest, CAST(NULL AS DOUBLE) AS amount, 'fixture' AS data_source FROM bars""",
    "source_fallback": ov.with_(ov.BARS) + f"""SELECT trade_date, index_code, {_b6}, CASE WHEN index_code <= '3' THEN round(volume, 6) END AS volume,
  CASE WHEN index_code <= '3' THEN round(amount, 6) END AS amount, CASE WHEN index_code <= '3' THEN 'a' ELSE 'b' END AS origin FROM bars
WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'""",
    "upsert_latest": ov.with_(ov.BARS) + """SELECT trade_date, index_code, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low,
  round(CASE WHEN year(trade_date) >= 1999 THEN close * 1.01::DOUBLE + CASE WHEN trade_date = DATE '2000-03-01' THEN 1 ELSE 0 END ELSE close END, 9) AS close,
  round(volume, 9) AS volume, CASE WHEN year(trade_date) <= 1999 THEN round(amount, 9) END AS amount FROM bars WHERE year(trade_date) BETWEEN 1995 AND 2001""",
    "upsert_immutable": "WITH " + EVENTS.strip() + """ SELECT CAST(CASE WHEN trade_date >= DATE '1998-06-01' THEN trade_date + 1 ELSE trade_date END AS DATE) AS trade_date,
  CASE WHEN trade_date >= DATE '1998-06-01' THEN 'renamed' ELSE event_name END AS event_name,
  round(CASE WHEN trade_date >= DATE '1997-06-01' THEN event_score + 1 ELSE event_score END, 9) AS event_score, source_ids, doc_id FROM ev""",
    "update_join": "WITH " + EQ.scores().strip() + " SELECT trade_date, index_code, round(buy_proba, 9) AS buy_proba, round(future_ret, 9) AS future_ret_7d FROM scores",
    "pattern_delete": "WITH " + POSTS.strip() + """, pu AS (SELECT post_id, bar_name, CASE WHEN CAST(post_id AS INTEGER) % 17 <> 0 THEN url END AS url FROM posts)
SELECT * FROM pu WHERE NOT (bar_name = 'click' AND coalesce(url NOT LIKE '%/news,click,%', false))""",
    "dedup_last": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "json_pack_unpack": "WITH " + EQ.scores().strip() + " SELECT trade_date, index_code, round(ret_5d, 6) AS f_ret_5d, round(volatility_20d, 6) AS f_volatility_20d, CAST(NULL AS DOUBLE) AS f_absent FROM scores",
    "link_extract": "WITH " + LINKS.strip() + f""", lk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM an
  WHERE href <> '' AND length(text) >= 6 AND len({groups_sql('text')}) > 0)
SELECT sha1(page_id || '|' || {ABS} || '|' || text) AS news_id, page_id AS source, pos, substring(text, 1, 500) AS title, {ABS} AS url,
  CAST(to_json({groups_sql('text')}) AS VARCHAR) AS matched_groups FROM lk WHERE rn <= 3""",
    "page_anchors": "WITH " + LINKS.strip() + f" SELECT page_id, pos, href, text, {ABS} AS link FROM an",
    "page_flags": f"SELECT page_id, CAST({any_of(VIS, FO.CHALLENGE_WORDS)} AS INTEGER) AS is_challenge, CAST({any_of(VIS, FO.FORBIDDEN_MARKS)} AS INTEGER) AS is_forbidden FROM pages",
    "forum_list": """SELECT event_type || ':' || event_id AS post_id, event_type AS bar_name, 'Post ' || event_id || ' & more' AS title,
  CAST(floor(value) AS INTEGER) AS read_count, CAST(event_id % 7 AS INTEGER) AS comment_count,
  'https://guba.eastmoney.com/news,' || event_type || ',' || event_id || '.html' AS url FROM events WHERE event_id % 13 <> 0""",
    "forum_detail": """SELECT CAST(event_id AS VARCHAR) AS post_id, CASE WHEN event_id % 11 <> 0 THEN 'Fresh ' || event_type ELSE 'old' END AS title,
  CASE WHEN event_id % 11 <> 0 THEN 'Sum ' || user_id ELSE 'Body only second inner third' END AS content, CAST(event_id % 5 AS INTEGER) AS comment_count,
  CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS INTEGER) END AS read_count, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS publish_time,
  CAST(event_id % 11 <> 0 AS INTEGER) AS admitted FROM events""",
    "forum_comments": """WITH cc AS (SELECT conv_id || ':' || turn AS post_id, role, turn, conv_id,
  trim(trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g')) || ' more') AS content FROM conversations)
SELECT sha1(post_id || '|' || role || '|2024-01-02 03:0' || (turn % 10) || ':00|' || content || '|0') AS comment_id, post_id, content, role AS author,
  CAST('2024-01-02 03:0' || (turn % 10) || ':00' AS TIMESTAMP) AS publish_time, CAST('1' || (conv_id % 10) AS INTEGER) AS like_count, CAST(NULL AS INTEGER) AS reply_count
FROM cc WHERE length(content) >= 2 UNION ALL
SELECT sha1(post_id || '|||Second ' || turn || '|2'), post_id, 'Second ' || turn, NULL, NULL, NULL, NULL FROM cc UNION ALL
SELECT sha1(post_id || '|||Third|3'), post_id, 'Third', NULL, NULL, NULL, NULL FROM cc""",
    "lookback_refresh": ov.with_(ov.BARS) + """SELECT trade_date, index_code, round(open, 9) AS open,
  round(CASE WHEN trade_date > (SELECT max(trade_date) FROM bars) - 15 THEN close + 1 ELSE close END, 9) AS close FROM bars""",
    "date_spine": ov.with_(ov.BARS) + f""", tb AS (SELECT trade_date FROM bars WHERE index_code = '{fx.TARGET}')
SELECT CAST(d AS DATE) AS trade_date FROM (SELECT unnest(generate_series((SELECT min(trade_date) FROM tb), (SELECT max(trade_date) FROM tb), INTERVAL 1 DAY)) AS d)
WHERE CAST(d AS DATE) NOT IN (SELECT trade_date FROM tb)""",
    "similar_dates": "WITH " + SIM.strip(),
    "similar_summary": SIMSUM,
    "similar_every_date": ov.with_(ov.ROLLING).rstrip() + f""",
sd AS (SELECT trade_date, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _sf)} FROM rolling
  WHERE index_code = '{fx.TARGET}' AND coalesce({', '.join(_sf)}) IS NOT NULL),
ss AS (SELECT *, {', '.join(f'avg({n}) OVER w AS m_{n}, stddev_pop({n}) OVER w AS s_{n}' for n in _sf)} FROM sd WINDOW w AS (ORDER BY trade_date)),
pr AS (SELECT d.trade_date, h.trade_date AS similar_date, list_cosine_similarity(
    [{', '.join(f'coalesce((h.{n} - m_{n}) / nullif(s_{n}, 0), 0)' for n in _sf)}],
    [{', '.join(f'coalesce((d.{n} - m_{n}) / nullif(s_{n}, 0), 0)' for n in _sf)}]) AS similarity
  FROM ss d JOIN sd h ON h.trade_date < d.trade_date),
rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(CASE WHEN isnan(similarity) THEN 0 ELSE coalesce(similarity, 0) END, 12) DESC, similar_date) AS rank FROM pr)
SELECT trade_date, CAST(rank AS INTEGER) AS rank, similar_date, round(CASE WHEN isnan(similarity) THEN 0 ELSE coalesce(similarity, 0) END, 6) AS similarity FROM rk WHERE rank <= 20""",
    "model_dataset": ALL_VIEWS + " SELECT w.trade_date, w.index_code, "
    + ", ".join(f"round(CAST(w.{n} AS DOUBLE), 6) AS f_{n}" for n in MARKET_FEATURES) + ", "
    + ", ".join(f"round(v.{n}, 6) AS f_{n}" for n in event_features() + rolled_event_features()) + ", "
    + ", ".join(f"round(w.future_ret_{h}d, 6) AS future_ret_{h}d" for h in (3, 5, 7)) + ", "
    + ", ".join(f"{EQ.label_sql(f'w.future_ret_{h}d', 'w.volatility_20d', h)} AS label_{h}d" for h in (3, 5, 7))
    + ", CAST(w.future_ret_7d > 0.005::DOUBLE AS INTEGER) AS buy_label_7d, CAST(w.future_ret_7d < 0 AS INTEGER) AS short_label_7d"
    + " FROM wide w JOIN evr v USING (trade_date, index_code)",
    "report_recent": "WITH " + SIGNALS + f""" SELECT CAST(trade_date AS VARCHAR) AS trade_date, {_name('causal_regime', L.REGIME_NAMES)} AS regime_text, causal_regime AS regime_class,
  printf('%.4f', buy_proba) AS buy_proba, printf('%.2f', buy_threshold) AS buy_threshold, direction, {_name('direction', L.DIRECTION_NAMES)} AS direction_text,
  {_pct('future_ret_7d')} AS future_ret_7d, {_OUT} AS outcome FROM (SELECT * FROM sg ORDER BY trade_date DESC LIMIT 30) t""",
    "report_latest": "WITH " + SIGNALS + f""" SELECT CAST(trade_date AS VARCHAR) AS trade_date, horizon, direction, {_name('direction', L.DIRECTION_NAMES)} AS direction_text,
  {_name('causal_regime', L.REGIME_NAMES)} AS regime_text, printf('%.4f', buy_proba) AS buy_proba, printf('%.2f', buy_threshold) AS buy_threshold FROM (SELECT * FROM sg ORDER BY trade_date DESC LIMIT 1) t""",
    "report_realized": "WITH " + SIGNALS + f""" SELECT count(*) AS realized_long_count, {r9('avg(CAST(future_ret_7d > 0.005::DOUBLE AS INTEGER))', 'precision')}, {r9('avg(future_ret_7d)', 'avg_future_ret')},
  {_pct('avg(CAST(future_ret_7d > 0.005::DOUBLE AS INTEGER))')} AS precision_text, {_pct('avg(future_ret_7d)')} AS avg_future_ret_text FROM sg WHERE direction = 'long' AND future_ret_7d IS NOT NULL""",
    "report_prices": "WITH " + SIGNALS + f""", lg AS (SELECT * FROM sg WHERE direction = 'long')
SELECT b.trade_date, round(b.close, 6) AS close, lg.direction, round(lg.buy_proba, 6) AS buy_proba FROM bars b LEFT JOIN lg USING (trade_date)
WHERE b.index_code = '{fx.TARGET}' AND b.trade_date BETWEEN (SELECT min(trade_date) FROM lg) AND (SELECT max(trade_date) FROM lg)""",
    "forum_status": "WITH " + POSTS.strip() + """ SELECT count(*) AS cnt, min(publish_time) AS min_time, max(publish_time) AS max_time, count(DISTINCT trade_date) AS trade_days,
  CAST(sum(CASE WHEN url NOT LIKE '%/news,click,%' THEN 1 ELSE 0 END) AS BIGINT) AS dirty,
  (SELECT count(*) FROM (SELECT url FROM posts WHERE bar_name = 'click' GROUP BY url HAVING count(*) > 1)) AS duplicate_url_count FROM posts WHERE bar_name = 'click'""",
    "forum_edge_days": "WITH " + POSTS.strip() + """, d AS (SELECT trade_date, count(*) AS cnt FROM posts WHERE bar_name = 'click' GROUP BY trade_date)
SELECT *, 'newest' AS edge FROM (SELECT * FROM d ORDER BY trade_date DESC LIMIT 15) UNION ALL SELECT *, 'oldest' FROM (SELECT * FROM d ORDER BY trade_date LIMIT 15)""",
    "comment_status": "WITH " + COMMENTS.strip() + " SELECT count(*) AS comment_cnt, count(DISTINCT post_id) AS commented_posts, min(publish_time) AS min_time, max(publish_time) AS max_time, count(DISTINCT trade_date) AS trade_days FROM comments WHERE bar_name = 'click'",
    "cleanup_audit": "WITH " + POSTS.strip() + " SELECT count(*) AS cnt, min(publish_time) AS min_time, max(publish_time) AS max_time, CAST(0 AS BIGINT) AS dirty FROM posts WHERE bar_name = 'click' AND url LIKE '%/news,click,%'",
    "news_status": "WITH " + NEWS.strip() + " SELECT count(*) AS cnt, CAST(min(trade_date) AS TIMESTAMP) AS min_time, CAST(max(trade_date) AS TIMESTAMP) AS max_time, count(DISTINCT trade_date) AS trade_days FROM news",
    "news_by_source": "WITH " + NEWS.strip() + " SELECT source, count(*) AS cnt, CAST(min(trade_date) AS TIMESTAMP) AS min_time, CAST(max(trade_date) AS TIMESTAMP) AS max_time FROM news GROUP BY source",
    "news_latest": "WITH " + NEWS.strip() + " SELECT news_id, source, trade_date FROM news ORDER BY trade_date DESC, news_id LIMIT 15",
    "return_bands": "WITH " + EQ.three().strip() + """ SELECT trade_date, index_code, round(pred_ret - greatest(abs(pred_ret) * 0.5::DOUBLE, 0.005::DOUBLE), 6) AS return_low,
  round(pred_ret + greatest(abs(pred_ret) * 0.5::DOUBLE, 0.005::DOUBLE), 6) AS return_high,
  round((coalesce(ret_5d, 0) + coalesce(ma20_gap, 0) + pred_ret) / (CAST(ret_5d IS NOT NULL AS INTEGER) + CAST(ma20_gap IS NOT NULL AS INTEGER) + 1), 6) AS tech_score FROM three""",
    "lenient_numbers": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN round(CAST('1' || CAST(value AS VARCHAR) AS DOUBLE), 6) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS as_number,
  CASE WHEN event_id % 5 IN (3, 4) THEN CAST(event_id AS INTEGER) END AS as_int FROM events""",
}
