"""Selection, ranking, upsert and text operators against brute force."""

import datetime as dt
import json
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import labels as L
from barloom.functions import text as T
from barloom.operators import ranking, selection, upsert
from barloom.operators.similar import similar_vectors
from barloom.plans import events as EV
from barloom.plans import reports as R
from barloom.sources import bars as B
from barloom.sources import forum as FO
from barloom.sources import news as NW
from barloom.sources import tables as TB
from barloom.streaming.refresh import look_back


def test_non_overlapping_is_greedy_and_maximal(spark):
    rnd = random.Random(1)
    rows = [(f"c{k}", y, p, f"x{p}") for k in range(4) for y in (2000, 2001)
            for p in sorted(rnd.sample(range(250), 90))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "code string, year int, trade_pos int, tag string")
    got = selection.non_overlapping(df, ["code", "year"], 7).collect()
    for key in {(r[0], r[1]) for r in rows}:
        want, nxt = [], -1
        for p in sorted(r[2] for r in rows if (r[0], r[1]) == key):
            if p >= nxt:
                want.append(p)
                nxt = p + 7
        mine = sorted(r.trade_pos for r in got if (r.code, r.year) == key)
        assert mine == want
        assert all(b - a >= 7 for a, b in zip(mine, mine[1:]))
    assert all(r.tag == f"x{r.trade_pos}" for r in got)


def test_purge_drops_short_slices(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(10)] + [("b", dt.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "code string, trade_date date")
    got = selection.purge_tail(df, 7, ["code"])
    assert {r[0]: r[1] for r in got.groupBy("code").count().collect()} == {"a": 3}


def test_duplicate_output_keys_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        selection.assert_unique(df, ["k"])


@pytest.mark.parametrize("buckets", [4, 128])
def test_median_and_ranks_with_a_hot_group_and_ties(spark, buckets):
    r = np.random.default_rng(0)
    frames = [pd.DataFrame({"g": "hot", "v": np.round(r.normal(0, 1, 4000), 2)}),
              pd.DataFrame({"g": "same", "v": np.full(50, 1.5)}),
              pd.DataFrame({"g": "one", "v": [3.0]}), pd.DataFrame({"g": "two", "v": [1.0, 2.0]}),
              pd.DataFrame({"g": "heavy", "v": np.concatenate([np.exp(r.normal(0, 8, 501)), [np.nan]])})]
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, v double")
    got = {x.g: x.m for x in ranking.grouped_median(df, ["g"], "v", "m", buckets).collect()}
    want = pdf.groupby("g").v.median()
    assert set(got) == set(want.index)
    for g in got:
        assert got[g] == pytest.approx(want[g], rel=1e-12)
    ranks = ranking.average_ranks(df, ["g"], "v", "r", buckets).toPandas()
    pdf = pdf.dropna().copy()
    pdf["r"] = pdf.groupby("g").v.rank()
    want = pdf.drop_duplicates(["g", "v"]).set_index(["g", "v"]).r
    assert len(ranks) == len(want)
    for x in ranks.itertuples():
        assert x.r == want[(x.g, x.v)]


def test_medians_stay_exact_where_cuts_come_out_otherwise_each_time(spark, monkeypatch):
    """On a cluster partial results are merged in any order, and with it the approximate cuts vary."""
    r = np.random.default_rng(3)
    pdf = pd.concat([pd.DataFrame({"g": g, "v": r.normal(0, 1, n)}) for g, n in (("many", 1500), ("odd", 701), ("one", 1))])
    counts = spark.createDataFrame(pdf).groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n"))
    approx = F.percentile_approx
    moved = F.udf(lambda cuts: [x + random.SystemRandom().uniform(-0.1, 0.1) for x in cuts], "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda *args: moved(approx(*args)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        placed = ranking.bucketed_by(counts, ["g"], "v")
        got = {x.g: x.m for x in ranking.median_of_counts(placed, ["g"], "v", "m").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == pdf.groupby("g").v.median().to_dict()


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_rules(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, kept string, v double")
    batch = spark.createDataFrame([(2, 5.0, 0, 1), (2, None, 9, 2), (3, float("nan"), 7, 1)],
                                  "k int, v double, extra int, ord int")
    got = upsert.upsert(base, batch, ["k"], "ord")
    assert got.columns == ["k", "kept", "v", "extra"]
    assert {r.k: (r.kept, r.v, r.extra) for r in got.collect()} == {
        1: ("a", 1.0, None), 2: ("b", None, 9), 3: (None, None, 7)}


def test_upsert_keeps_immutable_columns_of_known_keys(spark):
    base = spark.createDataFrame([("n1", "old", 1.0)], "source_ids string, event_name string, event_score double") \
        .withColumn("trade_date", F.lit("2020-01-01").cast("date"))
    batch = spark.createDataFrame([("n1", "new", 2.0), ("n2", "new", 3.0)],
                                  "source_ids string, event_name string, event_score double") \
        .withColumn("trade_date", F.lit("2021-01-01").cast("date"))
    got = {r.source_ids: (r.event_name, r.event_score, r.trade_date.year)
           for r in upsert.upsert(base, batch, **EV.EVENT_UPSERT).collect()}
    assert got == {"n1": ("old", 2.0, 2020), "n2": ("new", 3.0, 2021)}


def test_upsert_table_is_idempotent_and_touches_only_its_years(spark):
    path = tempfile.mkdtemp(prefix="barloom-t-") + "/table"
    first = spark.createDataFrame([(dt.date(y, 5, 1), "a", float(y)) for y in (2019, 2020, 2021)],
                                  "trade_date date, index_code string, close double")
    keys = ["trade_date", "index_code"]
    assert upsert.upsert_table(path, first, keys) == 3
    batch = spark.createDataFrame([(dt.date(2020, 5, 1), "a", 7.0), (dt.date(2020, 6, 1), "a", 8.0)], first.schema)
    for _ in range(2):
        assert upsert.upsert_table(path, batch, keys) == 2
        got = spark.read.parquet(path)
        assert _rows(got, "trade_date", "close") == [
            (dt.date(2019, 5, 1), 2019.0), (dt.date(2020, 5, 1), 7.0), (dt.date(2020, 6, 1), 8.0),
            (dt.date(2021, 5, 1), 2021.0)]


def test_upsert_table_with_a_key_without_date(spark):
    path = tempfile.mkdtemp(prefix="barloom-t-") + "/table"
    schema = "source_ids string, trade_date date, v int"
    upsert.upsert_table(path, spark.createDataFrame([("a", dt.date(2019, 1, 1), 1)], schema), ["source_ids"])
    upsert.upsert_table(path, spark.createDataFrame([("a", dt.date(2021, 1, 1), 2)], schema), ["source_ids"])
    assert _rows(spark.read.parquet(path), "source_ids", "v") == [("a", 2)]


def test_null_news_ids_qualify_only_without_events(spark):
    news = spark.createDataFrame([("a",), (None,)], "news_id string")
    none = spark.createDataFrame([], "source_ids string")
    some = spark.createDataFrame([("z",), (None,)], "source_ids string")
    assert upsert.not_yet_extracted(news, none).count() == 2
    assert [r[0] for r in upsert.not_yet_extracted(news, some).collect()] == ["a"]


def test_event_answers_edge_cases(spark):
    answers = {
        "fence": '```json\n{"event_name": "x", "impact_direction": "利多", "impact_strength": "9", '
                 '"expectation_level": "预期不足", "event_stage": "确认", "surprise_level": "不及预期", "reason": "r"}\n```',
        "zero": 'text {"impact_direction": "利空", "impact_strength": 0, "event_name": "y"} tail',
        "quoted": '{"impact_direction": "利多", "impact_strength": "3.7", "event_name": "q"}',
        "bare": '{"impact_direction": "利多", "impact_strength": 3.7, "event_name": "q"}',
        "word": '{"impact_direction": "利多", "impact_strength": "high", "event_name": "q"}',
        "broken": '{"impact_direction": "利多", ', "empty": "", "none": None, "list": "[1, 2]"}
    rows = spark.createDataFrame(list(answers.items()), "news_id string, response string")
    news = spark.createDataFrame([(k, "title " + k, '["kw"]', '["macro"]') for k in answers],
                                 "news_id string, title string, matched_keywords string, matched_groups string") \
        .withColumn("trade_date", F.lit("2020-01-01").cast("date"))
    got = {r.source_ids: r for r in EV.parse_event_answers(rows, news).collect()}
    assert len(got) == len(answers)
    assert got["fence"].event_score == pytest.approx(5 * 1.5 * -0.8) and got["fence"].impact_strength == 9
    assert got["zero"].event_score == -1.0 and got["zero"].impact_strength == 1
    assert got["quoted"].event_score == 1.0 and got["bare"].event_score == 3.0 and got["word"].event_score == 1.0
    for k in ("broken", "empty", "none", "list"):
        assert got[k].event_score == 0.0 and got[k].impact_direction == "中性"
        assert got[k].event_name == "title " + k and got[k].event_type == "其他"
    assert json.loads(got["zero"].llm_reason)["event_name"] == "y"


def test_keyword_groups_follow_configuration(spark):
    df = spark.createDataFrame([("央行降准，小盘与微盘活跃，AI",), ("",), (None,)], "t string")
    got = df.select(T.matched_keywords(F.col("t"), T.KEYWORD_GROUPS).alias("k"),
                    T.matched_groups(F.col("t"), T.KEYWORD_GROUPS).alias("g"),
                    T.keep_by_keywords(F.col("t"), T.KEYWORD_GROUPS).alias("keep"),
                    T.keep_by_keywords(F.col("t"), T.KEYWORD_GROUPS, "all").alias("all")).collect()
    assert got[0].k == sorted(["降准", "小盘", "微盘", "AI"])
    assert got[0].g == ["index_style", "liquidity", "growth_industry"]
    assert [r.keep for r in got] == [True, False, False] and all(r["all"] for r in got)
    assert T.keyword_groups(None, ["x"]) == {"legacy": ["x"]}
    assert sum(len(v) for v in T.KEYWORD_GROUPS.values()) == 45


def test_json_list(spark):
    values = ['["a", "", "b"]', "[]", "not json", '{"a": 1}', None, "[1, 2]"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(T.json_list(F.col("v"))).collect()] == [
        ["a", "b"], [], [], [], [], ["1", "2"]]


def test_emotion_stage_order(spark):
    rows = [(None, 1.0, 0.9, L.COLD), (2.5, 0.1, 0.0, L.CLIMAX), (2.5, None, 0.0, L.FERMENT),
            (0.9, 0.0, 0.5, L.SPLIT), (0.5, -0.3, 0.1, L.EBB), (0.5, None, None, L.WARM), (-1.0, 0.0, 0.1, L.COLD)]
    df = spark.createDataFrame(rows, "z double, c double, d double, want string")
    assert all(r[0] == r[1] for r in df.select(L.emotion_stage(F.col("z"), F.col("c"), F.col("d")), "want").collect())


def test_list_page_posts(spark):
    html = """<table><tr><td class="read">1,234</td><td class="reply">56</td><td class="title">
      <a href="/news,zssh000852,111.html">First &amp; best</a></td></tr>
      <tr><td><a href="//guba.eastmoney.com/news,of510300,9.html">other board</a></td></tr></table>
      <div><a href="https://guba.eastmoney.com/news,zssh000852,222.html">Loose <b>link</b></a>
      <a href="/news,zssh000852,111.html">Again</a><a href="/about">no post</a></div>"""
    df = spark.createDataFrame([(1, "b", "https://guba.eastmoney.com/list,zssh000852_2.html", html)],
                               "page_id int, bar_name string, url string, html string")
    got = {r.post_id: r for r in FO.list_page_posts(df).collect()}
    assert set(got) == {"zssh000852:111", "zssh000852:222"}
    assert got["zssh000852:111"].title == "Again" and got["zssh000852:111"].read_count is None
    assert got["zssh000852:222"].title == "Loose link"
    once = df.withColumn("html", F.substring("html", 1, html.index("</table>") + 8))
    first = FO.list_page_posts(once).first()
    assert (first.title, first.read_count, first.comment_count) == ("First & best", 1234, 56)


def test_post_admission(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 3), ("b", None, 5), ("c", "2020-01-01", None)],
                               "post_id string, publish_time string, comment_count int")
    assert _rows(FO.admitted_posts(df), "post_id") == [("a",), ("c",)]
    assert _rows(FO.commented_posts(df), "post_id") == [("a",), ("b",)]


def test_news_normalisers(spark):
    raw = spark.createDataFrame([("  降息公告 ", None, "u1"), ("", "降息", "u2"), ("无关", "无关", "u3")],
                                "`标题` string, `内容` string, `链接` string") \
        .withColumn("trade_date", F.lit("2020-02-03").cast("date"))
    got = NW.normalize_transcripts(raw).collect()
    assert [(r.title, r.content, r.url, r.matched_groups) for r in got] == [("降息公告", "降息公告", "u1", '["liquidity"]')]
    assert NW.normalize_transcripts(raw, mode="all").count() == 2
    cal = spark.createDataFrame([("美国CPI", "3.1", None)], "`事件` string, actual string, forecast string") \
        .withColumn("trade_date", F.lit("2020-02-03").cast("date"))
    row = NW.normalize_calendar(cal).first()
    assert row.content == "美国CPI | 3.1" and row.matched_groups == '["macro"]' and row.url == NW.CALENDAR_URL


def test_bar_sources(spark):
    raw = spark.createDataFrame([("20200102", "10", "11", "9", "10.5", "bad"), ("2020-01-03", "10", "12", "9", "21", "7")],
                                "`日期` string, `开盘` string, `最高` string, `最低` string, `收盘` string, `成交量` string") \
        .withColumn("index_code", F.lit("399006"))
    got = B.normalize_index_bars(raw).orderBy("trade_date").collect()
    assert got[0].pre_close is None and got[0].volume is None and got[1].pct_chg == pytest.approx(100.0)
    with pytest.raises(ValueError):
        B.normalize_index_bars(raw.drop("收盘"))
    dim = B.instruments(spark)
    named = B.with_instrument(B.normalize_index_bars(raw), dim.filter("kind = 'index'")).first()
    assert named.instrument_name == "创业板指" and dim.count() == 17
    assert FO.boards(spark, "中证1000").count() == 1 and FO.boards(spark).count() == 5
    assert B.date_spine(spark, "2020-02-27", "2020-03-02").count() == 5


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 2020, 7, 0.01, 0.7)],
                               "trade_date date, test_year int, horizon int, future_ret double, buy_proba double")
    TB.write_report(df, str(tmp_path / "csv"))
    schema = "trade_date date, test_year int, horizon int, future_ret double, buy_proba double"
    got = TB.read_details(spark, str(tmp_path / "csv"), schema, ["trade_date", "buy_proba"])
    assert got.collect() == df.collect()
    with pytest.raises(ValueError):
        TB.read_details(spark, str(tmp_path / "csv"), schema, ["missing_column"])
    df.write.parquet(str(tmp_path / "t"))
    assert TB.read_table(spark, str(tmp_path / "t"), test_year=2020, horizon=(5, None)).count() == 1
    assert TB.read_table(spark, str(tmp_path / "t"), horizon=[3, 5]).count() == 0
    assert TB.add_missing_columns(df, df.withColumn("more", F.lit(1))).columns[-1] == "more"


def test_outcome_texts(spark):
    rows = [("long", None, L.PENDING), ("neutral", 0.1, L.NOT_LONG), ("long", 0.006, L.HIT),
            ("long", 0.005, L.SHORT_OF_TARGET), ("long", 0.0, L.MISS)]
    df = spark.createDataFrame(rows, "d string, r double, want string")
    assert all(a == b for a, b in df.select(L.outcome_text(F.col("d"), F.col("r")), "want").collect())


def test_similar_vectors_without_current_row_is_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "id int, v array<double>")
    none = similar_vectors(df, "v", 2, F.col("id") == 9, F.col("id") < 9)
    assert none.count() == 0


def test_look_back_window(spark):
    df = B.date_spine(spark, "2020-01-01", "2020-02-29")
    got = look_back(df, "2020-02-20", 15)
    assert got.count() == 15 and got.agg(F.min("trade_date")).first()[0] == dt.date(2020, 2, 6)


def test_edge_days(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i % 20),) for i in range(40)], "trade_date date")
    assert R.edge_days(df, 15).count() == 15


def test_dataset_joins_and_defaults(spark):
    from barloom.plans import dataset as D
    from barloom.plans.market import market_features
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    bars = spark.createDataFrame([(d, code, 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0, 1.0)
                                  for code in ("t", "x") for i, d in enumerate(days)],
                                 "trade_date date, index_code string, open double, high double, low double, "
                                 "close double, volume double, amount double")
    feats = market_features(bars, "t", {"relative_hs300": "x", "relative_zz500": "x", "relative_cyb": "x"})
    news = spark.createDataFrame([("n1", '["macro"]'), ("n2", None)], "news_id string, matched_groups string")
    events = spark.createDataFrame([(days[2], 2.0, 3, "n1"), (days[2], -1.0, None, "n2"), (days[2], None, 9, "gone"),
                                    (dt.date(2021, 1, 1), 5.0, 5, "n1")],
                                   "trade_date date, event_score double, impact_strength int, source_ids string")
    mood = spark.createDataFrame([(days[1], "a", 1.0), (days[1], "b", 3.0)],
                                 "trade_date date, topic string, heat_score double") \
        .withColumns({n: F.lit(0.5) for n in ("heat_zscore_20d", "sentiment_score", "disagreement")})
    got = D.model_dataset(feats, bars, events, news, mood, index_code="t")
    rows = {r.trade_date: r for r in got.collect()}
    assert len(rows) == 12 and {r.index_code for r in rows.values()} == {"t"}
    day = rows[days[2]]
    assert day.f_event_score == pytest.approx(1 / 3) and day.f_event_count == 3
    assert day.f_event_macro_score == 2.0 and day.f_event_macro_count == 1 and day.f_event_max_strength == 9.0
    assert day.f_event_liquidity_score == 0.0 and rows[days[4]].f_event_score_roll_3d == pytest.approx(1 / 3)
    assert rows[days[5]].f_event_score_roll_3d == 0.0 and rows[days[11]].f_event_macro_max_strength_roll_10d == 3.0
    assert rows[days[1]].f_heat_score == 2.0 and rows[days[3]].f_heat_score is None
    assert rows[days[4]].future_ret_7d == pytest.approx(21.5 / 14.5 - 1) and rows[days[5]].buy_label_7d is None
    assert rows[days[0]].label_3d == L.UP and rows[days[0]].short_label_7d == 0
    # carrying the close along gives the same rows without the join
    kept = market_features(bars, "t", {"relative_hs300": "x", "relative_zz500": "x", "relative_cyb": "x"},
                           keep_close=True)
    again = D.model_dataset(kept, bars, events, news, mood, index_code="t")
    assert sorted(again.collect()) == sorted(got.collect())
    plain = D.model_dataset(feats, bars, None, None).first()
    assert plain.f_event_count == 0.0 and plain.f_event_macro_score_roll_10d == 0.0
    assert D.without_forum(D.feature_columns(got)) == D.feature_columns(D.model_dataset(feats, bars, events, news))


def test_json_pack_keeps_unknown_values(spark):
    from barloom.plans import dataset as D
    df = spark.createDataFrame([(1, None, 2.5)], "k int, f_a double, f_b double")
    doc = D.pack_features(df).first().feature_json
    assert json.loads(doc) == {"a": None, "b": 2.5}
    back = D.unpack_features(spark.createDataFrame([(1, doc), (2, None)], "k int, feature_json string"), ["a", "b"])
    assert [(r.f_a, r.f_b) for r in back.orderBy("k").collect()] == [(None, 2.5), (None, None)]


def test_hot_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    for got in (upsert.head_per_group(df, ["g"], 2, F.col("v").asc()), upsert.latest_per_key(df, ["g"], F.col("v"))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan


def test_page_comments(spark):
    html = """<body><ul class="comment-list"><li><span class="author">Ann</span> hello world 2024-03-04 05:06:07 赞 3</li>
      <li class="odd">hello again 12-31 23:59 reply 4</li><li>x</li></ul>
      <div class="replyItem"><div class="reply_content">hello again</div></div>
      <div class="comment_item"><div class="comment_content">deep <b>text</b></div> like: 7</div><footer>like 99</footer></body>"""
    df = spark.createDataFrame([("p", "b", "u", html)], "post_id string, bar_name string, url string, html string")
    got = {r.content: r for r in FO.page_comments(df, 2023).collect()}
    assert set(got) == {"Ann hello world 2024-03-04 05:06:07 赞 3", "hello again 12-31 23:59 reply 4",
                        "hello again", "deep text"}
    first = got["Ann hello world 2024-03-04 05:06:07 赞 3"]
    assert (first.author, first.publish_time, first.like_count) == ("Ann", dt.datetime(2024, 3, 4, 5, 6, 7), 3)
    second = got["hello again 12-31 23:59 reply 4"]
    assert second.publish_time == dt.datetime(2023, 12, 31, 23, 59) and second.reply_count == 4
    assert got["deep text"].like_count == 7 and got["deep text"].trade_date is None


def test_nested_markup_is_read_whole(spark):
    detail = "<div class=x>no</div><div class='newstext'><div>first</div><div>second<br></div><p>third</p></div><div>after</div>"
    frame = spark.createDataFrame([(1, detail), (2, "<div class='article-body'>open <div>end"), (3, "none"), (4, None)],
                                  "k int, html string")
    got = {r.k: r.t for r in frame.select("k", FO.class_text(F.col("html"), "newstext", "article-body").alias("t")).collect()}
    assert got == {1: "first second third", 2: "open end", 3: None, 4: None}
    html = """<ul class="comment-list"><li>one part1 <ul><li>inner</li></ul> tail 2024-01-01 10:00</li><li>second comment</li></ul>
      <p>no</p><ul class=reply-list><li><a href="//i.eastmoney.com/3">Bo</a> third &amp; last</li></ul><div>out</div>"""
    page = spark.createDataFrame([("p", "b", "u", html), ("q", "b", "u", None)], "post_id string, bar_name string, url string, html string")
    rows = {r.content: r for r in FO.page_comments(page, 2024).collect()}
    assert set(rows) == {"one part1 inner tail 2024-01-01 10:00", "inner", "second comment", "Bo third & last"}
    assert rows["Bo third & last"].author == "Bo" and rows["second comment"].publish_time is None


def test_anchor_targets(spark):
    html = ("<a href=/a.html>bare</a><a href=\"/it's\">apostrophe</a><a href='/x?a=1&amp;b=\"2\"'>entity</a><a name=n>none</a>"
            "<a data-href='/no' href = /spaced >spaced</a><abbr href=/no>x</abbr><A HREF=/b/>slash</A>")
    frame = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    from barloom.sources import news as NW
    assert [(r.href, r.text) for r in NW.page_links(frame).orderBy("pos").collect()] == [
        ("/a.html", "bare"), ("/it's", "apostrophe"), ('/x?a=1&b="2"', "entity"), ("/spaced", "spaced"), ("/b/", "slash")]


def test_anchors_of_real_pages(spark):
    pages = ["<a title=it's href=/q>text one</a> <a href='/z'>text two</a>",
             "<a " + "attribute " * 100_000 + "href=/q>text one</a>",
             "<a " * 300_000 + "<a href=/q>text one</a>",
             "<a href=/q>text one" + " <a href=/z>open" * 3,
             "<a x='href=/no' data-href=/no href = \"/q\">text <i title='>'>one</i></a></A>",
             "<a href=/q?a=1&amp;b='2'>text 1 < 2</a>", "<a href=''>none</a><a href>none</a><abbr href=/no>none</abbr>",
             "<a href='/q>never closed</a>", None]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").withColumn("url", F.lit("u"))
    got = {}
    for r in NW.page_links(frame).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.href, r.text))
    assert got == {0: [("/q", "text one"), ("/z", "text two")], 1: [("/q", "text one")], 2: [("/q", "text one")],
                   3: [("/q", "text one")] + [("/z", "open")] * 3, 4: [("/q", "text one")], 5: [("/q?a=1&b='2'", "text 1 < 2")]}


def test_unclosed_markup_is_read_in_linear_memory(spark):
    from barloom.sources.markup import comment_nodes
    page = "<ul class=comment-list>" + "".join(f"<li>item {k}" for k in range(100_000)) + "</ul><p>after"
    nodes = comment_nodes(page)
    assert len(nodes) == 100_000 and nodes[7]["text"] == "item 7" and nodes[-1]["text"] == "item 99999"
    deep = "<b>" * 100_000 + "<div class=reply_item>kept<em>" + "</i>" * 100_000
    assert [n["text"] for n in comment_nodes(deep)] == ["kept"]
    frame = spark.createDataFrame([("<div " * 200_000 + "<div class='x newstext'>a<p>b</div>c",), ("<div x='class=newstext'>no</div>",)],
                                  "html string")
    assert [r[0] for r in frame.select(FO.class_text(F.col("html"), "newstext")).collect()] == ["a b", None]


def test_similar_dates_of_every_date(spark):
    from barloom.operators.similar import similar_dates, similar_to_every_date
    rng = np.random.default_rng(5)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=int(i)), None if rng.random() < 0.1 else float(rng.normal()),
             None if i < 30 else float(rng.normal(5, 2)), 1.0) for k in ("a", "b") for i in range(60)]
    frame = spark.createDataFrame(rows, "index_code string, trade_date date, x double, y double, z double")
    got = {}
    for r in similar_to_every_date(frame, ["x", "y", "z"], 4, block=7).orderBy("index_code", "trade_date", "rank").collect():
        got.setdefault((r.index_code, r.trade_date), []).append((r.similar_date, round(r.similarity, 9)))
    for day in (2, 25, 31, 59):
        date = dt.date(2020, 1, 1) + dt.timedelta(days=day)
        want = similar_dates(frame, str(date), ["x", "y", "z"], 4, code="b").collect()
        assert got["b", date] == [(r.trade_date, round(r.similarity, 9)) for r in want]
    assert ("a", dt.date(2020, 1, 1)) not in got and similar_to_every_date(frame.filter("false"), ["x"], 4).count() == 0
