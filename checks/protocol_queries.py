"""Scans, sinks, keyed tables, dataset joins and the parts of the model protocol that SQL can decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import schemas as S
from barloom.functions import labels as L
from barloom.operators import selection as sel
from barloom.operators import upsert as up
from barloom.operators.recurrence import average_state, exponential_averages
from barloom.plans import dataset as D
from barloom.plans import evaluation as E
from barloom.plans import market as M
from barloom.plans import modeling as MD
from barloom.plans import reports as R
from barloom.sources import bars as B
from barloom.sources import forum as FO
from barloom.sources import tables as T
from checks import evaluation_queries as EQ
from checks import fixtures as fx
from checks import oracle_views as ov
from checks import text_queries as TQ
from checks.evaluation_queries import r9, rounded
from checks.fixtures import scratch

c = F.col
MOVED_DAYS = 9131
AVERAGES = [("expma12", "close", {"span": 12}), ("ema26", "close", {"span": 26}), ("macd_signal", "macd", {"span": 9}),
            ("expma50", "close", {"span": 50})]
MACD = [("macd", "expma12", "ema26")]
NAMES = [("index", "1", "One", "large"), ("index", "2", "Two", "small"), ("index", "9", "Nine", "none")]


def table_scan(spark, sf_dir):
    """A stored table read back between two dates, for listed codes."""
    path = scratch(spark, "scan")
    fx.bars(spark, sf_dir).write.parquet(path)
    df = T.read_table(spark, path, None, trade_date=("1996-02-01", "1998-03-31"), index_code=["1", "3"])
    return rounded(df.select("trade_date", "index_code", "close"), 6)


def instrument_names(spark, sf_dir):
    df = B.with_instrument(fx.bars(spark, sf_dir), B.instruments(spark, NAMES))
    return df.select("trade_date", "index_code", "instrument_name", "instrument_category")


def report_csv(spark, sf_dir):
    """Details written as a report and read back with their types."""
    path = scratch(spark, "report")
    T.write_report(fx.scores(spark, sf_dir).select("trade_date", "index_code", "test_year", "buy_proba"), path)
    return T.read_details(spark, path, "trade_date date,index_code string,test_year int,buy_proba double", ["buy_proba"])


def manifest_order(spark, sf_dir):
    """The frozen input list, all of it columns of the dataset, with positions."""
    data = TQ._dataset(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(k + 1).alias("position"), F.lit(n).alias("feature"))
                     for k, n in enumerate(D.select_manifest(data))])
    return data.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.inline(rows))


def usable_columns(spark, sf_dir):
    """Features of each year that have a value, without the forum columns."""
    df = _features(spark, sf_dir)
    names = D.without_forum([n for n in df.columns if n.startswith("f_")])
    years = [r[0] for r in df.select(F.year("trade_date")).distinct().orderBy(F.year("trade_date")).limit(200).collect()]
    rows = [(y, n) for y in years for n in D.usable_features(df.filter(F.year("trade_date") == y), names)]
    return spark.createDataFrame(rows, "year int, feature string")


def _features(spark, sf_dir):
    feats = M.rolling_features(fx.bars(spark, sf_dir)).filter(c("index_code") == fx.TARGET).select(
        "trade_date", c("ret_1d").alias("f_ret_1d"), c("ma60_slope_10d").alias("f_ma60_slope_10d"))
    late = F.year("trade_date") >= 1999
    return feats.withColumns({"f_late": F.when(late, c("f_ret_1d")), "f_heat_score": F.lit(1.0)})


def filled_features(spark, sf_dir):
    """Labelled rows with absent model inputs added as 0."""
    df = fx.scores(spark, sf_dir).select("trade_date", "index_code", c("future_ret").alias("future_ret_7d"),
                                         F.when(c("trade_pos") % 3 != 0, c("buy_label")).alias("buy_label_7d"),
                                         c("ret_5d").alias("f_ret_5d"))
    return rounded(D.fill_missing_features(MD.labelled(df, 7, "buy_label_7d"), ["f_ret_5d", "f_absent"]))


def unique_output(spark, sf_dir):
    return rounded(sel.assert_unique(fx.bars(spark, sf_dir), ["trade_date", "index_code"]).select(
        "trade_date", "index_code", "close"))


def _panel(spark, sf_dir):
    return fx.late_series(fx.scores(spark, sf_dir).select("trade_date", "index_code", "test_year", "buy_label", "future_ret"))


def fold_years(spark, sf_dir):
    """Training rows, their last date and test rows of every walk-forward year of an uneven panel."""
    return MD.fold_table(_panel(spark, sf_dir), list(range(1992, 2003)), 7, "1995-01-01")


def class_weights(spark, sf_dir):
    """Balanced weights of the buy label in the training rows of the test year 2000."""
    train, _ = MD.fold_rows(_panel(spark, sf_dir), 2000, 7, "1995-01-01", ["index_code"])
    weight = MD.balanced_weight("buy_label", MD.label_counts(train, "buy_label"))
    return rounded(train.groupBy("buy_label").agg(F.count(F.lit(1)).alias("n"), F.avg(weight).alias("weight")))


def dataset_join(spark, sf_dir):
    """Stored features joined with the bars for their forward returns and labels."""
    bars = fx.bars(spark, sf_dir)
    feats = M.market_features(bars, fx.TARGET, fx.BENCHMARKS)
    df = D.model_dataset(feats, bars, None, None)
    return rounded(df.select("trade_date", "index_code", "f_ret_1d", "f_event_count", "future_ret_7d", "buy_label_7d"), 6)


def dataset_sentiment(spark, sf_dir):
    """Daily sentiment columns of the dataset; days without posts stay unknown."""
    bars = fx.bars(spark, sf_dir)
    feats = M.market_features(bars, fx.TARGET, fx.BENCHMARKS, keep_close=True)
    # the posts' days moved into the years of the bars
    mood = TQ._sentiment(spark, sf_dir).withColumn("trade_date", F.date_sub("trade_date", MOVED_DAYS))
    df = D.model_dataset(feats, bars, None, None, mood, index_code=fx.TARGET)
    return rounded(df.select("trade_date", "f_heat_score", "f_sentiment_score"), 6)


def _versions(spark, sf_dir):
    s = TQ._signals(spark, sf_dir).withColumn("future_ret_7d", F.lit(None).cast("double"))
    kinds = F.array(*[F.lit(v) for v in ("v1", "v2")])
    return s.withColumn("model_version", F.explode(kinds))


def refresh_versions(spark, sf_dir):
    """Realised returns of one model version filled in, those of the other left as stored."""
    data = fx.scores(spark, sf_dir).select("trade_date", "index_code", c("future_ret").alias("future_ret_7d"))
    out = MD.refresh_realized(_versions(spark, sf_dir), data, fx.TARGET, "v1")
    return rounded(out.select("trade_date", "model_version", "future_ret_7d"), 6)


def class_positions(spark, sf_dir):
    """Position and class probabilities of the long and short label inferred in each split."""
    df = fx.three_class(spark, sf_dir).drop("up_proba", "short_label").withColumns({
        "split": F.when(F.year("trade_date") < 1999, "early").otherwise("late"), f"proba_{L.UP}": c("buy_proba"),
        f"proba_{L.DOWN}": c("short_proba"), f"proba_{L.FLAT}": 1 - c("buy_proba")})
    out = E.with_position(df, keys=["split"])
    return rounded(out.select("trade_date", "index_code", "split", "position", "long_label", "short_label", "long_proba",
                              "direction_proba", c("proba_" + L.DOWN).alias("down_proba")), 6)


def upsert_first_load(spark, sf_dir):
    """The first load of a table: NaN and infinity become NULL, the later of two rows of a key stays."""
    path = scratch(spark, "first-load")
    bars = fx.bars(spark, sf_dir).select("trade_date", "index_code", "open", "close").withColumn("load", F.lit(0))
    odd = F.dayofyear("trade_date") % 7
    bars = bars.withColumn("open", F.when(odd == 0, F.lit(float("nan"))).when(odd == 1, F.lit(float("inf"))).otherwise(c("open")))
    twice = bars.filter(F.dayofyear("trade_date") % 5 == 0).withColumns({"close": c("close") + 1, "load": F.lit(1)})
    for _ in range(2):
        up.upsert_table(path, bars.unionByName(twice), ["trade_date", "index_code"], "load")
    return rounded(spark.read.parquet(path).select("trade_date", "index_code", "open", "close"), 6)


def upsert_buckets(spark, sf_dir):
    """News by id: a first load, then new and changed rows that touch some of the buckets."""
    path = scratch(spark, "news-table")
    news = fx.news(spark, sf_dir).select("news_id", "doc_id", "source", "trade_date")
    up.upsert_table(path, news.filter(c("doc_id") % 3 != 0), ["news_id"], buckets=16)
    up.upsert_table(path, news.filter(c("doc_id") % 50 == 0).withColumn("source", F.lit("changed")), ["news_id"])
    return spark.read.parquet(path).select("news_id", "doc_id", "source", "trade_date")


def prediction_similar_days(spark, sf_dir):
    feats = M.rolling_features(fx.bars(spark, sf_dir))
    data = D.forward_returns(feats.select("trade_date", "index_code", "close", "ret_1d", "ret_5d", "ma20_gap",
                                          "volatility_20d"), [3, 5, 7])
    near = R.prediction_similar_days(data, "2000-06-15", ["ret_1d", "ret_5d", "ma20_gap", "volatility_20d"], fx.TARGET)
    return rounded(near.select("trade_date", "similarity"), 6)


def _predictions(spark, sf_dir):
    rows = fx.scores(spark, sf_dir).filter(c("index_code") == fx.TARGET)
    return rows.select("trade_date", "horizon", c("future_ret").alias("return_pred"), c("buy_proba").alias("confidence"))


def stored_predictions(spark, sf_dir):
    """Prediction reports in a keyed table: a second run overwrites its dates; the newest date is reported."""
    path, rows = scratch(spark, "predictions"), _predictions(spark, sf_dir)
    MD.store_predictions(path, rows)
    MD.store_predictions(path, rows.filter(F.year("trade_date") == 1999).withColumn("confidence", F.lit(0.5)))
    table = spark.read.parquet(path).select("trade_date", "horizon", "return_pred", "confidence")
    newest = R.prediction_report(table).select("trade_date", c("horizon").alias("newest"))
    return rounded(table.join(newest, "trade_date", "left"), 6)


def stored_signals(spark, sf_dir):
    """Signals of two model versions in one keyed table."""
    path, rows = scratch(spark, "signals"), _versions(spark, sf_dir).select("trade_date", "model_version", "horizon", "buy_proba")
    MD.store_signals(path, rows)
    MD.store_signals(path, rows.filter("model_version = 'v2'").withColumn("buy_proba", c("buy_proba") / 2))
    return rounded(spark.read.parquet(path).select("trade_date", "model_version", "horizon", "buy_proba"), 6)


def fold_medians(spark, sf_dir):
    """Imputation medians of every expanding fold of an uneven panel, columns with and without gaps."""
    rows = fx.late_series(fx.scores(spark, sf_dir).select("trade_date", "index_code", "ret_5d", "volatility_20d", "buy_proba"))
    return rounded(MD.fold_medians(rows, ["ret_5d", "volatility_20d", "buy_proba"], list(range(1994, 2003)), 7, "1995-01-01"))


def column_medians(spark, sf_dir):
    """Medians of single columns, as one fit imputes them."""
    found = MD.column_medians(fx.scores(spark, sf_dir), ["ret_5d", "ma20_gap", "volatility_20d", "buy_proba"])
    return rounded(spark.createDataFrame(sorted(found.items()), "feature string, median double"))


def calibrated_given(spark, sf_dir):
    """Raw, sigmoid (given curve) and isotonic probabilities, the steps learnt from the years before 2000."""
    rows = fx.scores(spark, sf_dir)
    oof = rows.filter("test_year < 2000").select(c("buy_proba").alias("raw"), c("buy_label").cast("double").alias("y"))
    _, isotonic = MD.fit_calibrators(oof)
    later = rows.filter("test_year >= 2000").select(
        "trade_date", "index_code", (c("buy_proba") * 0.97 + 0.004).alias("buy_proba"))
    return rounded(MD.calibrated(later, (1.5, -0.2), isotonic))


def board_choice(spark, sf_dir):
    """Boards written from the events, chosen by one topic."""
    ev = fx.table(spark, sf_dir, "events")
    boards = ev.groupBy(c("event_type").alias("bar_name"), (c("user_id") % 3).cast("string").alias("topic")).agg(
        F.count(F.lit(1)).alias("posts"))
    return FO.select_boards(boards, "1")


def fit_guards(spark, sf_dir):
    """Whether the training rows of each year allow a fit: enough rows of both labels."""
    panel = _panel(spark, sf_dir)
    out = []
    for year in range(1994, 2003):
        train, _ = MD.fold_rows(panel, year, 7, "1995-01-01", ["index_code"])
        try:
            counts = MD.class_counts(train.filter("dayofyear(trade_date) > 60 or buy_label = 1"), "buy_label", 300)
            out.append((year, "fits", sum(counts.values())))
        except ValueError as error:
            out.append((year, "one class" if "one class" in str(error) else "few rows", None))
    return spark.createDataFrame(out, "test_year int, outcome string, train_rows long")


def refreshed_averages(spark, sf_dir):
    """The averages of the last 15 days, continued from the stored state of the days before."""
    bars = fx.bars(spark, sf_dir).select("index_code", "trade_date", "close")
    first = F.date_sub(bars.agg(F.max("trade_date")).scalar(), 14)
    path = scratch(spark, "average-state")
    past = exponential_averages(bars.filter(c("trade_date") < first), ["index_code"], "trade_date", AVERAGES, MACD)
    average_state(past, ["index_code"], "trade_date", AVERAGES).write.parquet(path)
    recent = exponential_averages(bars.filter(c("trade_date") >= first), ["index_code"], "trade_date", AVERAGES, MACD,
                                  state=spark.read.parquet(path))
    return rounded(recent.select("trade_date", "index_code", "expma12", "ema26", "macd", "macd_signal", "expma50"), 6)


QUERIES = {f.__name__: f for f in (
    table_scan, instrument_names, report_csv, manifest_order, usable_columns, filled_features, unique_output, fold_years,
    class_weights, dataset_join, dataset_sentiment, refresh_versions, class_positions, upsert_first_load, upsert_buckets,
    prediction_similar_days, stored_predictions, stored_signals, fold_medians, column_medians, calibrated_given, board_choice,
    fit_guards, refreshed_averages)}

PANEL = EQ.scores().strip() + """, panel AS (SELECT trade_date, index_code, buy_label FROM scores
  UNION ALL SELECT trade_date, 'late', buy_label FROM scores WHERE index_code = '1' AND dayofyear(trade_date) > 356),
pn AS (SELECT *, lead(trade_date, 7) OVER (PARTITION BY index_code ORDER BY trade_date) AS reach FROM panel)"""
MANIFEST = ", ".join(f"('f_{n}')" for n in [*S.MARKET_FEATURES, *S.event_features(), *S.rolled_event_features()]
                     if n not in ("amount_zscore_20d", "amount_percentile_60d"))
ORACLES = {
    "prediction_similar_days": TQ.SIMSUM[:TQ.SIMSUM.index("SELECT count(*) AS count, coalesce(round(avg(similarity)")] + """
SELECT trade_date, round(similarity, 6) AS similarity FROM near ORDER BY near.similarity DESC, trade_date LIMIT 10""",
    "stored_predictions": "WITH " + EQ.scores().strip() + """ SELECT trade_date, horizon, round(future_ret, 6) AS return_pred,
  CASE WHEN year(trade_date) = 1999 THEN 0.5::DOUBLE ELSE round(buy_proba, 6) END AS confidence,
  CASE WHEN trade_date = (SELECT max(trade_date) FROM scores WHERE index_code = '1') THEN horizon END AS newest FROM scores WHERE index_code = '1'""",
    "stored_signals": "WITH " + EQ.scores().strip() + """ SELECT trade_date, v AS model_version, horizon, round(CASE WHEN v = 'v2' THEN buy_proba / 2 ELSE buy_proba END, 6) AS buy_proba
FROM scores, (VALUES ('v1'), ('v2')) AS x(v) WHERE index_code = '1'""",
    "table_scan": ov.with_(ov.BARS) + """SELECT trade_date, index_code, round(close, 6) AS close FROM bars
WHERE trade_date BETWEEN DATE '1996-02-01' AND DATE '1998-03-31' AND index_code IN ('1', '3')""",
    "instrument_names": ov.with_(ov.BARS) + """SELECT trade_date, index_code, CASE index_code WHEN '1' THEN 'One' WHEN '2' THEN 'Two' END AS instrument_name,
  CASE index_code WHEN '1' THEN 'large' WHEN '2' THEN 'small' END AS instrument_category FROM bars""",
    "report_csv": "WITH " + EQ.scores().strip() + " SELECT trade_date, index_code, test_year, buy_proba FROM scores",
    "manifest_order": f"""WITH m AS (SELECT * FROM (VALUES {MANIFEST}) AS x(feature))
SELECT CAST(row_number() OVER (ORDER BY length(feature), feature) AS INTEGER) AS position, feature FROM m""",
    "usable_columns": ov.with_(ov.ROLLING) + """SELECT DISTINCT CAST(year(trade_date) AS INTEGER) AS year, feature FROM (
  SELECT trade_date, 'f_ret_1d' AS feature, ret_1d AS v FROM rolling WHERE index_code = '1'
  UNION ALL SELECT trade_date, 'f_ma60_slope_10d', ma60_slope_10d FROM rolling WHERE index_code = '1'
  UNION ALL SELECT trade_date, 'f_late', CASE WHEN year(trade_date) >= 1999 THEN ret_1d END FROM rolling WHERE index_code = '1')
WHERE v IS NOT NULL""",
    "filled_features": "WITH " + EQ.scores().strip() + f""" SELECT trade_date, index_code, {r9('future_ret', 'future_ret_7d')}, buy_label AS buy_label_7d,
  {r9('ret_5d', 'f_ret_5d')}, 0.0::DOUBLE AS f_absent FROM scores WHERE trade_pos % 3 <> 0""",
    "unique_output": ov.with_(ov.BARS) + f"SELECT trade_date, index_code, {r9('close', 'close')} FROM bars",
    "fold_years": "WITH " + PANEL + """, years AS (SELECT CAST(unnest(range(1992, 2003)) AS INTEGER) AS test_year),
f AS (SELECT test_year, count(*) FILTER (trade_date >= DATE '1995-01-01' AND reach < make_date(test_year, 1, 1)) AS train_rows,
  max(trade_date) FILTER (trade_date >= DATE '1995-01-01' AND reach < make_date(test_year, 1, 1)) AS train_end,
  count(*) FILTER (year(trade_date) = test_year) AS test_rows FROM years, pn GROUP BY test_year)
SELECT * FROM f WHERE train_rows > 0 OR test_rows > 0""",
    "class_weights": "WITH " + PANEL + f""", tr AS (SELECT buy_label FROM pn WHERE reach < DATE '2000-01-01')
SELECT buy_label, count(*) AS n, {r9('(SELECT count(*) FROM tr) / (2.0::DOUBLE * count(*))', 'weight')} FROM tr GROUP BY buy_label""",
    "dataset_join": ov.with_(ov.ROLLING) + f"""SELECT trade_date, index_code, round(ret_1d, 6) AS f_ret_1d, 0.0::DOUBLE AS f_event_count,
  round(fr, 6) AS future_ret_7d, CAST(fr > 0.005::DOUBLE AS INTEGER) AS buy_label_7d
FROM (SELECT *, {ov.ratio(f"lead(close, 7) OVER ({ov._PART})", "close")} - 1 AS fr FROM rolling)""",
    "dataset_sentiment": ov.with_(ov.BARS).rstrip() + ", " + TQ.SENT.strip() + f""", dm AS (SELECT trade_date - {MOVED_DAYS} AS trade_date, avg(heat_score) AS h, avg(sentiment_score) AS s FROM sent GROUP BY 1)
SELECT b.trade_date, round(h, 6) AS f_heat_score, round(s, 6) AS f_sentiment_score FROM bars b LEFT JOIN dm ON b.trade_date = CAST(dm.trade_date AS DATE) WHERE b.index_code = '1'""",
    "refresh_versions": "WITH " + EQ.scores().strip() + """ SELECT trade_date, v AS model_version, CASE WHEN v = 'v1' THEN round(future_ret, 6) END AS future_ret_7d
FROM scores, (VALUES ('v1'), ('v2')) AS x(v) WHERE index_code = '1'""",
    "class_positions": "WITH " + EQ.three().strip() + f""", sp AS (SELECT *, CASE WHEN year(trade_date) < 1999 THEN 'early' ELSE 'late' END AS split FROM three),
mn AS (SELECT split, label, avg(future_ret) AS m FROM sp WHERE label IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT split, arg_max(label, m) AS hi, arg_min(label, m) AS lo FROM mn GROUP BY split),
pr AS (SELECT sp.*, hi, lo, CASE hi WHEN '{L.UP}' THEN buy_proba WHEN '{L.DOWN}' THEN short_proba ELSE 1 - buy_proba END AS lp,
  CASE lo WHEN '{L.UP}' THEN buy_proba WHEN '{L.DOWN}' THEN short_proba ELSE 1 - buy_proba END AS sp_ FROM sp JOIN ex USING (split))
SELECT trade_date, index_code, split, CASE WHEN pred_label = hi THEN 1 WHEN pred_label = lo THEN -1 ELSE 0 END AS position, hi AS long_label, lo AS short_label,
  round(lp, 6) AS long_proba, round(greatest(lp, sp_), 6) AS direction_proba, round(short_proba, 6) AS down_proba FROM pr""",
    "upsert_first_load": ov.with_(ov.BARS) + """SELECT trade_date, index_code, CASE WHEN dayofyear(trade_date) % 7 > 1 THEN round(open, 6) END AS open,
  round(close + CASE WHEN dayofyear(trade_date) % 5 = 0 THEN 1 ELSE 0 END, 6) AS close FROM bars""",
    "upsert_buckets": "WITH " + TQ.NEWS.strip() + """ SELECT news_id, doc_id, CASE WHEN doc_id % 50 = 0 THEN 'changed' ELSE source END AS source, trade_date
FROM news WHERE doc_id % 3 <> 0 OR doc_id % 50 = 0""",
    "fold_medians": "WITH " + EQ.scores().strip() + f""", panel AS (SELECT trade_date, index_code, ret_5d, volatility_20d, buy_proba FROM scores
  UNION ALL SELECT trade_date, 'late', ret_5d, volatility_20d, buy_proba FROM scores WHERE index_code = '1' AND dayofyear(trade_date) > 356),
pn AS (SELECT *, lead(trade_date, 7) OVER (PARTITION BY index_code ORDER BY trade_date) AS reach FROM panel WHERE trade_date >= DATE '1995-01-01'),
years AS (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS test_year),
long AS (SELECT test_year, unnest(['ret_5d', 'volatility_20d', 'buy_proba']) AS feature, unnest([ret_5d, volatility_20d, buy_proba]) AS v
  FROM years JOIN pn ON reach < make_date(test_year, 1, 1))
SELECT test_year, feature, {r9('median(v)', 'median')} FROM long WHERE v IS NOT NULL GROUP BY ALL""",
    "column_medians": "WITH " + EQ.scores().strip() + f""", long AS (SELECT unnest(['ret_5d', 'ma20_gap', 'volatility_20d', 'buy_proba']) AS feature,
  unnest([ret_5d, ma20_gap, volatility_20d, buy_proba]) AS v FROM scores)
SELECT feature, {r9('median(v)', 'median')} FROM long WHERE v IS NOT NULL GROUP BY ALL""",
    "calibrated_given": "WITH " + EQ.scores().strip() + f""", o AS (SELECT buy_proba AS x, count(*) AS w, sum(buy_label)::DOUBLE AS s FROM scores WHERE test_year < 2000 GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY x) AS i, x, w, s, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM o),
seg AS (SELECT a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM r a JOIN r b ON b.i >= a.i),
mn AS (SELECT r.i, lo, min(m) AS m FROM r JOIN seg ON lo <= r.i AND hi >= r.i GROUP BY 1, 2),
iso AS (SELECT i, any_value(x) AS x, max(m) AS y FROM mn JOIN r USING (i) GROUP BY i),
q AS (SELECT trade_date, index_code, buy_proba * 0.97::DOUBLE + 0.004::DOUBLE AS p FROM scores WHERE test_year >= 2000),
ends AS (SELECT p, coalesce(max(i) FILTER (iso.x <= p), min(i)) AS l, coalesce(min(i) FILTER (iso.x >= p), max(i)) AS u FROM (SELECT DISTINCT p FROM q), iso GROUP BY p),
fit AS (SELECT p, CASE WHEN a.x = b.x THEN a.y ELSE a.y + (b.y - a.y) * (p - a.x) / (b.x - a.x) END AS y FROM ends JOIN iso a ON a.i = l JOIN iso b ON b.i = u)
SELECT trade_date, index_code, unnest(['raw', 'sigmoid', 'isotonic']) AS calibration_method,
  round(unnest([p, 1 / (1 + exp(-(ln(p / (1 - p)) * 1.5::DOUBLE - 0.2::DOUBLE))), y]), 9) AS buy_proba FROM q JOIN fit USING (p)""",
    "board_choice": """SELECT event_type AS bar_name, CAST(user_id % 3 AS VARCHAR) AS topic, count(*) AS posts FROM events
WHERE user_id % 3 = 1 OR event_type = '1' GROUP BY 1, 2""",
    "fit_guards": "WITH " + PANEL + """, years AS (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS test_year),
n AS (SELECT test_year, count(trade_date) AS n, count(DISTINCT buy_label) AS k FROM years LEFT JOIN pn
  ON trade_date >= DATE '1995-01-01' AND reach < make_date(test_year, 1, 1) AND (dayofyear(trade_date) > 60 OR buy_label = 1) GROUP BY 1)
SELECT test_year, CASE WHEN n < 300 THEN 'few rows' WHEN k < 2 THEN 'one class' ELSE 'fits' END AS outcome, CASE WHEN n >= 300 AND k > 1 THEN n END AS train_rows FROM n""",
    "refreshed_averages": ov.with_(ov.EMA, recursive=True) + """SELECT trade_date, index_code, round(expma12, 6) AS expma12, round(expma12 - macd, 6) AS ema26,
  round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(expma50, 6) AS expma50 FROM ema_cols
WHERE trade_date > (SELECT max(trade_date) FROM ema_cols) - 15""",
}
