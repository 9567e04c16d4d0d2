"""Model protocol: no leakage, guards, storage, calibration, variants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import schemas as S
from barloom.plans import dataset as D
from barloom.plans import modeling as M

SMALL = M.TreeSettings(trees=2, depth=2, step=0.3)
FEATS = ["f_x", "f_y", "f_empty"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    rows = []
    for code in ("a", "b"):
        for i in range(900):
            x = float(r.normal())
            ret = 0.01 * x + float(r.normal(0, 0.01)) if i < 893 else None
            rows.append((dt.date(2018, 1, 1) + dt.timedelta(days=i), code, x, None if i % 9 == 0 else x * 2, None,
                         ret, None if ret is None else int(ret > 0.005), None if ret is None else int(ret < 0),
                         None if ret is None else ("u" if ret > 0.005 else "d" if ret < -0.005 else "f"),
                         float(i % 3 == 0), float(i % 3 == 1)))
    return spark.createDataFrame(
        rows, "trade_date date, index_code string, f_x double, f_y double, f_empty double, future_ret_7d double, "
              "buy_label_7d int, short_label_7d int, label_7d string, f_is_bull_trend double, f_is_bear_trend double").cache()


def test_folds_do_not_leak(data):
    rows = data.na.drop(subset=["future_ret_7d"])
    folds = list(M.yearly_folds(rows, [2018, 2019, 2020, 2021], 7, "2018-01-01"))
    assert [f.year for f in folds] == [2019, 2020]  # 2018 has no past, 2021 no rows
    for fold in folds:
        last = fold.train.groupBy("index_code").agg(F.max("trade_date")).collect()
        first = fold.test.agg(F.min("trade_date")).first()[0]
        assert all((first - r[1]).days > 7 for r in last)
        assert fold.train_rows == fold.train.count()
    assert list(M.yearly_folds(rows, [2019], 7, "2018-01-01", min_rows=10 ** 6)) == []


def test_time_series_folds(data):
    one = data.filter("index_code = 'a'").limit(403)
    folded = M.time_series_folds(one, 3)
    sizes = {r[0]: r[1] for r in folded.groupBy("fold").count().collect()}
    assert sizes == {0: 403 - 3 * 100, 1: 100, 2: 100, 3: 100}
    fit, held = M.fold_parts(folded, 2, 7)
    assert fit.count() == 103 + 100 - 7 and held.count() == 100


@pytest.fixture(scope="module")
def uneven(data):
    """A panel whose series begin on different dates, one of them a few rows before a test year."""
    late = data.filter("index_code = 'b' and trade_date >= date '2019-06-01'").withColumn("index_code", F.lit("late"))
    short = data.filter("index_code = 'b' and trade_date >= date '2019-12-28'").withColumn("index_code", F.lit("short"))
    return data.unionByName(late).unionByName(short).na.drop(subset=["future_ret_7d"])


def _reach(rows):
    """The date of the 7th next row of each row's series, which its label reads."""
    from pyspark.sql import Window as W
    return rows.withColumn("_reach", F.lead("trade_date", 7).over(W.partitionBy("index_code").orderBy("trade_date")))


def test_no_training_label_reaches_the_test_slice(uneven):
    rows = _reach(uneven)
    folds = list(M.yearly_folds(rows, [2019, 2020], 7, "2018-01-01"))
    assert [f.year for f in folds] == [2019, 2020]
    for fold in folds:
        first = fold.test.agg(F.min("trade_date")).first()[0]
        assert fold.train.filter(F.col("_reach").isNull() | (F.col("_reach") >= F.lit(first))).count() == 0
        assert fold.train_rows == fold.train.count() and fold.test.count() > 0
        assert fold.train_end == str(fold.train.agg(F.max("trade_date")).first()[0])
    folded = M.time_series_folds(rows, 3)
    for k in (1, 2, 3):
        fit, held = M.fold_parts(folded, k, 7)
        first = held.agg(F.min("trade_date")).first()[0]
        assert fit.filter(F.col("_reach").isNull() | (F.col("_reach") >= F.lit(first))).count() == 0
        assert fit.count() > 0


def test_walk_forward_is_repeatable(data):
    kw = dict(years=[2019, 2020], train_start="2018-01-01", features=FEATS, trees=SMALL)
    a = M.walk_forward(data, **kw).orderBy("index_code", "trade_date").collect()
    b = M.walk_forward(data, **kw).orderBy("index_code", "trade_date").collect()
    assert a == b and len(a) == 2 * (893 - 365)
    assert {r.trade_pos for r in a if r.test_year == 2019 and r.index_code == "a"} == set(range(365))
    assert all(0 <= r.buy_proba <= 1 for r in a)


def test_guards(data):
    with pytest.raises(ValueError):
        M.fit_binary(data.limit(50).na.drop(subset=["buy_label_7d"]), FEATS, "buy_label_7d", SMALL)
    with pytest.raises(ValueError):
        M.fit_binary(data.filter("buy_label_7d = 1"), FEATS, "buy_label_7d", SMALL, min_rows=10)
    with pytest.raises(ValueError):
        M.select_rows(data, day="2018-01-01", start="2018-01-01")
    with pytest.raises(ValueError):
        M.select_rows(data, day="1999-01-01")
    assert M.select_rows(data).count() == 2
    with pytest.raises(ValueError):
        M.train_final(data, horizons=[5, 7])
    with pytest.raises(ValueError):
        D.select_manifest(data)
    with pytest.raises(ValueError):
        D.select_manifest(data, ["f_x", "f_x"])


def test_balanced_weights(data):
    rows = data.na.drop(subset=["buy_label_7d"])
    counts = M.class_counts(rows, "buy_label_7d")
    sums = rows.groupBy("buy_label_7d").agg(F.sum(M.balanced_weight("buy_label_7d", counts)).alias("w")).collect()
    assert all(r.w == pytest.approx(sum(counts.values()) / 2) for r in sums)


def test_final_model_round_trip_and_signals(spark, data, tmp_path):
    one = data.filter("index_code = 'a'")
    bundle = M.train_final(one, features=FEATS, trees=SMALL)
    assert bundle.features == ["f_x", "f_y"] and bundle.train_rows == 893
    path = M.model_path(str(tmp_path), "buy", 7, "t")
    assert path.endswith("buy_t_7d")
    M.save_bundle(bundle, path)
    loaded = M.load_bundle(spark, path, S.MODEL_VERSION, 7)
    with pytest.raises(ValueError):
        M.load_bundle(spark, path, "other")
    with pytest.raises(ValueError):
        M.load_bundle(spark, path, horizon=5)
    signals = M.buy_signals(M.select_rows(one, start="2020-01-01"), loaded)
    assert signals.columns == S.SIGNAL_COLUMNS
    again = M.buy_signals(M.select_rows(one, start="2020-01-01"), bundle)
    assert signals.orderBy("trade_date").collect() == again.orderBy("trade_date").collect()
    for r in signals.collect():
        assert (r.direction == "long") == (r.causal_regime == "bull" and r.buy_proba >= 0.6)
    with pytest.raises(ValueError):  # two instruments give two rows a date
        M.buy_signals(data, bundle)
    stored = signals.withColumn("future_ret_7d", F.lit(None).cast("double"))
    filled = M.refresh_realized(stored, data, "a")
    assert filled.filter("future_ret_7d is null").count() == 7


def test_calibration_is_monotone(spark):
    r = np.random.default_rng(1)
    p = r.uniform(0, 1, 600)
    oof = spark.createDataFrame([(float(a), float(r.uniform() < a ** 2)) for a in p], "raw double, y double")
    sigmoid, isotonic = M.fit_calibrators(oof)
    grid = spark.createDataFrame([(i / 50,) for i in range(51)], "buy_proba double")
    got = M.calibrated(grid.withColumn("key", F.col("buy_proba")), sigmoid, isotonic).toPandas()
    assert set(got.calibration_method) == {"raw", "sigmoid", "isotonic"}
    for _, part in got.groupby("calibration_method"):
        values = part.sort_values("key").buy_proba.to_numpy()
        assert (np.diff(values) >= -1e-12).all() and values.min() >= 0 and values.max() <= 1


def test_direction_models(data):
    rows = data.filter("index_code = 'a'")
    splits = {"train_start": "2018-01-01", "train_end": "2019-06-30", "valid_start": "2019-07-01",
              "valid_end": "2019-12-31", "test_start": "2020-01-01"}
    cls, reg, scored = M.train_direction(rows, 7, splits, FEATS, SMALL)
    out = M.predict_horizons(M.select_rows(rows, day="2020-02-01").withColumns(
        {"f_ret_1d": F.lit(0.01), "f_ma5_gap": F.lit(None).cast("double"), "f_relative_hs300": F.lit(0.03)}),
        {7: (cls, reg)}).first()
    assert out.direction_pred in ("u", "d", "f") and out.tech_score == pytest.approx(0.02)
    assert out.return_high - out.return_pred == pytest.approx(max(abs(out.return_pred) / 2, 0.005))
    assert 1 / 3 <= out.confidence <= 1 and "7日" in out.explanation
    assert {r[0] for r in scored.select("split").distinct().collect()} == {"valid", "test"}


def test_variants():
    available = [f"f_{n}" for n in S.MARKET_FEATURES + S.event_features() + S.rolled_event_features()]
    nine = M.ablation_variants(available)
    assert len(nine) == 9 and nine["5_news_event"] == available
    assert len(nine["1_basic_market"]) == 18 and len(nine["2_technical"]) == 58
    assert set(nine["7_core_no_style"]).isdisjoint({f"f_{n}" for n in S.STYLE_FEATURES})
    many = M.subgroup_variants(available)
    assert len(many) == 26 and many["event_9_all"] == available == many["final_7_all_risk"]
    assert len(many["event_1_raw"]) == 93 + 30 and len(many["event_5_roll_all_no_raw"]) == 93 + 90
    assert set(M.subgroup_variants(available, "risk_")) == {n for n in many if n.startswith("risk_")}
    with pytest.raises(ValueError):
        M.ablation_variants(available + ["f_mystery"])
    with pytest.raises(ValueError):
        M.subgroup_variants(available, "nothing")


def test_saved_bundles_are_evaluated(spark, data, tmp_path):
    from barloom.plans import bundles as BU
    from barloom.plans import evaluation as E
    rows = data.filter("index_code = 'a'")
    splits = {"train_start": "2018-01-01", "train_end": "2019-06-30", "valid_start": "2019-07-01",
              "valid_end": "2019-12-31", "test_start": "2020-01-01"}
    cls, reg, _ = M.train_direction(rows, 7, splits, FEATS, SMALL)
    for kind, bundle in (("cls", cls), ("reg", reg)):
        M.save_bundle(bundle, M.model_path(str(tmp_path), kind, 7, "t"))
    models = {7: tuple(M.load_bundle(spark, M.model_path(str(tmp_path), kind, 7, "t")) for kind in ("cls", "reg"))}
    scored = BU.scored_directions(rows, models, splits)
    pdf = scored.toPandas()
    assert len(pdf) == 163 and pdf.trade_date.min() == dt.date(2020, 1, 1)
    out = BU.evaluate_directions(scored).first()
    assert out.accuracy == pytest.approx((pdf.label == pdf.pred_label).mean())
    assert out.ic == pytest.approx(np.corrcoef(pdf.pred_ret, pdf.future_ret)[0, 1])
    assert out.high_confidence_count == (pdf.confidence >= 0.6).sum()
    high = pdf.groupby("label").future_ret.mean().idxmax()
    up = {(r.rule, r.threshold): r for r in BU.evaluate_up_signals(scored, [0.4]).collect()}
    fired = pdf[pdf[f"proba_{high}"] >= 0.4]
    assert up["up_probability", 0.4].signal_count == len(fired) and up["up_probability", 0.4].up_label == high
    assert up["up_probability", 0.4].avg_up_proba == pytest.approx(fired[f"proba_{high}"].mean())
    sides = {r.rule: r for r in BU.evaluate_long_short(scored, [0.4]).filter("threshold is null").collect()}
    low = pdf.groupby("label").future_ret.mean().idxmin()
    assert sides["predicted_long_short_label"].long_count == (pdf.pred_label == high).sum()
    assert sides["predicted_long_short_label"].short_count == (pdf.pred_label == low).sum()
    buy, _ = M.train_binary(rows, "buy", 7, splits, FEATS, SMALL)
    short, _ = M.train_binary(rows, "short", 7, splits, FEATS, SMALL)
    both = BU.scored_sides(rows, buy, short, splits, {"start": "2018-01-01", "bear_periods": [("2020-02-01", "2020-03-01")]})
    regimes, conflicts = BU.evaluate_sides(both, splits)
    assert {r.regime for r in regimes.collect()} == {"bull", "bear"}
    assert conflicts.filter("threshold = 0.5").first().test_rows == both.count() == 163
    assert E.class_names(scored) and {"u", "d"} <= set(E.class_names(scored))


def test_extreme_labels_are_inferred_per_key(spark):
    from barloom.plans import evaluation as E
    rows = spark.createDataFrame([("x", "a", 0.1), ("x", "b", -0.1), ("y", "a", -0.2), ("y", "b", 0.2), (None, "a", 0.3)],
                                 "split string, label string, future_ret double")
    got = {(r.split, r.label): (r["_labels"].high, r["_labels"].low) for r in E.with_extreme_labels(rows, keys=["split"]).collect()}
    assert got == {("x", "a"): ("a", "b"), ("x", "b"): ("a", "b"), ("y", "a"): ("b", "a"), ("y", "b"): ("b", "a"), (None, "a"): ("a", "a")}


def test_neighbours_belong_to_their_date_and_instrument(spark):
    from barloom.operators import similar as sim
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), code, float(i % 5 + k), float((i * k) % 7), 0.01, 0.02, 0.03)
            for i in range(40) for k, code in ((1, "a"), (2, "b"))]
    frame = spark.createDataFrame(rows, "trade_date date, index_code string, f_x double, f_y double, future_ret_3d double, "
                                        "future_ret_5d double, future_ret_7d double")
    with pytest.raises(Exception, match="more than one current row"):
        sim.similar_dates(frame, "2020-02-01", ["f_x", "f_y"]).collect()
    near = {str(r.trade_date): r.dates for r in sim.similar_by_date(frame, ["2020-02-01", "2020-02-02"], ["f_x", "f_y"], 3, "a").collect()}
    assert len(near) == 2 and near["2020-02-01"] != near["2020-02-02"]


def test_a_slice_of_the_fold_vectors_fits_like_its_columns(data):
    rows = data.na.drop(subset=["buy_label_7d"])
    fold = next(iter(M.yearly_folds(rows, [2020], 7, "2018-01-01")))
    carried = ["trade_date", "index_code", "f_x"]
    vectors = M.fold_vectors(fold, ["f_y", "f_x", "f_empty"], ["buy_label_7d"], carried)
    assert vectors.used == ["f_y", "f_x"]
    for names in (["f_x"], ["f_x", "f_y"], ["f_y", "f_x", "f_empty"]):
        plain, used = M.fit_binary(fold.train, names, "buy_label_7d", SMALL)
        want = M.with_probability(plain, fold.test, used, "p").select("trade_date", "index_code", "p")
        model, again = M.fit_slice(vectors, names, "buy_label_7d", SMALL)
        got = M.score_slice(model, vectors, "p").select("trade_date", "index_code", "p")
        assert used == again and sorted(got.collect()) == sorted(want.collect())


def test_feature_sets_share_medians_counts_and_equal_fits(data, monkeypatch):
    """Medians come from one pass and sets of the same features are one fit a fold; each set has the rows of its own fit."""
    variants = {"one": ["f_x"], "all": ["f_x", "f_y", "f_empty"], "same": ["f_x"]}
    fits, counted, fit, count = [], [], M.fit_slice, M.class_counts

    def noted(vectors, names, *args, **named):
        fits.append((vectors.fold.year, tuple(names)))
        return fit(vectors, names, *args, **named)

    def once_a_fold(train, *args):
        counted.append(train)
        return count(train, *args)

    with monkeypatch.context() as patched:
        patched.setattr(M, "fit_slice", noted)
        patched.setattr(M, "class_counts", once_a_fold)
        patched.setattr(M, "column_medians", lambda *_: pytest.fail("a pass of its own for the medians of a fold"))
        got = M.feature_set_walk_forward(data, variants, [2019, 2020], "2018-01-01", SMALL).collect()
    assert sorted(fits) == sorted((y, names) for y in (2019, 2020) for names in (("f_x",), ("f_x", "f_y", "f_empty")))
    assert len(counted) == 2
    rows = data.na.drop(subset=["future_ret_7d", "buy_label_7d"])
    want = {}
    for fold in M.yearly_folds(rows, [2019, 2020], 7, "2018-01-01"):
        for name, names in variants.items():
            model, used = M.fit_binary(fold.train, names, "buy_label_7d", SMALL)
            for r in M.with_probability(model, fold.test, used, "p").collect():
                want[name, r.index_code, r.trade_date] = (r.p, len(used), fold.year)
    assert len(got) == len(want) == 3 * 2 * (893 - 365)
    for r in got:
        p, features, year = want[r.variant, r.index_code, r.trade_date]
        assert (r.buy_proba, r.feature_count, r.test_year) == (pytest.approx(p, abs=1e-12), features, year)
        assert r.trade_pos == (r.trade_date - dt.date(r.test_year, 1, 1)).days


def test_feature_sets_finish_a_fold_and_drop_its_garbage_before_the_next(data, monkeypatch):
    """A fold is scored by the last of its fits, so the driver need not hold the models and plans of all folds."""
    seen, fit, score = [], M.fit_slice, M.score_slices

    def noted(vectors, *args, **named):
        seen.append(("fit", vectors.fold.year))
        return fit(vectors, *args, **named)

    def scored(models, vectors):
        seen.append(("score", vectors.fold.year))
        return score(models, vectors)

    with monkeypatch.context() as patched:
        patched.setattr(M, "fit_slice", noted)
        patched.setattr(M, "score_slices", scored)
        patched.setattr(M, "release_unused", lambda spark: seen.append("release"))
        got = M.feature_set_walk_forward(data, {"x": ["f_x"], "y": ["f_y"]}, [2019, 2020], "2018-01-01", SMALL, parallel=1)
    assert seen == [step for y in (2020, 2019) for step in (("fit", y), ("fit", y), "release", ("score", y))] + ["release"]
    assert {(r.variant, r.test_year) for r in got.select("variant", "test_year").distinct().collect()} \
        == {(v, y) for v in ("x", "y") for y in (2019, 2020)}
