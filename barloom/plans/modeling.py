"""Model fits under purged time splits, calibration, ablation, prediction, signals.

Every fit is a ``pyspark.ml`` pipeline over the panel.  The driver only loops over
years, folds and variants; rows stay in Spark.  Feature rows that several fits read
are checkpointed once, so a fold never recomputes the feature windows.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom import schemas as S
from barloom.functions.labels import (causal_regime, evaluation_regime, explanation_text, lit_date,
                                      logit, mean_of_known, return_band, signal_direction)
from barloom.operators.ranking import bucketed_by, median_of_counts
from barloom.operators.selection import assert_unique, purge_tail, trade_position
from barloom.operators.upsert import fill_from, upsert_table
from barloom.plans.dataset import (feature_columns, fill_missing_features, select_manifest,
                                   without_forum)
from barloom.session import cut_lineage, release_unused

c = F.col
log = logging.getLogger(__name__)
SEED = 42
#: values of a label column, checked before its counts reach the driver
MAX_CLASSES = 10
MIN_TRAIN_ROWS = 200
#: independent fits submitted at a time; each is itself a distributed job
PARALLEL_FITS = 4
#: fits after which the driver drops what their jobs left behind
RELEASE_EVERY = 8
# --- Fixed value: the report's warning.
RISK_WARNING = "免费数据源和大模型抽取可能存在延迟或缺失；本报告仅用于量化研究与信息整理，不构成投资建议。"


@dataclass
class TreeSettings:
    """Learner size; the defaults match the published protocol."""
    trees: int = 300
    depth: int = 5
    step: float = 0.03
    seed: int = SEED
    bins: int = 32


@dataclass
class Bundle:
    """A fitted pipeline with the metadata that has to travel with it."""
    model: PipelineModel
    features: list[str]
    horizon: int
    feature_version: str = S.FEATURE_VERSION
    model_version: str | None = None
    model_type: str = "binary_buy"
    label_threshold: float | None = None
    splits: dict | None = None
    trained_from: str | None = None
    trained_through: str | None = None
    train_rows: int | None = None
    extra: dict = field(default_factory=dict)


REQUIRED_METADATA = {"features", "horizon", "feature_version"}


# --- splits ---------------------------------------------------------------------------------

def time_split(df: DataFrame, splits: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closed train and valid intervals and an open-ended test interval."""
    s = splits or S.DEFAULT_SPLITS
    day = c("trade_date")
    return (df.filter(day.between(lit_date(s["train_start"]), lit_date(s["train_end"]))),
            df.filter(day.between(lit_date(s["valid_start"]), lit_date(s["valid_end"]))),
            df.filter(day >= lit_date(s["test_start"])))


def select_rows(df: DataFrame, day: str | None = None, start: str | None = None,
                end: str | None = None) -> DataFrame:
    """One date, a date range, or the latest row; an empty choice is an error."""
    if day and (start or end):
        raise ValueError("a single date cannot be combined with a date range")
    if day:
        out = df.filter(c("trade_date") == lit_date(day))
    elif start or end:
        out = df
        if start:
            out = out.filter(c("trade_date") >= lit_date(start))
        if end:
            out = out.filter(c("trade_date") <= lit_date(end))
    else:
        out = df.filter(c("trade_date") == df.agg(F.max("trade_date")).scalar())
    if out.isEmpty():
        raise ValueError("no dataset rows match the requested dates")
    return out


# --- fits -----------------------------------------------------------------------------------

def label_counts(train: DataFrame, label: str) -> dict:
    """Rows per class; a column of many values is no label."""
    found = train.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    return {r[0]: r[1] for r in found}


def class_counts(train: DataFrame, label: str, min_rows: int = MIN_TRAIN_ROWS) -> dict:
    """Rows per class; too few rows or a single class is an error."""
    counts = label_counts(train, label)
    if sum(counts.values()) < min_rows:
        raise ValueError(f"not enough training rows for {label}: {sum(counts.values())}")
    if len(counts) < 2:
        raise ValueError(f"{label} training label has only one class")
    return counts


def balanced_weight(label: str, counts: dict) -> Column:
    """n / (k * n_class): every class weighs the same in total."""
    n, k = sum(counts.values()), len(counts)
    pairs = [F.lit(x) for cls, m in counts.items() for x in (cls, n / (k * m))]
    return F.create_map(*pairs)[c(label)]


def _long_values(rows: DataFrame, features: Sequence[str], *kept: str) -> DataFrame:
    """(kept..., feature, value) of all known values."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.nanvl(c(n).cast("double"), F.lit(None)).alias("value"))
                      for n in features])
    return rows.select(*kept, F.inline(pairs)).filter(c("value").isNotNull())


def column_medians(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns from one pass over their value counts; a column without values has none."""
    counts = _long_values(rows, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    # one row a feature, so their number is that of the manifest
    return {r[0]: r[1] for r in median_of_counts(bucketed_by(counts, ["feature"], "value"), ["feature"], "value", "median").collect()}


def fold_medians(rows: DataFrame, features: Sequence[str], years: Sequence[int], horizon: int, train_start: str,
                 series: Sequence[str] = ("index_code",)) -> DataFrame:
    """(test_year, feature, median) of the training rows of all expanding folds, from one pass.

    A row joins the folds from the first year that begins after its ``horizon``-th successor, and stays; so the counts of
    a value in all folds are prefix sums over the years, taken in the one aggregate that collapses equal values.
    """
    successor = F.lead("trade_date", horizon).over(W.partitionBy(*series).orderBy("trade_date"))
    dated = rows.filter(c("trade_date") >= lit_date(train_start)).withColumn("_free", F.year(successor))
    long = _long_values(dated, features, "_free").filter(c("_free").isNotNull())
    counts = long.groupBy("feature", "value").agg(*[F.count(F.when(c("_free") < int(y), 1)).alias(f"_n{y}") for y in years])
    per_fold = F.array(*[F.struct(F.lit(int(y)).alias("test_year"), c(f"_n{y}").alias("_n")) for y in years])
    placed = bucketed_by(counts, ["feature"], "value").select("feature", "value", "_bucket", F.inline(per_fold)).filter("_n > 0")
    return median_of_counts(placed, ["test_year", "feature"], "value", "median")


def _inputs(features: Sequence[str], medians: dict[str, float]) -> list:
    """Unknown inputs replaced by their training medians, and the vector of all."""
    filled = [f"_in_{n}" for n in features]
    values = ", ".join(f"coalesce(nanvl(`{n}`, NULL), {float(medians[n])!r}D) AS `_in_{n}`" for n in features)
    return [SQLTransformer(statement=f"SELECT *, {values} FROM __THIS__"),
            VectorAssembler(inputCols=filled, outputCol="_vector", handleInvalid="keep")]


def fit_binary(train: DataFrame, features: Sequence[str], label: str, trees: TreeSettings | None = None,
               min_rows: int = MIN_TRAIN_ROWS, medians: dict[str, float] | None = None) -> tuple[PipelineModel, list[str]]:
    """Median imputation, balanced weights and boosted trees for a 0/1 label.

    ``medians`` are those of the training rows; a feature without one has no known value there and is not used.
    """
    counts = class_counts(train, label, min_rows)
    medians = column_medians(train, features) if medians is None else medians
    used = [n for n in features if n in medians]
    rows = train.select(*[c(n).cast("double").alias(n) for n in used],
                        c(label).cast("double").alias("_label"),
                        balanced_weight(label, counts).alias("_weight"))
    return Pipeline(stages=[*_inputs(used, medians), _boosted(trees, "_vector")]).fit(rows), used


@dataclass
class FoldVectors:
    """Rows of one fold with a single imputed vector over all usable features, kept once for many fits.

    Medians and usable features belong to a column, not to a feature set, so a fit on a
    slice of the vector equals a fit on the columns of that slice.
    """
    fold: Fold
    train: DataFrame
    test: DataFrame
    used: list[str]


def fold_vectors(fold: Fold, features: Sequence[str], labels: Sequence[str], carried: Sequence[str],
                 medians: dict[str, float] | None = None) -> FoldVectors:
    """``medians`` are those of the training rows, as in `fit_binary`."""
    medians = column_medians(fold.train, features) if medians is None else medians
    used = [n for n in features if n in medians]
    numbers = [c(n).cast("double").alias(n) for n in used]
    inputs = Pipeline(stages=_inputs(used, medians)).fit(fold.train.select(*numbers))

    def kept(df: DataFrame, names: Sequence[str]) -> DataFrame:
        held = [c(n).alias(f"_held_{n}") for n in names if n in df.columns]
        out = inputs.transform(df.select(*held, *numbers))
        return cut_lineage(out.select(*[c(f"_held_{n}").alias(n) for n in names if n in df.columns], "_vector"))

    return FoldVectors(fold, kept(fold.train, labels), kept(fold.test, carried), used)


def fit_slice(vectors: FoldVectors, features: Sequence[str], label: str, trees: TreeSettings | None = None,
              min_rows: int = MIN_TRAIN_ROWS, counts: dict | None = None) -> tuple[PipelineModel, list[str]]:
    """`fit_binary` on some features of a fold's vectors; ``counts`` are the `class_counts` of its training rows."""
    counts = class_counts(vectors.train, label, min_rows) if counts is None else counts
    place = {n: k for k, n in enumerate(vectors.used)}
    used = [n for n in features if n in place]
    rows = vectors.train.select("_vector", c(label).cast("double").alias("_label"),
                                balanced_weight(label, counts).alias("_weight"))
    part = VectorSlicer(inputCol="_vector", outputCol="_vector_part", indices=[place[n] for n in used])
    return Pipeline(stages=[part, _boosted(trees, "_vector_part")]).fit(rows), used


def score_slice(model: PipelineModel, vectors: FoldVectors, name: str) -> DataFrame:
    return score_slices({name: model}, vectors)


def score_slices(models: dict[str, PipelineModel], vectors: FoldVectors) -> DataFrame:
    """One probability column a model, all from one pass over the test rows."""
    out = vectors.test
    for name, model in models.items():
        out = model.transform(out).withColumn(name, vector_to_array("_proba")[1])
        out = out.drop(*[n for n in _scratch(out) if n != "_vector"])
    return out.drop("_vector")


def _boosted(trees: TreeSettings | None, vector: str) -> GBTClassifier:
    t = trees or TreeSettings()
    learner = GBTClassifier(featuresCol=vector, labelCol="_label", weightCol="_weight", maxIter=t.trees,
                            maxDepth=t.depth, stepSize=t.step, seed=t.seed, maxBins=t.bins,
                            predictionCol="_pred")
    return learner.setProbabilityCol("_proba").setRawPredictionCol("_raw")


def _scratch(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n.startswith(("_in_", "_vector", "_proba", "_raw", "_pred", "_label"))]


def with_probability(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Append the probability of class 1; absent feature columns count as 0."""
    ready = fill_missing_features(df, list(features)).withColumns({n: c(n).cast("double") for n in features})
    out = model.transform(ready).withColumn(name, vector_to_array("_proba")[1])
    return out.drop(*_scratch(out))


def fit_three_class(train: DataFrame, features: Sequence[str], label: str, trees: TreeSettings | None = None,
                    min_rows: int = MIN_TRAIN_ROWS) -> tuple[PipelineModel, list[str]]:
    """Forest classifier over the three direction labels."""
    t = trees or TreeSettings()
    counts = class_counts(train, label, min_rows)
    medians = column_medians(train, features)
    used = [n for n in features if n in medians]
    rows = train.select(*[c(n).cast("double").alias(n) for n in used], label,
                        balanced_weight(label, counts).alias("_weight"))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="error").fit(rows)
    forest = RandomForestClassifier(featuresCol="_vector", labelCol="_label", weightCol="_weight",
                                    numTrees=t.trees, maxDepth=t.depth, seed=t.seed, maxBins=t.bins,
                                    probabilityCol="_proba", rawPredictionCol="_raw", predictionCol="_pred")
    names = IndexToString(inputCol="_pred", outputCol="pred_label", labels=indexer.labels)
    fitted = Pipeline(stages=[*_inputs(used, medians), forest]).fit(indexer.transform(rows))
    return PipelineModel(stages=[*fitted.stages, names]), used


def with_class(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Append the predicted label, its probability and one column per class."""
    ready = fill_missing_features(df, list(features)).withColumns({n: c(n).cast("double") for n in features})
    out = model.transform(ready)
    labels = model.stages[-1].getLabels()
    proba = vector_to_array("_proba")
    out = out.withColumns({"confidence": F.array_max(proba),
                           **{f"proba_{name}": proba[i] for i, name in enumerate(labels)}})
    return out.drop(*_scratch(out))


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, trees: TreeSettings | None = None,
                  min_rows: int = MIN_TRAIN_ROWS) -> tuple[PipelineModel, list[str]]:
    """Boosted trees for the forward return."""
    t = trees or TreeSettings()
    medians = column_medians(train, features)
    used = [n for n in features if n in medians]
    rows = train.select(*[c(n).cast("double").alias(n) for n in used], c(target).cast("double").alias("_label"))
    if rows.limit(min_rows).count() < min_rows:
        raise ValueError(f"not enough training rows for {target}")
    learner = GBTRegressor(featuresCol="_vector", labelCol="_label", maxIter=t.trees, maxDepth=t.depth,
                           stepSize=t.step, seed=t.seed, maxBins=t.bins, predictionCol="_pred")
    return Pipeline(stages=[*_inputs(used, medians), learner]).fit(rows), used


def with_return(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "pred_ret") -> DataFrame:
    ready = fill_missing_features(df, list(features)).withColumns({n: c(n).cast("double") for n in features})
    out = model.transform(ready).withColumn(name, c("_pred"))
    return out.drop(*_scratch(out))


# --- storage --------------------------------------------------------------------------------

def model_path(base: str, side: str, horizon: int, tag: str | None = None) -> str:
    """Folder of a model by side (buy, short or class), tag and horizon."""
    return "/".join([base.rstrip("/"), "_".join([side, *([tag] if tag else []), f"{horizon}d"])])


def save_bundle(bundle: Bundle, path: str) -> None:
    spark = SparkSession.getActiveSession()
    bundle.model.write().overwrite().save(f"{path}/pipeline")
    meta = {k: v for k, v in vars(bundle).items() if k != "model"}
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str, model_version: str | None = None,
                horizon: int | None = None) -> Bundle:
    """Load a model and refuse one without metadata or of another version or horizon."""
    text = spark.read.text(f"{path}/metadata").first()[0]
    meta = json.loads(text)
    missing = sorted(k for k in REQUIRED_METADATA if meta.get(k) in (None, [], ""))
    if missing:
        raise ValueError(f"model bundle is missing metadata: {missing}")
    if horizon is not None and int(meta["horizon"]) != horizon:
        raise ValueError(f"signal generation requires horizon {horizon}, got {meta['horizon']}")
    if model_version is not None and meta.get("model_version") != model_version:
        raise ValueError(f"model version mismatch: wanted {model_version}, got {meta.get('model_version')}")
    return Bundle(**{**meta, "model": PipelineModel.load(f"{path}/pipeline")})


# --- training entry points ------------------------------------------------------------------

def labelled(df: DataFrame, horizon: int, label: str) -> DataFrame:
    return df.na.drop(subset=[f"future_ret_{horizon}d", label])


def train_binary(dataset: DataFrame, side: str = "buy", horizon: int = S.SIGNAL_HORIZON,
                 splits: dict | None = None, features: Sequence[str] | None = None,
                 trees: TreeSettings | None = None) -> tuple[Bundle, DataFrame]:
    """Fit on the train split; return the bundle and the scored valid and test rows."""
    splits = splits or S.DEFAULT_SPLITS
    label = f"{side}_label_{horizon}d"
    features = list(features or select_manifest(dataset))
    rows = cut_lineage(labelled(dataset, horizon, label))
    train, valid, test = time_split(rows, splits)
    model, used = fit_binary(train, features, label, trees)
    scored = with_probability(
        model, valid.withColumn("split", F.lit("valid")).unionByName(test.withColumn("split", F.lit("test"))),
        used, f"{side}_proba")
    scored = scored.withColumns({"future_ret": c(f"future_ret_{horizon}d"), f"{side}_label": c(label),
                                 "horizon": F.lit(horizon)})
    return Bundle(model, used, horizon, model_type=f"binary_{side}", splits=splits), scored


def train_direction(dataset: DataFrame, horizon: int, splits: dict | None = None,
                    features: Sequence[str] | None = None, trees: TreeSettings | None = None
                    ) -> tuple[Bundle, Bundle, DataFrame]:
    """Fit the three-class model and the return model; score valid and test rows."""
    splits = splits or S.DEFAULT_SPLITS
    label, ret = f"label_{horizon}d", f"future_ret_{horizon}d"
    features = list(features or without_forum(feature_columns(dataset)))
    rows = cut_lineage(labelled(dataset, horizon, label))
    train, valid, test = time_split(rows, splits)
    classifier, used = fit_three_class(train, features, label, trees)
    regressor, used_r = fit_regressor(train, features, ret, trees)
    scored = valid.withColumn("split", F.lit("valid")).unionByName(test.withColumn("split", F.lit("test")))
    scored = with_return(regressor, with_class(classifier, scored, used), used_r)
    scored = scored.withColumns({"future_ret": c(ret), "label": c(label), "horizon": F.lit(horizon)})
    return (Bundle(classifier, used, horizon, model_type="three_class", splits=splits),
            Bundle(regressor, used_r, horizon, model_type="regressor", splits=splits), scored)


def train_final(dataset: DataFrame, horizons: Sequence[int] = (7,), features: Sequence[str] | None = None,
                trees: TreeSettings | None = None, label_threshold: float = 0.005,
                model_version: str = S.MODEL_VERSION) -> Bundle:
    """Fit on the full labelled history and record what the model was trained on."""
    if list(horizons) != [S.SIGNAL_HORIZON]:
        raise ValueError(f"final training requires only horizon {S.SIGNAL_HORIZON}, got {list(horizons)}")
    h = S.SIGNAL_HORIZON
    rows = cut_lineage(labelled(dataset, h, f"buy_label_{h}d"))
    model, used = fit_binary(rows, list(features or select_manifest(dataset)), f"buy_label_{h}d", trees)
    span = rows.agg(F.min("trade_date").cast("string"), F.max("trade_date").cast("string"),
                    F.count(F.lit(1))).first()
    return Bundle(model, used, h, model_version=model_version, label_threshold=label_threshold,
                  trained_from=span[0], trained_through=span[1], train_rows=span[2])


# --- walk-forward ---------------------------------------------------------------------------

@dataclass
class Fold:
    year: int
    train: DataFrame
    test: DataFrame
    train_rows: int
    train_end: str


def yearly_folds(rows: DataFrame, years: Sequence[int], horizon: int, train_start: str,
                 min_rows: int = MIN_TRAIN_ROWS, series: Sequence[str] = ("index_code",)):
    """Expanding training windows ending before each test year, tails purged.

    Years without test rows or with too few training rows are skipped.
    """
    spans = fold_spans(rows, years, horizon, train_start, series)
    for year in years:
        train, test = fold_rows(rows, year, horizon, train_start, series)
        train_rows, train_end, test_rows = spans.get(year, (0, None, 0))
        if train_rows < min_rows or not test_rows:
            log.warning("year %s skipped: %s training rows, %s test rows", year, train_rows, test_rows)
            continue
        yield Fold(year, train, test, train_rows, train_end)


def fold_rows(rows: DataFrame, year: int, horizon: int, train_start: str, series: Sequence[str]
              ) -> tuple[DataFrame, DataFrame]:
    """Training rows before a year, each series' tail purged, and the rows of the year."""
    start = lit_date(f"{year}-01-01")
    past = rows.filter((c("trade_date") >= lit_date(train_start)) & (c("trade_date") < start))
    return (purge_tail(past, horizon, list(series)),
            rows.filter(c("trade_date").between(start, lit_date(f"{year}-12-31"))))


def fold_table(rows: DataFrame, years: Sequence[int], horizon: int, train_start: str,
               series: Sequence[str] = ("index_code",)) -> DataFrame:
    """(test_year, train_rows, train_end, test_rows) of all folds from one aggregate.

    A row trains for year y if it is older than y and ``horizon`` rows of its series
    stand between it and the last row before y: its ``horizon``-th successor is older
    than y too.
    """
    w = W.partitionBy(*series).orderBy("trade_date")
    dated = rows.filter(c("trade_date") >= lit_date(train_start)).select(
        "trade_date", F.year("trade_date").alias("_year"), F.year(F.lead("trade_date", horizon).over(w)).alias("_free"))
    tested = rows.select("trade_date", F.year("trade_date").alias("_year"), F.lit(None).cast("int").alias("_free"))
    every = F.array(*[F.lit(int(y)) for y in years])
    trains = dated.select("trade_date", F.explode(F.filter(every, lambda y: y > c("_free"))).alias("test_year"),
                          F.lit(1).alias("trains"))
    tests = tested.filter(c("_year").isin([int(y) for y in years])).select(
        "trade_date", c("_year").alias("test_year"), F.lit(0).alias("trains"))
    return trains.unionByName(tests).groupBy("test_year").agg(
        F.count(F.when(c("trains") == 1, 1)).alias("train_rows"),
        F.max(F.when(c("trains") == 1, c("trade_date"))).alias("train_end"),
        F.count(F.when(c("trains") == 0, 1)).alias("test_rows"))


def fold_spans(rows: DataFrame, years: Sequence[int], horizon: int, train_start: str, series: Sequence[str]) -> dict:
    """`fold_table` by year; one row a test year."""
    return {r.test_year: (r.train_rows, str(r.train_end) if r.train_end else None, r.test_rows)
            for r in fold_table(rows, years, horizon, train_start, series).collect()}


REGIME_INPUTS = ["f_regime_trend_score", "f_is_bull_trend", "f_is_bear_trend", "f_regime_state_days"]


def _detail_inputs(horizon: int, series: Sequence[str]) -> list[str]:
    """Columns of the test rows that the details carry."""
    return ["trade_date", *series, f"future_ret_{horizon}d", *REGIME_INPUTS]


def _detail(fold: Fold, scored: DataFrame, horizon: int, label_threshold: float, train_start: str,
            series: Sequence[str], regime_args: dict | None) -> DataFrame:
    carried = [n for n in REGIME_INPUTS if n in scored.columns]
    out = scored.select("trade_date", *series, c(f"future_ret_{horizon}d").alias("future_ret"),
                        *carried, "buy_proba")
    out = out.withColumns({
        "evaluation_regime": evaluation_regime(c("trade_date"), **(regime_args or {})),
        "causal_regime": causal_regime(c("f_is_bull_trend"), c("f_is_bear_trend")),
        "test_year": F.lit(fold.year), "horizon": F.lit(horizon),
        "label_threshold": F.lit(float(label_threshold)), "train_start": F.lit(train_start),
        "train_end": F.lit(fold.train_end), "train_rows": F.lit(fold.train_rows)})
    return trade_position(out, [*series, "test_year", "horizon"])


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no fold produced evaluation rows")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _each(items: Sequence[tuple], work: Callable, parallel: int) -> list:
    """Results of independent pieces of work, in order, submitted from a few driver threads."""
    with ThreadPool(max(1, min(parallel, len(items) or 1))) as pool:
        task = inheritable_thread_target(SparkSession.getActiveSession())(lambda args: work(*args))
        return pool.map(task, items, chunksize=1)


def _fit_all(items: Sequence[tuple], fit: Callable[..., DataFrame], parallel: int) -> DataFrame:
    """The rows of independent fits, in order."""
    return _union(_each(items, fit, parallel))


def _fold_medians(rows: DataFrame, features: Sequence[str], years: Sequence[int], horizon: int, train_start: str,
                  series: Sequence[str]) -> dict[int, dict[str, float]]:
    """`fold_medians` by year and feature, one row each."""
    medians: dict[int, dict[str, float]] = {y: {} for y in years}
    if years:
        for year, name, value in fold_medians(rows, features, years, horizon, train_start, series).collect():
            medians[year][name] = value
    return medians


def _all_fold_vectors(rows: DataFrame, features: Sequence[str], years: Sequence[int], horizon: int, train_start: str,
                      series: Sequence[str], labels: Sequence[str], parallel: int) -> list[FoldVectors]:
    """`fold_vectors` of every usable year; the medians of all folds come from one pass."""
    folds = list(yearly_folds(rows, years, horizon, train_start, series=series))
    medians = _fold_medians(rows, features, [f.year for f in folds], horizon, train_start, series)
    carried = _detail_inputs(horizon, series)
    return _each([(f,) for f in folds], lambda fold: fold_vectors(fold, features, labels, carried, medians[fold.year]), parallel)


def walk_forward(dataset: DataFrame, years: Sequence[int] = range(2021, 2027),
                 horizons: Sequence[int] = (7,), train_start: str = "2016-01-01",
                 features: Sequence[str] | None = None, trees: TreeSettings | None = None,
                 label_thresholds: dict[int, float] | None = None, regime_args: dict | None = None,
                 series: Sequence[str] = ("index_code",), parallel: int = PARALLEL_FITS) -> DataFrame:
    """Purged yearly walk-forward detail rows of the buy model."""
    thresholds = S.BUY_LABEL_THRESHOLDS if label_thresholds is None else label_thresholds
    features = list(features or select_manifest(dataset))
    items = []
    for horizon in horizons:
        rows = cut_lineage(labelled(dataset, horizon, f"buy_label_{horizon}d"))
        medians = _fold_medians(rows, features, years, horizon, train_start, series)
        items += [(horizon, fold, medians[fold.year])
                  for fold in yearly_folds(rows, years, horizon, train_start, series=series)]

    def fit(horizon: int, fold: Fold, medians: dict[str, float]) -> DataFrame:
        model, used = fit_binary(fold.train, features, f"buy_label_{horizon}d", trees, medians=medians)
        scored = with_probability(model, fold.test, used, "buy_proba")
        return _detail(fold, scored, horizon, thresholds.get(horizon, 0.0), train_start, series, regime_args)

    return _fit_all(items, fit, parallel)


def label_threshold_sweep(dataset: DataFrame, years: Sequence[int] = range(2021, 2027),
                          label_thresholds: Sequence[float] = (0.0, 0.005, 0.01),
                          train_start: str = "2016-01-01", features: Sequence[str] | None = None,
                          trees: TreeSettings | None = None, regime_args: dict | None = None,
                          series: Sequence[str] = ("index_code",), parallel: int = PARALLEL_FITS) -> DataFrame:
    """Walk-forward repeated with experiment labels of several thresholds."""
    h = S.SIGNAL_HORIZON
    features = list(features or without_forum(feature_columns(dataset)))
    rows = cut_lineage(dataset.na.drop(subset=[f"future_ret_{h}d"]))
    folds = _all_fold_vectors(rows, features, years, h, train_start, series, [f"future_ret_{h}d"], parallel)

    def fit(threshold: float, vectors: FoldVectors) -> DataFrame:
        marked = replace(vectors, train=vectors.train.withColumn(
            "experiment_label", (c(f"future_ret_{h}d") > threshold).cast("int")))
        model, _ = fit_slice(marked, vectors.used, "experiment_label", trees)
        return _detail(vectors.fold, score_slice(model, vectors, "buy_proba"), h, threshold, train_start, series, regime_args)

    return _fit_all([(t, vectors) for t in label_thresholds for vectors in folds], fit, parallel)


# --- calibration ----------------------------------------------------------------------------

def time_series_folds(train: DataFrame, splits: int = 3) -> DataFrame:
    """Append ``fold`` (0 = never tested): the panel's dates in order, cut into ``splits`` test spans.

    Each fold tests the next floor(n / (splits + 1)) dates of all series, so whatever
    date a series begins on, no fold is fitted on a later date than it scores.  The
    table of dates has one row per calendar date.
    """
    dates = train.select("trade_date").distinct().withColumns({
        "_p": F.row_number().over(W.orderBy("trade_date")) - 1,
        "_n": F.count(F.lit(1)).over(W.partitionBy())})
    size = F.floor(c("_n") / (splits + 1))
    first = c("_n") - splits * size
    fold = F.when(c("_p") < first, 0).otherwise(F.floor(F.try_divide(c("_p") - first, size)) + 1)
    return train.join(dates.select("trade_date", fold.cast("int").alias("fold")), "trade_date")


def fold_parts(folded: DataFrame, fold: int, purge: int, series: Sequence[str] = ("index_code",)
               ) -> tuple[DataFrame, DataFrame]:
    """Fit rows (dates before the fold, each series' tail purged) and the rows of one fold."""
    return purge_tail(folded.filter(c("fold") < fold), purge, list(series)), folded.filter(c("fold") == fold)


def out_of_fold(train: DataFrame, features: Sequence[str], label: str, trees: TreeSettings | None = None,
                splits: int = 3, purge: int = 7, min_rows: int = MIN_TRAIN_ROWS,
                series: Sequence[str] = ("index_code",)) -> DataFrame:
    """Out-of-fold probabilities (``raw``) with their labels."""
    t = trees or TreeSettings()
    folded = cut_lineage(time_series_folds(train, splits))
    parts = []
    for fold in range(1, splits + 1):
        fit, held = fold_parts(folded, fold, purge, series)
        counts = label_counts(fit, label)
        if sum(counts.values()) < min_rows or len(counts) < 2:
            log.warning("fold %s of %s skipped: %s", fold, label, counts)
            continue
        settings = TreeSettings(t.trees, t.depth, t.step, t.seed + fold, t.bins)
        model, used = fit_binary(fit, features, label, settings, min_rows)
        parts.append(with_probability(model, held, used, "raw").select("raw", c(label).cast("double").alias("y")))
    oof = cut_lineage(_union(parts))
    if oof.select("y").distinct().count() < 2:
        raise ValueError("not enough out-of-fold predictions for calibration")
    return oof


def fit_calibrators(oof: DataFrame) -> tuple[tuple[float, float], IsotonicRegressionModel]:
    """Slope and intercept of a logistic curve on the logit, and the isotonic step model."""
    rows = VectorAssembler(inputCols=["_logit"], outputCol="_vector").transform(oof.withColumn("_logit", logit(c("raw"))))
    curve = LogisticRegression(featuresCol="_vector", labelCol="y").fit(rows)
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="_pred").fit(oof)
    return (float(curve.coefficients[0]), float(curve.intercept)), isotonic


def calibrated(scored: DataFrame, sigmoid: tuple[float, float], isotonic: IsotonicRegressionModel,
               proba: str = "buy_proba") -> DataFrame:
    """One copy of every row per calibration method."""
    slope, intercept = sigmoid
    df = isotonic.transform(scored.withColumns({
        "raw": c(proba), "_sigmoid": 1 / (1 + F.exp(-(logit(c(proba)) * slope + intercept)))}))
    clipped = F.least(F.greatest(c("_pred"), F.lit(0.0)), F.lit(1.0))
    kinds = F.array(*[F.struct(F.lit(name).alias("calibration_method"), value.alias("_cal"))
                      for name, value in (("raw", c("raw")), ("sigmoid", c("_sigmoid")), ("isotonic", clipped))])
    out = df.select(*[n for n in scored.columns if n != proba], F.inline(kinds))
    return out.withColumnRenamed("_cal", proba)


def calibration_walk_forward(dataset: DataFrame, years: Sequence[int] = range(2021, 2027),
                             label_threshold: float = 0.005, splits: int = 3, train_start: str = "2016-01-01",
                             features: Sequence[str] | None = None, trees: TreeSettings | None = None,
                             regime_args: dict | None = None, series: Sequence[str] = ("index_code",),
                             parallel: int = PARALLEL_FITS) -> DataFrame:
    """Raw, sigmoid and isotonic probabilities for every test year."""
    h = S.SIGNAL_HORIZON
    features = list(features or without_forum(feature_columns(dataset)))
    rows = cut_lineage(dataset.na.drop(subset=[f"future_ret_{h}d"]).withColumn(
        "experiment_label", (c(f"future_ret_{h}d") > label_threshold).cast("int")))

    def fit(fold: Fold) -> DataFrame:
        oof = out_of_fold(fold.train, features, "experiment_label", trees, splits, series=series)
        sigmoid, isotonic = fit_calibrators(oof)
        model, used = fit_binary(fold.train, features, "experiment_label", trees)
        scored = with_probability(model, fold.test, used, "buy_proba")
        detail = _detail(fold, scored, h, label_threshold, train_start, series, regime_args)
        detail = detail.withColumn("actual_label", (c("future_ret") > label_threshold).cast("int"))
        return calibrated(detail, sigmoid, isotonic)

    return _fit_all([(fold,) for fold in yearly_folds(rows, years, h, train_start, series=series)], fit, parallel)


# --- feature-set experiments ----------------------------------------------------------------

# --- Fixed values: feature-set variants by name, with the groups each holds.
ABLATION_VARIANTS = {
    "1_basic_market": ["basic_market"],
    "2_technical": ["basic_market", "technical"],
    "3_trend_volume_risk": ["basic_market", "technical", "trend_volume_risk"],
    "4_style_market": ["basic_market", "technical", "trend_volume_risk", "style_market"],
    "5_news_event": ["basic_market", "technical", "trend_volume_risk", "style_market", "news_event"],
    "6_basic_plus_risk": ["basic_market", "trend_volume_risk"],
    "7_core_no_style": ["basic_market", "technical", "trend_volume_risk", "news_event"],
    "8_full_no_technical": ["basic_market", "trend_volume_risk", "style_market", "news_event"],
    "9_full_no_risk": ["basic_market", "technical", "style_market", "news_event"],
}
SUBGROUP_VARIANTS = {
    "risk_0_none": ["basic", "technical", "style"],
    "risk_1_trend": ["basic", "technical", "style", "trend"],
    "risk_2_volume": ["basic", "technical", "style", "volume"],
    "risk_3_volatility": ["basic", "technical", "style", "volatility"],
    "risk_4_trend_volume": ["basic", "technical", "style", "trend", "volume"],
    "risk_5_trend_volatility": ["basic", "technical", "style", "trend", "volatility"],
    "risk_6_volume_volatility": ["basic", "technical", "style", "volume", "volatility"],
    "risk_7_all": ["basic", "technical", "style", "trend", "volume", "volatility"],
    "event_0_none": ["basic", "technical", "style", "trend", "volume", "volatility"],
    "event_1_raw": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw"],
    "event_2_raw_3d": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw", "event_roll_3d"],
    "event_3_raw_5d": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw", "event_roll_5d"],
    "event_4_raw_10d": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw",
                        "event_roll_10d"],
    "event_5_roll_all_no_raw": ["basic", "technical", "style", "trend", "volume", "volatility", "event_roll_3d",
                                "event_roll_5d", "event_roll_10d"],
    "event_6_raw_3d_5d": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw",
                          "event_roll_3d", "event_roll_5d"],
    "event_7_raw_3d_10d": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw",
                           "event_roll_3d", "event_roll_10d"],
    "event_8_raw_5d_10d": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw",
                           "event_roll_5d", "event_roll_10d"],
    "event_9_all": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw", "event_roll_3d",
                    "event_roll_5d", "event_roll_10d"],
    "final_0_no_risk": ["basic", "technical", "style", "event_raw", "event_roll_3d", "event_roll_5d",
                        "event_roll_10d"],
    "final_1_trend": ["basic", "technical", "style", "trend", "event_raw", "event_roll_3d", "event_roll_5d",
                      "event_roll_10d"],
    "final_2_volume": ["basic", "technical", "style", "volume", "event_raw", "event_roll_3d", "event_roll_5d",
                       "event_roll_10d"],
    "final_3_volatility": ["basic", "technical", "style", "volatility", "event_raw", "event_roll_3d",
                           "event_roll_5d", "event_roll_10d"],
    "final_4_trend_volume": ["basic", "technical", "style", "trend", "volume", "event_raw", "event_roll_3d",
                             "event_roll_5d", "event_roll_10d"],
    "final_5_trend_volatility": ["basic", "technical", "style", "trend", "volatility", "event_raw", "event_roll_3d",
                                 "event_roll_5d", "event_roll_10d"],
    "final_6_volume_volatility": ["basic", "technical", "style", "volume", "volatility", "event_raw",
                                  "event_roll_3d", "event_roll_5d", "event_roll_10d"],
    "final_7_all_risk": ["basic", "technical", "style", "trend", "volume", "volatility", "event_raw",
                         "event_roll_3d", "event_roll_5d", "event_roll_10d"],
}

def _prefixed(names: Sequence[str]) -> set[str]:
    return {f"f_{n}" for n in names}


def ablation_groups(available: Sequence[str]) -> dict[str, list[str]]:
    """Five research groups; a feature in none of them is an error."""
    groups = {
        "basic_market": _prefixed(S.BASIC_FEATURES), "technical": _prefixed(S.TECHNICAL_FEATURES),
        "trend_volume_risk": _prefixed(S.TREND_FEATURES + S.VOLUME_FEATURES + S.VOLATILITY_FEATURES),
        "style_market": _prefixed(S.STYLE_FEATURES),
        "news_event": {n for n in available if n.startswith("f_event_")},
    }
    return _ordered(available, groups)


def subgroup_groups(available: Sequence[str]) -> dict[str, list[str]]:
    """Ten finer groups: risk split in three, events split by window."""
    events = [n for n in available if n.startswith("f_event_")]

    def window(name: str) -> str:
        hits = [w for w in S.ROLL_WINDOWS if name.endswith(f"_roll_{w}d")]
        return f"event_roll_{hits[0]}d" if hits else "event_raw"

    groups = {
        "basic": _prefixed(S.BASIC_FEATURES), "technical": _prefixed(S.TECHNICAL_FEATURES),
        "style": _prefixed(S.STYLE_FEATURES), "trend": _prefixed(S.TREND_FEATURES),
        "volume": _prefixed(S.VOLUME_FEATURES), "volatility": _prefixed(S.VOLATILITY_FEATURES),
        **{kind: {n for n in events if window(n) == kind}
           for kind in ["event_raw", *[f"event_roll_{w}d" for w in S.ROLL_WINDOWS]]},
    }
    return _ordered(available, groups)


def _ordered(available: Sequence[str], groups: dict[str, set[str]]) -> dict[str, list[str]]:
    out = {g: [n for n in available if n in names] for g, names in groups.items()}
    loose = sorted(set(available) - {n for ns in out.values() for n in ns})
    if loose:
        raise ValueError(f"feature columns without a group: {loose}")
    return out


def _variant_table(available: Sequence[str], groups: dict[str, list[str]],
                   spec: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    return {name: [n for n in available if any(n in groups[g] for g in parts)] for name, parts in spec.items()}


def ablation_variants(available: Sequence[str]) -> dict[str, list[str]]:
    """Nine feature sets: five cumulative, four left-out or combined."""
    return _variant_table(available, ablation_groups(available), ABLATION_VARIANTS)


def subgroup_variants(available: Sequence[str], prefix: str | None = None) -> dict[str, list[str]]:
    """Twenty-six feature sets over the finer groups, optionally by name prefix."""
    table = _variant_table(available, subgroup_groups(available), SUBGROUP_VARIANTS)
    chosen = {n: v for n, v in table.items() if not prefix or n.startswith(prefix)}
    if not chosen:
        raise ValueError(f"no variants match prefix {prefix}")
    return chosen


def feature_set_walk_forward(dataset: DataFrame, variants: dict[str, list[str]],
                             years: Sequence[int] = range(2021, 2027), train_start: str = "2016-01-01",
                             trees: TreeSettings | None = None, label_threshold: float = 0.005,
                             regime_args: dict | None = None, series: Sequence[str] = ("index_code",),
                             parallel: int = PARALLEL_FITS) -> DataFrame:
    """Walk-forward detail rows per feature-set variant."""
    h = S.SIGNAL_HORIZON
    label = f"buy_label_{h}d"
    rows = cut_lineage(labelled(dataset, h, label))
    every = list(dict.fromkeys(n for names in variants.values() for n in names))
    folds = _all_fold_vectors(rows, every, years, h, train_start, series, [label], parallel)
    counts = _each([(vectors.train, label) for vectors in folds], class_counts, parallel)
    # variants of the same features are one fit: same rows, weights and seed
    sets = list(dict.fromkeys(tuple(names) for names in variants.values()))

    def detail(vectors: FoldVectors, fits: dict[tuple, tuple[PipelineModel, list[str]]]) -> DataFrame:
        scored = score_slices({f"_score{i}": fits[names][0] for i, names in enumerate(sets)}, vectors)
        scores = [F.struct(F.lit(name).alias("variant"), F.lit(len(fits[tuple(names)][1])).alias("feature_count"),
                           c(f"_score{sets.index(tuple(names))}").alias("buy_proba")) for name, names in variants.items()]
        out = _detail(vectors.fold, scored.withColumn("buy_proba", F.array(*scores)), h, label_threshold, train_start, series,
                      regime_args)
        rest = [n for n in out.columns if n != "buy_proba"]
        return out.select(*rest, F.inline("buy_proba")).select(*out.columns, "variant", "feature_count")

    items = [(k, vectors, names) for k, vectors in reversed(list(enumerate(folds))) for names in sets]
    fits: list[dict] = [{} for _ in folds]
    parts: list = [None for _ in folds]
    lock = Lock()

    def fit(k: int, vectors: FoldVectors, names: tuple) -> None:
        """The last fit of a fold scores it; its models and plans are dropped, so the driver holds those of a fold or two."""
        fitted = fit_slice(vectors, names, label, trees, counts=counts[k])
        with lock:
            fits[k][names] = fitted
            done = len(fits[k])
        if done == len(sets) or done % RELEASE_EVERY == 0:
            release_unused(dataset.sparkSession)
        if done == len(sets):
            parts[k] = cut_lineage(detail(vectors, fits[k]))
            fits[k] = {}

    _each(items, fit, parallel)
    release_unused(dataset.sparkSession)
    return _union(parts)


# --- prediction and signals -----------------------------------------------------------------

def predict_horizons(rows: DataFrame, models: dict[int, tuple[Bundle, Bundle]],
                     similar: DataFrame | None = None) -> DataFrame:
    """Direction, return, band, scores and explanation per horizon.

    ``similar`` holds one summary row per date (``similar_by_date``); a date without one
    has no neighbours.
    """
    tech = mean_of_known(c("f_ret_1d"), c("f_ma5_gap"), c("f_relative_hs300"))

    def score(name: str) -> Column:
        return F.coalesce(c(name), F.lit(0.0)) if name in rows.columns else F.lit(0.0)

    base = rows
    if similar is not None:
        near = similar.select(c("trade_date").alias("_day"), "summary", "score")
        base = base.join(assert_unique(near, ["_day"]), c("trade_date") == c("_day"), "left")
    else:
        base = base.withColumns({"summary": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    base = base.withColumns({"tech_score": tech, "sentiment_score": score("f_sentiment_score"),
                             "event_score": score("f_event_score"), "similar_event_score": F.coalesce("score", F.lit(0.0)),
                             "_similar": F.coalesce("summary", F.lit("历史相似样本不足。"))})
    parts = []
    for horizon, (classifier, regressor) in models.items():
        df = with_return(regressor.model, with_class(classifier.model, base, classifier.features),
                         regressor.features)
        low, high = return_band(c("pred_ret"))
        parts.append(df.select(
            "trade_date", F.lit(horizon).alias("horizon"), c("pred_label").alias("direction_pred"),
            c("pred_ret").alias("return_pred"), low.alias("return_low"), high.alias("return_high"),
            "confidence", "tech_score", "sentiment_score", "event_score", "similar_event_score",
            explanation_text(F.lit(horizon), c("pred_label"), c("pred_ret"), c("confidence"), c("tech_score"),
                             c("sentiment_score"), c("event_score"), c("_similar")).alias("explanation"),
            F.lit(RISK_WARNING).alias("risk_warning")))
    return _union(parts)


def buy_signals(rows: DataFrame, bundle: Bundle, threshold: float = S.SIGNAL_THRESHOLD,
                model_version: str = S.MODEL_VERSION, model_tag: str = S.MODEL_TAG) -> DataFrame:
    """The twelve signal columns for the given dataset rows."""
    if bundle.horizon != S.SIGNAL_HORIZON:
        raise ValueError(f"signal generation requires horizon {S.SIGNAL_HORIZON}, got {bundle.horizon}")
    if bundle.model_version != model_version:
        raise ValueError(f"model version mismatch: wanted {model_version}, got {bundle.model_version}")
    missing = [n for n in bundle.features if n not in rows.columns]
    if missing:
        raise ValueError(f"signal dataset is missing model features: {missing}")
    df = with_probability(bundle.model, rows, bundle.features, "buy_proba").withColumns({
        "causal_regime": causal_regime(c("f_is_bull_trend"), c("f_is_bear_trend")),
        "model_version": F.lit(model_version), "feature_version": F.lit(bundle.feature_version),
        "model_tag": F.lit(model_tag), "horizon": F.lit(bundle.horizon),
        "buy_threshold": F.lit(float(threshold)), "signal_strength": F.lit("normal"),
        "pred_ret": F.lit(None).cast("double")})
    df = df.withColumn("direction", signal_direction(c("causal_regime"), c("buy_proba"), c("buy_threshold")))
    return assert_unique(df.select(*S.SIGNAL_COLUMNS), ["trade_date", "model_version", "horizon"])


def refresh_realized(signals: DataFrame, dataset: DataFrame, code: str,
                     model_version: str | None = None) -> DataFrame:
    """Fill realised returns of stored signals, of one model version if named, that have become known."""
    known = dataset.filter((c("index_code") == code) & c("future_ret_7d").isNotNull())
    filled = fill_from(signals, known, ["trade_date"], "future_ret_7d")
    if model_version is None:
        return filled
    others = signals.filter(~c("model_version").eqNullSafe(model_version))
    return filled.filter(c("model_version") == model_version).unionByName(others)


def store_predictions(path: str, predictions: DataFrame) -> int:
    """Keyed store of a prediction report: one row per date and horizon."""
    return upsert_table(path, predictions, S.NATURAL_KEYS["prediction_result"])


def store_signals(path: str, signals: DataFrame) -> int:
    return upsert_table(path, signals, S.NATURAL_KEYS["buy_signal_daily"])
