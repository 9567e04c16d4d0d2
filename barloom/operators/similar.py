"""Nearest dates (or vectors) by cosine similarity after standardisation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similar_vectors(rows: DataFrame, vector: str, dims: int, is_current: Column, is_history: Column,
                    top_n: int = 20, tie: str | None = None) -> DataFrame:
    """History rows most similar to the single current row.

    One aggregate gives mean, deviation and the current vector (one row of
    ``3 * dims`` numbers); it is attached as a scalar subquery, so the history is
    read once more, scored in place and reduced by a distributed top-k.  Dimensions
    without spread count as zero.
    """
    used = rows.filter(is_current | is_history).withColumn("_now", is_current)
    x = [f"coalesce(double({vector}[{i}]), 0D)" for i in range(dims)]

    def per_dimension(call: str) -> str:
        return "array(" + ", ".join(call.format(x=v) for v in x) + ")"

    # partial aggregation leaves one row of 3 * dims numbers per task
    stats = used.agg(F.expr(
        f"named_struct('mean', {per_dimension('avg({x})')}, 'sd', {per_dimension('stddev_pop({x})')}, "
        f"'now', {per_dimension('max(CASE WHEN _now THEN {x} END)')}, 'n', count_if(_now)) AS _s"))
    # without a current row nothing is similar; several have no one vector
    several = F.raise_error(F.lit("more than one current row: name one instrument")).cast("boolean")
    history = used.filter(is_history).withColumn("_s", stats.scalar()).filter(
        F.when(c("_s.n") > 1, several).otherwise(c("_s.n") > 0))

    def scaled(values: Column) -> Column:
        pairs = F.zip_with(values, c("_s.mean"), lambda v, m: F.coalesce(v.cast("double"), F.lit(0.0)) - m)
        return F.zip_with(pairs, c("_s.sd"), lambda d, s: F.coalesce(F.try_divide(d, s), F.lit(0.0)))

    history = history.withColumns({"_a": scaled(c(vector)), "_b": scaled(c("_s.now"))})
    norm = F.sqrt(_dot(c("_a"), c("_a"))) * F.sqrt(_dot(c("_b"), c("_b")))
    similarity = F.coalesce(F.try_divide(_dot(c("_a"), c("_b")), norm), F.lit(0.0))
    scored = history.withColumn("similarity", similarity).drop("_s", "_a", "_b", "_now")
    order = [c("similarity").desc()] + ([c(tie).asc()] if tie else [])
    return scored.orderBy(*order).limit(top_n)


def similar_dates(dataset: DataFrame, day: str, features: list[str], top_n: int = 20,
                  code: str | None = None) -> DataFrame:
    """Earlier dates of one instrument most similar to one date; a panel needs the instrument's ``code``."""
    if code is not None:
        dataset = dataset.filter(c("index_code") == code)
    known = F.coalesce(*[c(n).cast("double") for n in features]).isNotNull()
    date = F.lit(day).cast("date")
    rows = dataset.filter(known).withColumn("_vec", F.array(*[c(n).cast("double") for n in features]))
    out = similar_vectors(rows, "_vec", len(features), c("trade_date") == date, c("trade_date") < date,
                          top_n, "trade_date")
    return out.select("trade_date", *[n for n in dataset.columns if n.startswith("future_ret_")], "similarity")


def similar_by_date(dataset: DataFrame, days: list[str], features: list[str], top_n: int = 20,
                    code: str | None = None) -> DataFrame:
    """One summary row per asked date, from that date's own neighbours; the dates are a stated few."""
    parts = [similar_summary(similar_dates(dataset, day, features, top_n, code)).withColumn(
        "trade_date", F.lit(day).cast("date")) for day in dict.fromkeys(days)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def similar_to_every_date(dataset: DataFrame, features: list[str], top_n: int = 20, key: str = "index_code",
                          block: int = 512) -> DataFrame:
    """(key, trade_date, rank, similar_date, similarity): for every date of every series its ``top_n`` most similar earlier dates.

    A date sees itself and earlier ones only: mean and deviation of each feature are those of the dates up to it, as in
    ``similar_dates``.  Dates are asked in blocks; a block meets the series up to its end, so a series of n dates is
    spread over n / block tasks, each of at most n rows (a series is bounded by the calendar), and copied n / 2 block times.
    Similarities that agree to 12 digits are ties, which go to the earlier date.
    """
    known = F.coalesce(*[c(n).cast("double") for n in features]).isNotNull()
    series = W.partitionBy(key).orderBy("trade_date")
    rows = dataset.filter(known).select(
        key, "trade_date", F.array(*[F.coalesce(F.nanvl(c(n).cast("double"), F.lit(None)), F.lit(0.0)) for n in features]).alias("vec"),
        F.floor((F.row_number().over(series) - 1) / block).cast("int").alias("own"))
    last = F.max("own").over(W.partitionBy(key))
    met = rows.withColumn("last", last).select(key, "trade_date", "vec", "own", F.explode(F.sequence("own", "last")).alias("asked"))

    def nearest(group: pa.Table) -> pa.Table:
        group = group.sort_by("trade_date")
        x = group["vec"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        # shifted by the first date, a feature that has not moved yet has a deviation of exactly zero
        x = x - x[0]
        count = np.arange(1, len(x) + 1)[:, None]
        mean = np.cumsum(x, axis=0) / count
        spread = np.sqrt(np.maximum(np.cumsum(x * x, axis=0) / count - mean ** 2, 0))
        weight = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        at, ranks, places, found = [], [], [], []
        for i in np.flatnonzero(group["own"].to_numpy() == group["asked"][0].as_py()):
            if not i:
                continue
            z = (x[:i + 1] - mean[i]) * weight[i]
            norm = np.sqrt((z * z).sum(axis=1))
            length = norm[:i] * norm[i]
            score = np.divide(z[:i] @ z[i], length, out=np.zeros(i), where=length > 0)
            score = np.round(score, 12)
            some = np.arange(i)
            if i > top_n:
                some = np.flatnonzero(score >= np.partition(score, i - top_n)[i - top_n])
            best = some[np.lexsort((some, -score[some]))][:top_n]
            at.append(np.full(len(best), i))
            ranks.append(np.arange(1, len(best) + 1))
            places.append(best)
            found.append(score[best])
        at, places = (np.concatenate([*v, np.empty(0, int)]).astype(int) for v in (at, places))
        return pa.table([group[key].take(at), group["trade_date"].take(at),
                         pa.array(np.concatenate([*ranks, np.empty(0, int)]).astype(np.int32)), group["trade_date"].take(places),
                         pa.array(np.concatenate([*found, np.empty(0)]))],
                        names=[key, "trade_date", "rank", "similar_date", "similarity"])

    kind = dataset.schema[key].dataType.simpleString()
    return met.groupBy(key, "asked").applyInArrow(
        nearest, f"{key} {kind}, trade_date date, rank int, similar_date date, similarity double")


def similar_summary(similar: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """Count, mean similarity, mean return and up share, and the five nearest dates.

    ``similar`` is the top-n table, so its ordered list is bounded by n.  The up
    share counts unknown returns as not up.
    """
    aggs = []
    for h in horizons or [3, 5, 7]:
        ret = c(f"future_ret_{h}d")
        aggs += [F.avg(ret).alias(f"avg_ret_{h}d"),
                 F.avg(F.coalesce(ret > 0, F.lit(False)).cast("double")).alias(f"up_prob_{h}d")]
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-c("similarity")).alias("s"), c("trade_date")))), 1, 5)
    out = similar.agg(F.count(F.lit(1)).alias("count"),
                      F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("score"), *aggs,
                      F.concat_ws(",", F.transform(nearest, lambda r: r["trade_date"].cast("string"))).alias("dates"))
    text = F.when(c("count") == 0, "历史相似样本不足。").otherwise(F.format_string(
        "相似日期Top%d中，未来5日平均收益%.2f%%，上涨概率%.1f%%。", c("count"), c("avg_ret_5d") * 100,
        c("up_prob_5d") * 100))
    return out.withColumn("summary", text)
