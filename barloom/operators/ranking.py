"""Exact medians and average-tie ranks that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one reducer and ``rank``
sorts a whole group there.  Both break when one group holds a large share of the
rows.  Here equal values are first collapsed to counts, the value axis is cut into
buckets at approximate quantiles, and positions are carried from bucket to bucket,
so a hot group is spread over as many tasks as there are buckets.  The buckets only
place the work; the results are exact, as long as counts and positions are placed by
the same cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import cut_lineage

BUCKETS = 128
c = F.col


def value_counts(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys, _bucket, value, _n): distinct values with their counts and bucket.

    The cuts are a scalar subquery over the counts, whose shuffle Spark reuses.
    """
    counts = df.filter(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = counts.select(F.percentile_approx(c(value), points, F.lit(1000))).scalar()
    bucket = F.size(F.filter("_cuts", lambda cut: cut <= c(value)))
    return counts.withColumn("_cuts", cuts).select(*keys, bucket.alias("_bucket"), value, "_n")


def _bucket_offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each bucket and in the whole group (at most ``BUCKETS`` rows a group)."""
    w = W.partitionBy(*keys)
    return (counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_rows"))
            .withColumns({
                "_before": F.sum("_rows").over(w.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
                - c("_rows"),
                "_total": F.sum("_rows").over(w)}))


def bucketed_by(counts: DataFrame, by: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """``_bucket`` by cuts of each group of its own, for groups whose values lie on different scales.

    The cuts (one row a group) are checkpointed: their approximation depends on the order in which partial results are
    merged, so cuts taken anew by each reader of the buckets would differ.
    """
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = cut_lineage(counts.groupBy(*by).agg(F.percentile_approx(c(value), points, F.lit(1000)).alias("_cuts")))
    return counts.join(cuts, by).withColumn("_bucket", F.size(F.filter("_cuts", lambda cut: cut <= c(value)))).drop("_cuts")


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str,
                   buckets: int = BUCKETS) -> DataFrame:
    """Exact median of ``value`` per group; keys must be non-null."""
    return median_of_counts(value_counts(df, keys, value, buckets), keys, value, name)


def median_of_counts(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group of bucketed counts (keys, _bucket, value, _n)."""
    low, high = F.floor((c("_total") + 1) / 2), F.floor((c("_total") + 2) / 2)
    middle = _bucket_offsets(counts, keys).filter(
        (c("_before") < high) & (c("_before") + c("_rows") >= low)).drop("_rows")
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.join(middle, [*keys, "_bucket"]).withColumn(
        "_upto", c("_before") + F.sum("_n").over(inside))

    def at(position: Column) -> Column:
        hit = (c("_upto") >= position) & (c("_upto") - c("_n") < position)
        return F.max(F.when(hit, c(value)))

    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias(name))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str,
                  buckets: int = BUCKETS) -> DataFrame:
    """(keys, value, name): the average-tie rank every occurrence of a value receives."""
    counts = value_counts(df, keys, value, buckets)
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.join(_bucket_offsets(counts, keys).drop("_rows", "_total"), [*keys, "_bucket"])
    upto = c("_before") + F.sum("_n").over(inside)
    return placed.select(*keys, value, (upto - (c("_n") - 1) / 2.0).alias(name))

