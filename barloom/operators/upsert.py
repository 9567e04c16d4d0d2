"""Keyed upsert, update-join, anti-join, keyed delete and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.nulls import finite
from barloom.session import cut_lineage

c = F.col


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of every key in load order.

    The rank filter lets Spark keep one candidate per key and map task before the
    shuffle, so a key that holds a large share of the rows is not gathered.
    """
    w = W.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def head_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """First n rows of every group in the given order (pre-limited before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= n).drop("_rn")


def clean_batch(batch: DataFrame, keys: list[str], load_order: str | None = None) -> DataFrame:
    """The rows of a batch as they are stored: no NaN or infinity, one row per key.

    Of several rows with one key the last by ``load_order`` wins; without an order a
    repeated key is an error when the rows are read, as any choice would be arbitrary.
    """
    numeric = {f.name for f in batch.schema.fields if f.dataType.typeName() in ("double", "float")}
    clean = batch.select(*[finite(c(n)).alias(n) if n in numeric else c(n) for n in batch.columns])
    if load_order:
        return latest_per_key(clean, keys, c(load_order))
    again = F.row_number().over(W.partitionBy(*keys).orderBy(*keys)) > 1
    failed = F.raise_error(F.lit(f"several rows of a batch share a key of {keys} and no load order is given")).cast("boolean")
    return clean.withColumn("_again", again).filter(F.when(c("_again"), failed).otherwise(True)).drop("_again")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], load_order: str | None = None,
           immutable: list[str] | None = None) -> DataFrame:
    """Insert the batch, overwriting the batch's columns where the key exists.

    Columns the batch lacks keep the stored value, as do ``immutable`` columns of an
    existing row.  The batch is cleaned first (see ``clean_batch``).  Columns new in the
    batch are added.
    """
    immutable = immutable or []
    clean = clean_batch(batch, keys, load_order)
    if load_order and load_order not in base.columns:
        clean = clean.drop(load_order)
    fields = base.columns + [n for n in clean.columns if n not in base.columns]
    old = base.select(*keys, F.struct(*[c(n) for n in base.columns if n not in keys] or
                                      [F.lit(True).alias("_x")]).alias("_old"))
    new = clean.select(*keys, F.struct(*[c(n) for n in clean.columns if n not in keys] or
                                       [F.lit(True).alias("_x")]).alias("_new"))
    joined = old.join(new, keys, "full")

    def value(name: str) -> Column:
        in_old, in_new = name in base.columns, name in clean.columns
        if in_old and (not in_new or name in immutable):
            first = c(f"_old.{name}")
            return first if not in_new else F.when(c("_old").isNull(), c(f"_new.{name}")).otherwise(first)
        if not in_old:
            return c(f"_new.{name}")
        return F.when(c("_new").isNotNull(), c(f"_new.{name}")).otherwise(c(f"_old.{name}"))

    return joined.select(*[c(n) if n in keys else value(n).alias(n) for n in fields])


def fill_from(target: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Fill a column only where it is NULL, from a source unique on the keys."""
    other = source.select(*keys, c(column).alias("_fill"))
    return target.join(other, keys, "left") \
        .withColumn(column, F.coalesce(c(column), c("_fill"))).drop("_fill").select(*target.columns)


def not_yet_extracted(news: DataFrame, events: DataFrame, news_key: str = "news_id",
                      event_key: str = "source_ids") -> DataFrame:
    """News without an event.  A NULL id never qualifies once any event exists."""
    done = events.select(c(event_key).alias(news_key)).filter(c(news_key).isNotNull()).distinct()
    any_event = F.coalesce(done.agg(F.count(F.lit(1)) > 0).scalar(), F.lit(False))
    return news.join(done, news_key, "left_anti").filter(c(news_key).isNotNull() | ~any_event) \
        .select(*news.columns)


def delete_foreign_urls(posts: DataFrame, board: str, code: str) -> DataFrame:
    """Drop a board's posts whose URL names another board; a NULL URL is kept."""
    foreign = ~c("url").like(f"%/news,{code},%")
    return posts.filter(~((c("bar_name") == board) & F.coalesce(foreign, F.lit(False))))


#: parts of a table whose key holds no date
BUCKETS = 64


def _layout(keys: list[str], date_column: str, buckets: int) -> tuple[str, Column]:
    """Partition column of a stored table: the year of a dated key, else a hash bucket of the key."""
    if date_column in keys:
        return "_year", F.year(c(date_column))
    return f"_bucket_of_{buckets}", F.pmod(F.xxhash64(*[c(k) for k in keys]), F.lit(buckets)).cast("int")


def upsert_table(path: str, batch: DataFrame, keys: list[str], load_order: str | None = None,
                 immutable: list[str] | None = None, date_column: str = "trade_date", buckets: int = BUCKETS) -> int:
    """Upsert into a partitioned parquet table; returns the batch row count.

    A key that holds the date is stored by year, any other by a hash bucket of the key
    (the number of buckets is fixed by the first load).  Only the parts the batch
    touches are read and rewritten.  The merged rows are checkpointed before the
    overwrite, so a lost executor cannot make Spark re-read a part that is being
    replaced.  First load and merge clean the batch alike.
    """
    spark = batch.sparkSession
    rows = cut_lineage(batch)
    count = rows.count()
    if count == 0:
        return 0
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # first load: the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = None
    for name in stored.columns if stored is not None else []:
        if name.startswith("_bucket_of_"):
            buckets = int(name.removeprefix("_bucket_of_"))
    part, value = _layout(keys, date_column, buckets)
    if stored is None:
        merged = clean_batch(rows, keys, load_order)
        merged = merged.drop(load_order) if load_order else merged
    else:
        # at most one value per calendar year or bucket
        touched = [r[0] for r in rows.select(value.alias(part)).distinct().collect()]
        merged = cut_lineage(upsert(stored.filter(c(part).isin(touched)).drop(part), rows, keys, load_order, immutable))
    # rows of one part come together for the writer; AQE splits a part too large for one task
    merged.withColumn(part, value).hint("rebalance", part).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return count
