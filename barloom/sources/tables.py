"""Table scans, the report sink and the detail source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def read_table(spark: SparkSession, path: str, schema: str | None = None, **bounds) -> DataFrame:
    """Parquet scan with bound parameters: ``column=value``, ``column=(low, high)`` or a list.

    Every bound is a plain predicate, so it reaches the scan and prunes partitions.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    for name, value in bounds.items():
        if isinstance(value, tuple):
            low, high = value
            if low is not None:
                df = df.filter(c(name) >= F.lit(low))
            if high is not None:
                df = df.filter(c(name) <= F.lit(high))
        elif isinstance(value, list):
            df = df.filter(c(name).isin(value))
        else:
            df = df.filter(c(name) == F.lit(value))
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, str, str, int] | None = None,
              **options: str) -> DataFrame:
    """Database table scan; ``partition`` is (column, low, high, parts) for a parallel read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = (reader.option("partitionColumn", column).option("lowerBound", low)
                  .option("upperBound", high).option("numPartitions", parts))
    return reader.load()


def add_missing_columns(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Additive evolution: stored rows get NULL for columns only the batch has."""
    return stored.unionByName(batch.limit(0), allowMissingColumns=True)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV report with a header, written by all tasks."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def read_details(spark: SparkSession, path: str, schema: str, required: Iterable[str]) -> DataFrame:
    """CSV walk-forward details with the given types and a check of required columns."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"detail report is missing columns: {missing}")
    typed = spark.read.option("header", True).csv(path)
    wanted = {part.split()[0]: part.split()[1] for part in schema.split(",")}
    return typed.select(*[c(n).cast(t).alias(n) for n, t in wanted.items() if n in header])
