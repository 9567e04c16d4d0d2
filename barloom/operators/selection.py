"""Trade positions, purging and greedy non-overlapping signal selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def trade_position(df: DataFrame, keys: list[str], order: str = "trade_date",
                   name: str = "trade_pos") -> DataFrame:
    """0-based row position by date inside each evaluated slice of one instrument."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def purge_tail(df: DataFrame, rows: int, keys: list[str], order: str = "trade_date") -> DataFrame:
    """Drop each series' last ``rows`` rows, whose labels reach into the test slice.

    A series of no more than ``rows`` rows goes as a whole: all of its labels do.
    """
    last = W.partitionBy(*keys).orderBy(c(order).desc())
    return df.withColumn("_from_end", F.row_number().over(last)).filter(c("_from_end") > rows).drop("_from_end")


def non_overlapping(signals: DataFrame, keys: list[str], horizon: int | Column,
                    position: str = "trade_pos") -> DataFrame:
    """Greedy left-to-right choice: the next signal starts after the last one ended.

    Each pick depends on the previous one, so a slice is folded as one array.  A
    slice is one instrument in one test year (``keys`` must hold both): at most 366
    rows, whatever the size of the panel.  The rows travel inside the array, hence
    one shuffle and no join back.
    """
    payload = [n for n in signals.columns if n not in keys]
    span = F.lit(horizon) if isinstance(horizon, int) else horizon
    item = F.struct(c(position).cast("long").alias("_p"), span.cast("long").alias("_h"),
                    *[c(n) for n in payload])
    grouped = signals.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    start = F.struct(F.lit(-1).cast("long").alias("next"),
                     F.array().cast("array<long>").alias("picked"))

    def step(acc: Column, row: Column) -> Column:
        take = row["_p"] >= acc["next"]
        return F.struct(
            F.when(take, row["_p"] + row["_h"]).otherwise(acc["next"]).alias("next"),
            F.when(take, F.concat(acc["picked"], F.array(row["_p"]))).otherwise(acc["picked"])
            .alias("picked"))

    # the sort key of the array is the position, its first field
    picked = F.aggregate(c("_rows"), start, step, lambda acc: acc["picked"])
    chosen = grouped.withColumn("_picked", picked).select(
        *keys, F.explode(F.filter("_rows", lambda r: F.array_contains(c("_picked"), r["_p"])))
        .alias("_row"))
    return chosen.select(*[c(n) if n in keys else c(f"_row.{n}").alias(n) for n in signals.columns])


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise when a key occurs twice; returns the frame unchanged otherwise."""
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate rows for key {keys}: {[tuple(r)[:-1] for r in repeated]}")
    return df
