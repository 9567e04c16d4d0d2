"""Look-back refresh as an ``availableNow`` stream of keyed upserts.

The last days are landed again every run; late or corrected rows overwrite their
key.  No watermark is involved: the table, not the stream, holds the state, and
repeating a batch changes nothing.  Features are recomputed from the whole table,
because the recursive averages remember all of the past.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.operators.upsert import upsert_table

LOOK_BACK_DAYS = 15


def look_back(df: DataFrame, end: str, days: int = LOOK_BACK_DAYS, column: str = "trade_date") -> DataFrame:
    """Rows of the last ``days`` calendar days up to ``end``."""
    last = F.lit(end).cast("date")
    return df.filter((F.col(column) <= last) & (F.col(column) > F.date_sub(last, days)))


def refresh_table(spark: SparkSession, landed: str, schema: StructType | str, table: str, keys: list[str],
                  progress: str, normalize: Callable[[DataFrame], DataFrame] = lambda df: df,
                  load_order: str | None = None, date_column: str = "trade_date") -> None:
    """Upsert every landed file not seen before, then stop.

    ``progress`` is the stream's checkpoint folder in shared storage.  Without a
    ``load_order`` of its own, a row of a later file wins, and in a file a later row:
    the column ``_landed`` holds that order, and ``normalize`` has to keep it where
    keys repeat.
    """
    stream = spark.readStream.schema(schema).parquet(landed)
    if not load_order:
        stream = stream.withColumn("_landed", F.struct(
            "_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index"))

    def merge(batch: DataFrame, _batch_id: int) -> None:
        rows = normalize(batch)
        order = load_order or ("_landed" if "_landed" in rows.columns else None)
        upsert_table(table, rows, keys, order, date_column=date_column)

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress)
             .trigger(availableNow=True).start())
    query.awaitTermination()
