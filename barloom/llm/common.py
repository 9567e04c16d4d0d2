"""Shared helpers of the training-data operators: Arrow batches, shared storage, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there and no executor holds them."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def filesystem(uri: str):
    """pyarrow's file system for a Hadoop-style URI, and the path within it."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else; the quick `lower` where every character is ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, *LOWER))


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 byte strings, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_values(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def sub_batches(batches: Iterable[pa.RecordBatch], name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch cut into runs of about `most` bytes of column `name` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = _offsets(batch.column(name))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _offsets(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 64)])
