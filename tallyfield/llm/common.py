"""Shared pieces of the text operators: Arrow columns as Python values, joins with hot keys, global ranks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import BROADCAST_BYTES, broadcast_if_small, checkpointed

#: A key is hot if it holds more than this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: Rows of a batch that are turned into Python values at a time.
ROWS = 500


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Bytes of text that are worked on at a time; a longer text is on its own.
CHUNK = 1 << 20


def byte_slices(batches: Iterable[pa.RecordBatch], text: str | int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``size`` (``CHUNK``) bytes of text, or one longer text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + (size or CHUNK), "right")))
            yield b.slice(first, last - first)
            first = last


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS):
    """Jobs inside get Arrow batches of at most so many rows, which bounds both sides' buffers for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined to the unique keys of ``right``, where one key may hold a third of ``left``.

    ``weight`` in ``right`` is the number of rows of ``left`` with that key. Keys over ``HOT_SHARE`` of all
    rows are at most ``1 / HOT_SHARE``, so they are broadcast; all others are joined by a shuffle.
    ``left`` is read twice and should be a written table.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = total * HOT_SHARE
    hot = F.broadcast(right.where(F.col(weight) > limit).drop(weight))
    rest = right.where(F.col(weight) <= limit).drop(weight)
    return left.join(hot, key).unionByName(
        left.join(hot.select(key), key, "left_anti").join(rest, key, how), allowMissingColumns=True
    )


def global_rank(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless ``__rank`` from 0 in the given order, and the number of rows.

    Rows are range-partitioned once and written; counts per partition (one row each) give the first rank of
    a partition, a window inside it the rest. Equal rows are told apart by their position in the scan, so
    that no partition grows with a tie.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = checkpointed(
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, "__tie")
        .withColumn("__part", F.spark_partition_id())
    )
    firsts, n = [], 0
    for row in sorted(placed.groupBy("__part").count().collect()):  # one row per partition
        firsts.append((row["__part"], n))
        n += row["count"]
    first = spark.createDataFrame(firsts, "__part int, __first long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__tie"))
    ranked = placed.withColumn("__row", within).join(F.broadcast(first), "__part").withColumn(
        "__rank", F.col("__first") + F.col("__row") - 1
    )
    return ranked.drop("__part", "__first", "__row", "__tie"), n


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own below the shared folder, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


__all__ = [
    "BROADCAST_BYTES", "HOT_SHARE", "broadcast_if_small", "byte_slices", "checkpointed", "global_rank", "join_hot", "remove_path", "slices", "small_batches", "strings", "utf8",
]
