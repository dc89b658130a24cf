"""Global running numbers without a single-partition window.

1. range-partition by the order key and sort within partitions;
2. write the rows with (partition, index in it) to the shared folder, once: what is
   numbered is what was written, whatever is lost or retried later, and nothing is cached;
3. count rows per partition from that table (it reads one column) and prefix-sum the
   counts, a row per partition;
4. join the offsets, broadcast, to the written rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def range_partition(df: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``keys``; without a count, Spark takes the session's number of
    shuffle partitions and AQE sizes them."""
    keys = [F.col(k) for k in keys]
    return df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)


def number_ranged(df: DataFrame, order: Sequence[str], id_col: str = "row_number", start: int = 1) -> DataFrame:
    """Number rows of an already range-partitioned frame in ``order`` (contiguous from ``start``).

    ``df`` must be range-partitioned on a prefix of ``order`` (see ``range_partition``)."""
    spark = df.sparkSession
    keyed = (
        df.sortWithinPartitions(*[F.col(c) for c in order])
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)))
    )
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/numbered-{uuid.uuid4().hex}"
    keyed.write.parquet(path)
    rows = spark.read.schema(keyed.schema).parquet(path)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(start)).cast("long").alias("_from"))
    # One short row per partition.
    numbered = rows.join(F.broadcast(offsets), "_pid").withColumn(id_col, F.col("_from") + F.col("_idx"))
    return numbered.select(*df.columns, id_col)


def number_rows(
    df: DataFrame, order: Sequence[str], id_col: str = "row_number", start: int = 1, num_partitions: int | None = None
) -> DataFrame:
    """Contiguous running number over ``order`` with one range shuffle."""
    return number_ranged(range_partition(df, order, num_partitions), order, id_col, start)


def assign_batches(
    df: DataFrame, order: Sequence[str], batch_size: int, batch_col: str = "batch_id", num_partitions: int | None = None
) -> DataFrame:
    """Fixed-size batches in ``order``: ``batch_id = floor(row_index / batch_size)`` (from 0)."""
    numbered = number_rows(df, order, "_row", 0, num_partitions)
    return numbered.withColumn(batch_col, F.floor(F.col("_row") / F.lit(batch_size)).cast("long")).drop("_row")


def batch_rows(
    df: DataFrame, order: Sequence[str], batch_size: int, cols: Sequence[str], num_partitions: int | None = None
) -> DataFrame:
    """One row per batch: ``batch_id, rows ARRAY<STRUCT<cols>>`` in order. A batch holds
    at most ``batch_size`` rows, so the grouped array is bounded by the parameter."""
    numbered = number_rows(df, order, "_row", 0, num_partitions)
    grouped = numbered.groupBy(F.floor(F.col("_row") / F.lit(batch_size)).cast("long").alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_row"), *[F.col(c) for c in cols]))).alias("_rows")
    )
    return grouped.select("batch_id", F.transform("_rows", lambda r: r.dropFields("_row")).alias("rows"))
