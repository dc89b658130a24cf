"""Masked-language-model sample preparation.

The mask is a deterministic hash of (row key, position, seed) -- md5, so SQL engines can
reproduce it -- instead of a random draw; about ``rate`` of the non-padding positions are
replaced by the mask id, and labels keep the original id there and ``-100`` elsewhere.

A row has thousands of positions, so they are hashed in numpy, many rows' at once
(``functions.md5``), in an Arrow UDF; as array expressions each costs several objects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from ..functions.md5 import first_bits

IGNORE_LABEL = -100
ROWS_IDS = 1 << 18  # ids of rows masked together


def _some_rows(rows: pa.ListArray):
    """The array of lists in slices of about ``ROWS_IDS`` items, a row at least."""
    at, k = rows.offsets.to_numpy(), 0
    while k < len(rows):
        end = max(k + 1, int(np.searchsorted(at, at[k] + ROWS_IDS, "right")) - 1)
        yield k, rows.slice(k, end - k)
        k = end


def _flat(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items laid end to end (0 for nulls), which of them are null, the items of each row."""
    items = rows.flatten()
    none = items.is_null().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return pc.fill_null(items, 0).to_numpy(zero_copy_only=False), none, sizes


def _masked(rows: pa.ListArray, keys: pa.Array, mask_id: int, pad_id: int, rate: float, seed: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Masked ids and labels of the rows."""
    masked, labels = [], []
    for k, some in _some_rows(rows):
        ids, none, sizes = _flat(some)
        names = [None if x is None else x.encode("utf-8") for x in keys.slice(k, len(some)).to_pylist()]
        drawn = first_bits(names, sizes.tolist(), str(seed).encode()) / 4294967296.0
        hit = (drawn < rate) & (ids != pad_id) & ~none
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        gone = some.is_null() if some.null_count else None
        without = none & ~hit
        for out, values, empty in ((masked, np.where(hit, mask_id, ids), without if without.any() else None), (labels, np.where(hit, ids, IGNORE_LABEL), None)):
            out.append(pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32), mask=empty), mask=gone))
    if not masked:
        return rows, rows
    return pa.concat_arrays(masked), pa.concat_arrays(labels)


def mlm_mask(
    ids: Column | str, key: Column | str, mask_id: int, pad_id: int = 0, rate: float = 0.15, seed: int = 42
) -> list[Column]:
    """``masked_ids`` and ``labels`` columns of ids ``ARRAY<INT>``. Both come from one call:
    Spark evaluates it once where both are asked for."""
    c = F.col(ids) if isinstance(ids, str) else ids
    k = F.col(key) if isinstance(key, str) else key
    array = PT.ArrayType(PT.IntegerType())

    @F.arrow_udf(PT.StructType([PT.StructField("masked_ids", array), PT.StructField("labels", array)]))
    def pair(rows: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_masked(rows, keys, mask_id, pad_id, rate, seed), names=["masked_ids", "labels"])

    both = pair(c, k.cast("string"))
    return [both["masked_ids"].alias("masked_ids"), both["labels"].alias("labels")]


def position_ids(ids: Column | str) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))


def mask_stats(df: DataFrame, labels_col: str = "labels", ids_col: str = "input_ids", pad_id: int = 0) -> DataFrame:
    """Masked positions / non-padding positions over the whole set (one global aggregate)."""
    masked = F.size(F.filter(F.col(labels_col), lambda x: x != F.lit(IGNORE_LABEL)))
    real = F.size(F.filter(F.col(ids_col), lambda x: x != F.lit(pad_id)))
    agg = df.agg(F.sum(masked).cast("long").alias("masked"), F.sum(real).cast("long").alias("non_pad"))
    return agg.withColumn("mask_rate", F.round(F.col("masked") / F.col("non_pad"), 9))
