"""Arrow batches in slices of bounded size, for Python that makes objects of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SLICE_ITEMS = 1 << 17


def bytes_before(rows: pa.ListArray) -> np.ndarray:
    """The bytes of the strings before each row of an array of lists of strings, and of all."""
    sizes = pc.fill_null(pc.binary_length(rows.values), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[rows.offsets.to_numpy()]
    return total - total[0]


def cuts(rows: pa.ListArray) -> list[int]:
    """Row numbers that cut the array of lists of strings where its strings reach
    ``SLICE_BYTES`` or ``SLICE_ITEMS``; a slice has one row at least."""
    if not len(rows):
        return [0]
    size, items = bytes_before(rows), rows.offsets.to_numpy()
    at = [0]
    while at[-1] < len(rows):
        k = at[-1]
        fit = min(np.searchsorted(size, size[k] + SLICE_BYTES, "right"), np.searchsorted(items, items[k] + SLICE_ITEMS, "right")) - 1
        at.append(min(max(int(fit), k + 1), len(rows)))
    return at


def slices(rows: pa.ListArray) -> Iterator[pa.ListArray]:
    at = cuts(rows)
    for a, b in zip(at, at[1:]):
        yield rows.slice(a, b - a)


def cut(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices by its column of lists of strings."""
    at = cuts(batch[column])
    for a, b in zip(at, at[1:]):
        yield batch.slice(a, b - a)
