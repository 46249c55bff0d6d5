"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, column: str) -> int:
    """The commonest length of the vectors, of equally common ones the greatest; 0 if there are none."""
    lengths = rows.select(F.size(f"`{column}`").alias("d")).where("d > 0").groupBy("d").count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have ``dim`` components, all of them finite, and these vectors as rows of doubles."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    found = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(found).all(axis=1)
    return at[finite], found[finite]


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes; ``unpacked`` undoes it."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = width * np.dtype(dtype).itemsize
    fixed = column.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1], dtype=dtype)[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(-1, width)


def first_of_each(group: np.ndarray, n: int, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``n`` entries of each group, by ``order``; they come by group and order."""
    at = np.lexsort((*reversed(order), group))
    sorted_group = group[at]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(at) else np.array([], dtype=np.int64)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return at[place < n]
