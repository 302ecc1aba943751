"""Tables of vectors: rows that count, and matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


def squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``_row``, a number that tells rows which repeat; write the table before it is read twice."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    size = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def array_of(column: pa.Array | pa.ChunkedArray, k: int, kind: str) -> np.ndarray:
    """The numbers in the k-th value of a binary column."""
    return np.frombuffer(column[k].as_buffer(), kind)


def bytes_of(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
