"""What the vector operators share: components as whole numbers, batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
#: Whole components end here, so that a squared distance of 64 and a product of 512 components fit a long.
LARGEST = 1 << 27


def is_finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector.cast("array<double>"), fine), F.lit(False))


def whole(vector: Column) -> Column:
    """array<int>: floor(256 * x) of each component x as double; values beyond 2**27 end there."""
    def one(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x * F.lit(float(SCALE)), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")

    return F.transform(vector.cast("array<double>"), one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list<int> column as rows of ``width`` whole numbers; shorter lists end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as little-endian 32-bit whole numbers."""
    return [r.tobytes() for r in np.ascontiguousarray(rows, "<i4")]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width)
