"""Shared pieces of the vector operators: rows with whole-number components, and blocks of rows as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def scaled(rows: DataFrame, *keep: str, vec: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) and `keep`: each component x as floor(SCALE * x). Rows without vec_id, without a vector, or
    with a null or non-finite component are left out. Components beyond the range of long saturate."""
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & finite).select("vec_id", whole.alias("v"), *keep)


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of `dim` components; shorter lists are padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def lists(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of a matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(x).reshape(-1), kind or pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
