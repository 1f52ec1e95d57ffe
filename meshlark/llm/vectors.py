"""Vector columns: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantised components beyond this are taken as this, so that integer scores and squared
#: distances of vectors of up to 256 such components fit 64 bits.
MOST = 2**26


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has no null or non-finite component; never null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def number_array(df: DataFrame, vector_col: str) -> Column:
    """The vector as array<float> if it is one, as array<double> otherwise."""
    kind = df.schema[vector_col].dataType.simpleString()
    return F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")


def matrix(column: pa.ListArray, dims: int | None = None) -> np.ndarray:
    """The vectors of an Arrow batch as rows of doubles; shorter ones are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(n.max(initial=0)) if dims is None else dims
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as int64, within +-``MOST``."""
    return np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)


def exact_scores(left: np.ndarray, right: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """Inner products of paired rows, added up component by component: equal pairs have equal scores."""
    out = np.zeros(len(left))
    for at in range(0, len(left), rows):
        a, b = left[at : at + rows], right[at : at + rows]
        for j in range(left.shape[1]):
            out[at : at + rows] += a[:, j] * b[:, j]
    return out


def int_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T of int64 matrices, exactly: through doubles where all sums stay below 2^53."""
    bound = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if bound < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T
