"""Vectors as the searches take them: rows, usable ones only, values as a matrix or packed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str, zero: bool) -> Column:
    """Not null, not empty, every component present and finite; not all zero unless ``zero``."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))
    return fine if zero else fine & F.exists(column, lambda x: x != 0)


def clean(vectors: DataFrame, column: str = "embedding", zero: bool = True) -> DataFrame:
    """``vec_id, dims, vector`` (array of double) of the rows that take part; a null vec_id does not."""
    return vectors.where(F.col("vec_id").isNotNull() & usable(column, zero)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(column).alias("dims"),
        F.col(column).cast("array<double>").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an array<double> or array<float> column, all of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
