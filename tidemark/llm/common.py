"""What several operators share: the table reader, the word pattern, key repair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as it is; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` (or a field of it), to bound a worker's memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = [0 if v is None else v for v in pa.compute.binary_length(
            batch.column(column) if field is None else pa.compute.struct_field(batch.column(column), field)).to_pylist()]
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        yield batch.slice(first)
