"""Shared helpers of the text operators: bounded slices of Arrow batches and identifier types."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes worked on at a time inside a task (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def slices(batches: Iterator[pa.RecordBatch], text_index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows holding about ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def as_str(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [t if t is not None else "" for t in column.to_pylist()]
