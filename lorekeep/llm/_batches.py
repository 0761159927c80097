"""Arrow plumbing shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shared import drop_written, numbered, scratch, shared_dir, written
from ..ship import ship

__all__ = ["as_bytes", "drop_written", "map_slices", "mapped", "numbered", "scratch", "shared_dir", "slices", "written"]

#: Text bytes that one call of a batch function sees, unless a single row is longer.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts together hold about `most` bytes."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(column.type):
        sizes = np.zeros(n, dtype=np.int64)
    else:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes)
    at = 0
    while at < n:
        base = run[at - 1] if at else 0
        to = int(np.searchsorted(run, base + most, side="right"))
        to = min(n, at + SLICE_ROWS, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, text: str, schema: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], most: int = SLICE_BYTES) -> DataFrame:
    """Apply a function to runs of rows. `work` is called once in each task and returns that function, so what it prepares is shared by the task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            for part in slices(batch, text, most):
                each = each or work()
                if (out := each(part)) is not None:
                    yield out

    return mapped(df, run, schema)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
