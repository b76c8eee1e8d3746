"""Arrow batches in parts, so that a Python worker holds few texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS = 256


def parts(
    batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, at most ``rows`` at a time; with ``size`` about
    so many bytes, and one row at least."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            if size is not None:
                each = batch.slice(start).nbytes / (batch.num_rows - start)
                rows = max(1, int(size / max(each, 1)))
                # Rows at hand may be longer than the mean.
                while rows > 1 and batch.slice(start, rows).nbytes > 2 * size:
                    rows //= 2
            yield batch.slice(start, rows)
            start += rows
