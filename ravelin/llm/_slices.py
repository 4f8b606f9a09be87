"""Record batches a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """``batches`` in turn, at most ``rows`` rows each: what is made of a slice goes back before the next one is read."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
