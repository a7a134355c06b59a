"""Arrow batches in parts of bounded size, so that a worker's memory follows the bytes of its texts, not their number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES, PART_ROWS = 1_000_000, 1_000


def fresh(columns: Iterable[str], name: str) -> str:
    """name, or with underscores before it until none of the columns is called so (case does not count)."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def parts(batch: pa.RecordBatch, at: int, most_bytes: int = PART_BYTES, most_rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose column `at` (text or bytes) holds `most_bytes` at most; a longer value comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = int(ends[start - 1]) if start else 0
        stop = min(int(np.searchsorted(ends, before + most_bytes, "right")), start + most_rows)
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop
