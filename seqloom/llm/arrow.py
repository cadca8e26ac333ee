"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column as large binary, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "").cast(pa.large_binary())


def blocks(batches: Iterable[pa.RecordBatch], name: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, so that a task's memory does not follow the batch length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every piece, one piece after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
