"""Ranges of ascending doc_id in which every row meets the row after it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_bounds(ids: DataFrame, name: str, parts: int) -> np.ndarray:
    """At most parts - 1 quantiles of a column (a bounded list), read from that column alone."""
    if parts < 2:
        return np.empty(0, np.int64)
    [row] = ids.agg(F.percentile_approx(F.col(name).cast("long"), [i / parts for i in range(1, parts)], 10_000)).collect()
    return np.unique(np.array(row[0] or [], np.int64))


def range_parts(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Number of bounds that are not above each id, 0 for null: equal ids share a part."""
    at = np.searchsorted(bounds, pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), "right")
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32)


def part_before(ids: DataFrame, name: str, bounds: np.ndarray) -> dict[int | None, int]:
    """For the id that opens each part the part before it, the last one for the first: one entry a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for b in batches:
            column = b.column(0).cast(pa.int64())
            part = range_parts(column, bounds)
            if column.null_count:
                least[0] = (0, 0)
            full = column.is_valid().to_numpy(zero_copy_only=False)
            values, part = column.drop_null().to_numpy(), part[full]
            order = np.lexsort((values, part))
            first = order[np.flatnonzero(np.diff(part[order], prepend=-1))]
            for p, v in zip(part[first].tolist(), values[first].tolist()):
                least[p] = min(least.get(p, (1, v)), (1, v))
        rows = [(p, *k) for p, k in least.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["part", "known", "id"])

    found = ids.select(name).mapInArrow(run, "part int, known int, id long").groupBy("part").agg(F.min(F.struct("known", "id")).alias("k")).collect()
    heads = sorted((r["part"], r["k"]["id"] if r["k"]["known"] else None) for r in found)
    return {i: heads[k - 1][0] for k, (_, i) in enumerate(heads)}
