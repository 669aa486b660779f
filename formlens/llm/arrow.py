"""Arrow helpers of the tasks that run numpy over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose column has about limit bytes at most, or one row; memory is bounded by the longest row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in a row, and the offsets of its values; null is empty."""
    kind = pa.large_binary()
    values = pc.cast(pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""), kind)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array], dropped: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = [x for x in batch.schema.names if x not in added and x not in dropped]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *added.values()], names=[*kept, *added])
