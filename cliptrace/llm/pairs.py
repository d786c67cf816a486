"""Streaming over sorted groups, for operators that compare rows in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``: a
    group is never cut, and about ``rows`` rows come at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        start = group_ids(table, keys)
        last = int(np.searchsorted(start, start[-1]))  # the last group may go on
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        n = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def group_ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 0, 1, ...: the number of each row's group."""
    new = np.zeros(table.num_rows, np.int64)
    for k in keys:
        col = table[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.cumsum(new)


def fixed(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    col = table[name].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if not len(col):
        return np.empty((0, 0), dtype)
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    raw = np.frombuffer(col.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return raw.view(dtype).reshape(len(col), -1)


def bounds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each group."""
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return first, np.diff(np.append(first, len(ids)))
