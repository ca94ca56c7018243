"""Read rows that arrive sorted by group, one group at a time, inside an Arrow map."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal values in the first keys columns; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of one or more whole groups of equal numbers in the first keys columns; at most a batch and a group are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        if held and any(c[0] != held[-1].column(i)[-1].as_py() for i, c in enumerate(columns)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, int(changes[-1]))]).combine_chunks()
            held, batch = [], batch.slice(int(changes[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(column: pa.ChunkedArray | pa.Array):
    """A list column whose lists have one length, as a 2-d array."""
    chunks = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunks.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(chunks), -1)
