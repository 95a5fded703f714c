"""Arrow batches in pieces, so that what a task's Python holds does not grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece (or one row).
PIECE = 1 << 18


def pieces(column: pa.Array, *others: pa.Array, size: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """Slices in which ``column`` takes at most ``size`` bytes, or one row, with those of the others beside it."""
    if len(column) < 2 or column.nbytes <= size:
        yield column, *others
        return
    half = len(column) // 2
    for at, n in ((0, half), (half, len(column) - half)):
        yield from pieces(*[c.slice(at, n) for c in (column, *others)], size=size)


def slices(batches: Iterable[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches whose columns take at most ``size`` bytes together, or one row."""
    for batch in batches:
        if batch.num_rows < 2 or batch.nbytes <= size:
            yield batch
            continue
        half = batch.num_rows // 2
        yield from slices((batch.slice(0, half), batch.slice(half)), size)
