"""Arrow batches cut small, so that what a task makes of one does not grow with the table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a piece of a batch has, about.
PIECE = 1_000_000


def cut(lengths: Sequence[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces in order that have ``most`` together, or one item."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of a text column, one row at least."""
    for b in batches:
        for start, end in cut(pc.binary_length(b.column(column)).fill_null(0).to_pylist(), most):
            yield b.slice(start, end - start)
