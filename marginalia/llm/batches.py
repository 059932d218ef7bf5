"""Reading Arrow columns a few rows at a time, so that a batch of long texts is not held twice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def values(column: pa.Array) -> Iterator:
    """The column's values as Python objects."""
    for start in range(0, len(column), ROWS):
        yield from column.slice(start, ROWS).to_pylist()
