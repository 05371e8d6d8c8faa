"""Arrow columns to numpy and back, for code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers of a matrix of rows by centres that a task holds at once, where the centres may grow with the table.
CELLS = 1 << 20


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a 2-D array, one row per list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, dtype=dtype).reshape(n, -1 if n else 0)


def lists(values: np.ndarray) -> pa.Array:
    """A 2-D array as a list column."""
    n, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row of ``x`` to every row of ``y``."""
    squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :]
    squares -= (2.0 * x) @ y.T
    np.maximum(squares, 0.0, out=squares)
    return np.sqrt(squares, out=squares)


def distance_tiles(x: np.ndarray, y: np.ndarray, rows: int, squared: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, Euclidean distances to all of ``y``, or their squares) of ``rows`` rows of ``x`` after another.

    The norms are columns of the product, and all tiles take the same place in memory, which stays in the cache: the next
    tile overwrites a tile, and so may the caller.
    """
    left = np.column_stack([x, np.einsum("ij,ij->i", x, x), np.ones(len(x))])
    right = np.ascontiguousarray(np.vstack([-2.0 * y.T, np.ones(len(y)), np.einsum("ij,ij->i", y, y)]))
    held = np.empty((min(rows, len(x)), len(y)))
    for a in range(0, len(x), rows):
        tile = left[a:a + rows]
        d = np.matmul(tile, right, out=held[:len(tile)])
        np.maximum(d, 0.0, out=d)
        yield a, d if squared else np.sqrt(d, out=d)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row; the lowest index on ties. ``CELLS`` bounds what is held of rows x centres."""
    squares = np.einsum("ij,ij->i", centres, centres)[None, :]
    found = np.empty(len(x), np.int64)
    rows = max(1, CELLS // max(1, len(centres)))
    for a in range(0, len(x), rows):
        found[a:a + rows] = np.argmin(squares - 2.0 * (x[a:a + rows] @ centres.T), axis=1)
    return found
