"""Words of Arrow text columns as 64-bit hashes, computed on the bytes of whole batches.

A word is a run of bytes other than space and 0x09-0x0D. Tasks work through bounded slices of
their rows; memory follows the slice (and the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C55


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit constants, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


BATCH_BYTES = 1 << 20


def small_batches(spark) -> None:
    """Let rows of long texts travel to Python in batches of ``BATCH_BYTES`` at most: what a task holds outside the heap
    is a few batches, on both sides. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name).removesuffix("b")
    if given.isdigit() and int(given) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # what Arrow keeps of freed batches counts against the executor


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of one partition put together until they hold ``limit`` bytes of text."""
    held, size = [], 0
    for part in slices(batches, column, limit):
        got = int(pc.sum(pc.fill_null(pc.binary_length(part.column(column)), 0)).as_py() or 0)
        if held and size + got > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += got
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield from whole


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and of the end); null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


class WordHasher:
    """Hashes of all words of a slice. ``fold`` takes A-Z as a-z; ``drop`` leaves out bytes before words are cut."""

    def __init__(self, fold: bool = False, drop: bytes = b"", seed: int = 1):
        values = numbers(seed, 256)
        if fold:
            values[65:91] = values[97:123]
        self.values = values
        self.keep = None
        if drop:
            self.keep = np.ones(256, bool)
            self.keep[np.frombuffer(drop, np.uint8)] = False
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("power", _BASE), ("inverse", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, offset of each text's first word and of the end)."""
        data, offsets = text_bytes(column)
        if self.keep is not None and len(data):
            kept = self.keep[data]
            offsets = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))[offsets]
            data = data[kept]
        hashes, starts, at = [], [], 0
        while at < len(data):
            stop = min(len(data), at + CHUNK_BYTES)
            while stop < len(data):  # to the next byte that ends a word
                ahead = self.space[data[stop - 1:stop - 1 + CHUNK_BYTES]]
                cut = int(np.argmax(ahead))
                if ahead[cut]:
                    stop += cut
                    break
                stop = min(len(data), stop + len(ahead))
            found, where = self._chunk(data[at:stop], offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop)] - at)
            hashes.append(found)
            starts.append(where + at)
            at = stop
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return hashes, np.searchsorted(starts, offsets)

    def _chunk(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self._grow(n + 1)
        word = ~self.space[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()  # last[i]: a word ends with byte i
        last[:-1] &= ~word[1:]
        borders = borders[(borders >= 0) & (borders < n)]
        first[borders] |= word[borders]
        before = borders[borders > 0] - 1
        last[before] |= word[before]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:n], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def windows(hashes: np.ndarray, starts: np.ndarray, k: int, seed: int = 7, at: tuple[int, ...] | None = None):
    """(hash of the ``k`` words from each word on, whether all of them lie in its text).

    ``at`` picks the places inside the window that count; the last must be ``k - 1``.
    """
    n = len(hashes)
    inside = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), inside
    sums = np.zeros(n - k + 1, np.uint64)
    for c, j in zip(numbers(seed, k)[list(at) if at else slice(None)], at or range(k)):
        sums += hashes[j:n - k + 1 + j] * c
    out = np.zeros(n, np.uint64)
    out[:n - k + 1] = mix(sums)
    doc_end = np.repeat(starts[1:], np.diff(starts))
    inside[:] = np.arange(n) + k <= doc_end
    return out, inside


def row_numbers(starts: np.ndarray) -> np.ndarray:
    """The number of each word's text in the slice."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
