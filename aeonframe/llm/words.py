"""Words, hashes of words and hashes of word runs over Arrow batches, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. These are
ASCII, so the UTF-8 bytes of a whole batch are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts worked on at once, in bytes; the arrays of a step take some forty times as much.
CHUNK_BYTES = 1 << 20
_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, _U)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(max(n, 1 << 16), base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self._up[:n], self._down[:n]


class Hasher:
    """Polynomial hashes modulo 2**64 from running sums, so each costs a subtraction."""

    def __init__(self, seed: int = 1):
        self.letters = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
        self.inner = Powers(0xD1342543DE82EF95 + 2 * seed)
        self.outer = Powers(0xAF251AF3B0F025B5 + 2 * seed)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.inner.take(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(self.letters[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])

    def runs(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the word runs [start, end): the order of the words counts."""
        up, down = self.outer.take(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + _U(0x632BE59BD9B4E019))


class Chunk:
    """Some rows of a batch: their bytes, and where each word of which row stands."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        solid = ~_SEPARATOR[data]
        edges = np.unique(bounds)
        inside = edges[(edges > 0) & (edges < len(data))]
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, solid
        starts = solid & ~before[:-1]
        starts[inside] |= solid[inside]
        after = np.empty(len(data) + 1, bool)
        after[:-1], after[-1] = solid, False
        ends = solid & ~after[1:]
        ends[inside - 1] |= solid[inside - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        #: first[i]: number of the first word of row i; one more at the end.
        self.first = np.searchsorted(self.starts, bounds)

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words numbered at, as an Arrow array."""
        sizes = self.ends[at] - self.starts[at]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        places = np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[places])))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 bounds of a column of text; a null is an empty text."""
    # Copies of a batch are as large as the batch, so none is made without need.
    if column.null_count:
        column = pc.fill_null(column.cast(pa.string()), "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), bounds


def chunks(column: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, Chunk]]:
    """Slices of the rows with at most so many bytes together, a longer row alone."""
    if not len(column):
        return
    data, bounds = raw(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield slice(at, to), Chunk(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], lower)
        at = to


def ragged_take(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start : start + size] one after the other, and their int64 bounds."""
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return values[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)], bounds
