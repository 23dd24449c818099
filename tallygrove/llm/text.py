"""Words, windows and hashes of whole Arrow batches of texts, in numpy inside a task.

A batch of texts is one byte array with document offsets; every step below works on all of its words
at once. Hashes are 64 bits wide and the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: text bytes worked on at a time: bounds a task's memory but for single longer texts
SLICE_BYTES = 2 << 20

SPACES = b" \t\n\x0b\x0c\r"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
#: letters and digits of ASCII and everything beyond ASCII
ALNUM = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        have = np.cumprod(table, dtype=np.uint64)
        if size <= SLICE_BYTES * 2:  # a single longer text doesn't stay in memory
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` text bytes; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


class ByteHash:
    """Hashes of any span of a byte array, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(_BASE, n), out=self.total[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64)


class Words:
    """All words of a batch: byte spans, document of each, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE):
        self.data, self.offsets, self.docs = data, offsets, len(offsets) - 1
        inside = member[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: first word of each document, and one past the last
        self.first = np.searchsorted(self.doc, np.arange(self.docs + 1))

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return mix(ByteHash(self.data)(self.start, self.end))

    def sum_by_doc(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]


class Rolling:
    """Hashes of any run of a sequence of 64-bit values, each in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_BASE, n), out=self.total[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.inverse[start]


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``size`` words inside one document."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[size - 1 :] == words.doc[: len(words) - size + 1])
    return at, mix(Rolling(hashes)(at, size))


def sum_ranges(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from each offset to the next."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True on the first byte of each character of UTF-8 bytes."""
    return (data & 0xC0) != 0x80
