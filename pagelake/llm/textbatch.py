"""Arrow batches of text as flat byte arrays: slices of bounded size, word spans and word hashes.

The Python stages of this subpackage get Arrow record batches and work on the
bytes of many documents at once with numpy. A slice holds whole documents and
at most ``SLICE_BYTES`` bytes, or one longer document, so memory is bounded by
that or by the longest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
#: Bytes whose spans are hashed together.
HASH_BYTES = 1 << 17
#: Documents of a slice, so that 16 bits number them.
SLICE_ROWS = 1 << 15
#: Rows of an Arrow batch between the JVM and Python, so that a batch of usual documents stays at a few MB.
BATCH_ROWS = 1000

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, 0 to n."""
    inverse = pow(_BASE, -1, 1 << 64)
    both = []
    for factor in (_BASE, inverse):
        steps = np.full(n + 1, factor, dtype=U64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=U64))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those that usual stretches need are kept; longer ones are made for the one span that needs them."""
    return _powers(HASH_BYTES) if n <= HASH_BYTES else _powers.__wrapped__(n)


class Slice:
    """Whole documents of a batch: their bytes in one array, and where each begins."""

    def __init__(self, first: int, offsets: np.ndarray, data: np.ndarray):
        self.first = first  # row of the batch
        self.offsets = offsets  # len + 1 positions in data
        self.data = data

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (0 for the first of the slice) of each word."""
        starts, ends = spans(~IS_SEPARATOR[self.data], self.offsets)
        return starts, ends, self.documents(starts)

    def documents(self, places: np.ndarray) -> np.ndarray:
        """Document of each of these places in ascending order."""
        return np.repeat(np.arange(len(self)), np.diff(np.searchsorted(places, self.offsets)))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that does not cross a document's limit."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column; NULL counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_ROWS, n)
        yield Slice(at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]])
        at = to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    return value_hashes(data, BYTE_VALUES.take, starts, ends)


def value_hashes(data: np.ndarray, values: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for spans of any elements that ``values`` turns into 64-bit values; spans stand in ascending order and do not overlap.

    Work arrays are eight times as long as what they are made of, so they are made for
    a stretch of at most ``HASH_BYTES`` elements, or one longer span, at a time.
    """
    found = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(int(np.searchsorted(ends, low + HASH_BYTES, side="right")), at + 1)
        begin, end = starts[at:to] - low, ends[at:to] - low
        own = values(data[low : int(ends[to - 1])])
        forward, back = powers(len(own))
        total = np.zeros(len(own) + 1, dtype=U64)
        np.multiply(own, forward[: len(own)], out=own)
        np.cumsum(own, out=total[1:])
        found[at:to] = mix((total[end] - total[begin]) * back[begin] ^ (end - begin).astype(U64))
        at = to
    return found


def windows(values: np.ndarray, document: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` values inside one document, and the place of its first value."""
    if len(values) < size:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    n = len(values) - size + 1
    total = np.zeros(n, dtype=U64)
    for i in range(size):
        total = total * U64(0x9DDFEA08EB382D69) + values[i : i + n]
        total ^= total >> U64(29)
    at = np.flatnonzero(document[:n] == document[size - 1 :])
    return mix(total[at]), at


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - before, lengths) + np.arange(total)]
