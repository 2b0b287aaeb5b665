"""Vectorised tokenising of whole Arrow string columns.

A column's UTF-8 buffer is one array of bytes: words are runs of word bytes,
and the 64-bit hash of each word comes from one cumulative sum.  There is no
Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Separators `[\x00-\x2F\x3A-\x60\x7B-\x7F]` (of text whose A-Z are lower case).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each text starts (with the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds at most about limit bytes of the column (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offs = buffer_of(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
        yield batch.slice(start, min(stop, n) - start)
        start = min(stop, n)


class Words:
    """The words of a column: starts and ends (bytes), first (word index where each text starts), data (bytes as hashed)."""

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool = True):
        raw, offs = buffer_of(column)
        self.data = data = LOWER[raw] if lower else raw
        self.offs = offs
        n = len(data)
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        bounds = offs[:-1][offs[:-1] < n]
        begins[bounds] = inside[bounds]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = offs[1:][offs[1:] > 0] - 1
        ends[last] = inside[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * _power(_BASE, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n + 1)[self.starts])

    def documents(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


_FACTORS = mix(np.arange(1, 65, dtype=_U) * _U(0x2545F4914F6CDD1D)) | _U(1)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of length words (in order); as many as len(words) - length + 1."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(length):
        out += words[j : j + n] * _FACTORS[j]
    return mix(out + _U(length))
