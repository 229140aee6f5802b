"""NumPy kernels over flat byte buffers.

Words have two independent 64-bit hashes. Prefix sums give polynomial hashes of substrings in one step; texts can be made whose
polynomial hashes agree, so those only route, and nothing is held equal by them.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 3)
_BACK = U(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BACK)):
            table = np.full(size, base, U)
            table[0] = 1
            _POWERS[k] = np.cumprod(table, dtype=U)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def release() -> None:
    """Give freed memory back to the system: workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Column:
    """A growing array."""

    def __init__(self, kind):
        self.room, self.size = np.empty(1024, kind), 0

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.empty(end * 3 // 2, self.room.dtype)
            room[: self.size] = self.data
            self.room = room
        self.room[self.size : end] = values
        self.size = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one buffer, and each row's start with the end after them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """P with P[j] - P[i] = the sum of byte values times powers over [i, j)."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


#: Bytes of text that a kernel works on at once, unless one row is longer.
SLICE_BYTES = 500_000


def row_slices(starts: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes, or of one row."""
    lo, rows = 0, len(starts) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + limit, side="right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


#: Bytes of a word above which its hash is taken by ``hashlib``.
LONG_WORD = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each [begin, end), eight bytes at a time through ``mix``."""
    loads = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    size = end - begin
    out = tuple(mix(size.astype(U) + c) for c in _MIX[:2])
    live, at, step = np.flatnonzero(size <= LONG_WORD), begin, 0
    while len(live):
        left = size[live] - step
        x = loads[at[live] + step] & _KEEP[np.minimum(left, 8)]
        for h, c in zip(out, _MIX[2:4], strict=True):
            h[live] = mix((h[live] ^ x) * c)
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        both = np.frombuffer(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
        out[0][i], out[1][i] = both
    return out


def shingles(data: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_shingles`` slice by slice, so that scratch memory stays small beside the batch."""
    parts = [_shingles(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], width) for lo, hi in row_slices(starts)]
    if not parts:
        return np.empty(0, U), np.empty(0, U), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(([0], np.cumsum(sizes)))


def _shingles(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each row, ascending, a second independent hash of each, and rows' offsets.

    A-Z are lowered; words are runs of bytes other than white space (9-13, 32). A row with fewer words than ``width``
    has one shingle, its whole word sequence; a row without words has none.
    """
    rows, n = len(starts) - 1, len(data)
    if not n:
        return np.empty(0, U), np.empty(0, U), np.zeros(rows + 1, np.int64)
    data = _LOWER[data]
    gap = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    word = ~gap
    begin = np.flatnonzero(word & (np.concatenate(([True], gap[:-1])) | first[:n]))
    end = np.flatnonzero(word & (np.concatenate((gap[1:], [True])) | first[1:])) + 1
    words = word_hashes(data, begin, end)
    at = np.searchsorted(begin, starts)
    w = len(begin)
    full = []
    for h in words:
        padded, total = np.concatenate((h, np.zeros(width, U))), np.zeros(w, U)
        for i in range(width):
            total = (total + padded[i : i + w]) * _MIX[i % 6 + 2]
        full.append(mix(total + U(width)))
    out, check, offsets = [], [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        a, b = at[r], at[r + 1]
        if b - a >= width:
            own = full[0][a : b - width + 1]
            order = own.argsort()
            own = own[order]
            new = np.concatenate(([True], own[1:] != own[:-1]))
            out.append(own[new])
            check.append(full[1][a + order[new]])
        elif b > a:
            for h, held in zip(words, (out, check), strict=True):
                x = np.array([b - a], U)
                for i in range(b - a):
                    x = (x + h[a + i]) * _MIX[i % 6 + 2]
                held.append(mix(x))
        offsets[r + 1] = offsets[r] + (len(out[-1]) if b > a else 0)
    return (np.concatenate(out), np.concatenate(check), offsets) if out else (np.empty(0, U), np.empty(0, U), offsets)
