"""Vectorised numpy primitives over Arrow text batches: words, hashes, windows.

Texts are handled as the concatenated UTF-8 bytes of a few documents at a
time (about ``CHUNK_BYTES``), so memory stays bounded whatever the batch size.
The hash of a byte slice is the sum over its 8-byte blocks of a finaliser of
the block and its number, so it has no algebra that structured texts could
meet; slices of up to 8 bytes of one length never share a hash. Where a hash
stands for the bytes in a table, ``same_slices`` compares the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of a block's first 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def blocks(data: np.ndarray) -> np.ndarray:
    """View of the 8 bytes from each position on (zeros behind the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _pieces(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of slices beyond the first: (slice, number of the block, bytes in it)."""
    more = np.flatnonzero(size > 8)
    count = (size[more] - 1) // 8
    row = np.repeat(more, count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
    return row, k, np.minimum(size[row] - 8 * k, 8)


class Hasher:
    """Hash of any byte slice of ``data``; the work grows with the slices' lengths."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.at = blocks(self.data)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix((self.at[start] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * _SIZE)
        row, k, n = _pieces(size)
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            part = mix((self.at[start[row] + 8 * k] & _KEEP[n]) ^ mix(k.astype(np.uint64) * _STEP))
            some = row[first]
            out[some] = mix(out[some] + np.add.reduceat(part, first))
        return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    n, at = len(data) - size + 1, blocks(data)
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole, rest = size // 8, size % 8
    mixed = mix(at[: n + 8 * max(0, whole - 1)]) if whole else None
    out = np.full(n, _ODD[size % 64], np.uint64)
    for k in range(whole):
        out += mixed[8 * k : 8 * k + n] * _ODD[k % 64]
    if rest:
        out += mix((at[8 * whole : 8 * whole + n] & _KEEP[rest]) + _SIZE)
    return mix(out)


def same_slices(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``a`` and ``b`` (views by ``blocks``) are equal, slice by slice."""
    out = ((a[a_start] ^ b[b_start]) & _KEEP[np.minimum(size, 8)]) == 0
    row, k, n = _pieces(size)
    if len(row):
        other = ((a[a_start[row] + 8 * k] ^ b[b_start[row] + 8 * k]) & _KEEP[n]) != 0
        out[row[other]] = False
    return out


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system, which a Python worker otherwise keeps as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary array of ``values`` cut at ``at`` (from 0 to their number).

    Made from buffers: of memory views that it gets as rows, Arrow (pyarrow 23) never lets go, so all bytes behind them would stay for good.
    """
    offsets = pa.array(at * values.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, offsets.buffers()[1], pa.py_buffer(values)])


def chunks(column: pa.Array, max_bytes: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; nulls count as empty."""
    max_bytes = max_bytes or CHUNK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, values = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 4096)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def edges(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``gap``, never across documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap
    first = np.ones(len(data), bool)
    first[1:] = gap[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = True
    last[cut[cut > 0] - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and the first word index of each document (plus the end)."""
    start, end = edges(data, offsets, _SPACE[data])
    return start, end, np.searchsorted(start, offsets)


def windows(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (across documents too: mask those)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _ODD[(salt + size) % 64], np.uint64)
    for k in range(size):
        out += mix(h[k : k + n] * _ODD[k % 64] + np.uint64(k))
    return mix(out)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole short word sequence."""
    return int(windows(h, len(h), salt=7)[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
