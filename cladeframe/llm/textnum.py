"""Vectorised text primitives on Arrow buffers: blocks of documents, words, hashes.

Everything works on the UTF-8 bytes of a string column without building
Python strings.  A block holds documents with at most about ``BLOCK_BYTES``
bytes together (one longer document makes a block of its own), which bounds
the memory of the arrays derived from it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000
_owner = ""
_releases: dict[str, Callable[[], None]] = {}
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def claim(operator: str, release: Callable[[], None] | None = None) -> None:
    """Called by an operator's task: a worker process keeps the tables of the operator that it ran last only.

    Python workers outlive tasks and serve one operator after another; what
    an operator keeps between its own tasks is dropped by ``release`` when
    another one claims the process.
    """
    global _owner
    if not _owner:
        pa.set_memory_pool(pa.system_memory_pool())  # gives batches back at once, unlike the pooling ones
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger blocks are returned when freed
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):  # another C library
            pass
    if _owner != operator:
        for free in _releases.values():
            free()
        _releases.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _owner = operator
    if release is not None:
        _releases[operator] = release


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 (at least) of the multiplier modulo 2**64."""
    key = "inv" if inverse else "mul"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        base = np.full(size, _P_INV if inverse else _P, dtype=np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes) of consecutive rows."""
    raw, offs = string_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs without ASCII white space.

    A run never crosses the border of two documents.
    """
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~space
    starts_mask = solid.copy()
    starts_mask[1:] &= space[:-1]
    border = offs[1:-1]
    border = border[border < n]
    starts_mask[border] = solid[border]
    starts = np.flatnonzero(starts_mask)
    ends_mask = solid.copy()
    ends_mask[:-1] &= space[1:]
    border = border[border > 0]
    ends_mask[border - 1] = solid[border - 1]
    ends = np.flatnonzero(ends_mask) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(n, inverse=True)[starts])


def hash_bytes(text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
