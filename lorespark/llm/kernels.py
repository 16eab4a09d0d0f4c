"""Numpy kernels that the operators of this subpackage run inside Spark tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text.
All kernels work on the concatenated bytes of several documents, in slices of a
few megabytes, so that a task's memory does not depend on its partition's size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives memory that a task has freed back to the system, as workers live on after it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = made
        return made[:n]
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    if held is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes (a longer text stands alone): lo, hi, bytes, offsets."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's first word (len+1)."""
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = solid[inner]
    ends = solid.copy()
    if len(data):
        ends[:-1] &= ~solid[1:]
        last = offsets[1:-1] - 1
        last = last[last >= 0]
        ends[last] = solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if lower:
        data = _LOWER[data]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(data) + 1)[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (len-size+1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power("up", _BASE, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _power("down", _BASE_INV, n + 1)[:n])


def span_hashes(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the word hashes from each ``first`` up to its ``stop``; equal to run_hashes for equal runs."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power("up", _BASE, len(words)), out=sums[1:])
    return mix((sums[stop] - sums[first]) * _power("down", _BASE_INV, len(words) + 1)[first])


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the number (or weight) of each."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, weights
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


class Tally:
    """Counts of 64-bit keys in bounded memory: flushed when it holds ``limit`` keys."""

    def __init__(self, limit: int = 1_500_000):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = counted(keys)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > self.limit:
            self.merge()
            if self.held > self.limit // 2:
                yield from self.flush()

    def merge(self) -> None:
        if self.parts:
            keys = np.concatenate([k for k, _ in self.parts])
            self.parts = [counted(keys, np.concatenate([n for _, n in self.parts]))]
            self.held = len(self.parts[0][0])

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.merge()
        for keys, n in self.parts:
            for at in range(0, len(keys), 200_000):
                yield keys[at:at + 200_000], n[at:at + 200_000]
        self.parts, self.held = [], 0


class KeyTable:
    """Open addressing over distinct 64-bit keys: vectorised lookup of positions."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        bits = max(4, int(np.ceil(np.log2(max(1, self.n) * 1.5))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.place = np.full(1 << bits, -1, np.int32)
        left = np.arange(self.n)
        slot = self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            self.keys[slot[free]] = keys[left[free]]
            lost = self.place[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the array the table was built from, or -1."""
        slot = self._slot(keys)
        out = self.place[slot]
        if not self.n:
            return out
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            at = (slot[wrong] + 1) & self.mask
            slot[wrong] = at
            got = self.place[at]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[at] != keys[wrong])]
        return out


def per_row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, by differences of a running sum within the slice."""
    sums = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
