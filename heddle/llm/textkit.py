"""Vectorised word handling over Arrow string columns, shared by the operators that read whole texts.

Texts stay in Arrow's contiguous buffer. A block of at most ``BLOCK`` bytes (or one longer document) is cut
into words and hashed with a few NumPy passes, so the cost of a word doesn't depend on Python's interpreter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

BLOCK = 1 << 20

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)
#: By how many bytes of a lane of eight are in a range: which bits of the lane count.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)
#: Lanes of a range that are hashed for all ranges at once; longer ranges are hashed one by one.
LANES = 32

#: Bytes that separate words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that aren't in a word of a licence scan: ASCII but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = False
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Words:
    """The words of consecutive documents: byte ranges in ``data``, and ``first[i]:first[i + 1]`` for document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, bool)
        np.logical_not(breaks[data], out=inside[:-1])
        starts = inside[:-1].copy()
        starts[1:] &= ~inside[:-2]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[heads] = inside[heads]
        ends = inside[:-1] & ~inside[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[tails] = inside[tails]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hashes(self.data, self.start, self.end)

    def left(self) -> np.ndarray:
        """How many words of its document stand at or after each word."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step, each step mixed so that nothing cancels."""
    n = end - start
    h = mix(n.astype(U64) * ODD)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    live, k = np.flatnonzero((n > 0) & (n <= 8 * LANES)), 0
    while len(live):
        left = n[live] - 8 * k
        h[live] = mix((h[live] ^ (lanes[start[live] + 8 * k] & _MASK[np.minimum(left, 8)])) * _STEP)
        live, k = live[left > 8], k + 1
    for i in np.flatnonzero(n > 8 * LANES).tolist():
        h[i] = xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run h[first:last] of values."""
    n = last - first
    out = mix(n.astype(U64) * ODD + U64(1))
    live, k = np.flatnonzero((n > 0) & (n <= LANES)), 0
    while len(live):
        out[live] = mix(out[live] * _STEP + h[first[live] + k])
        k += 1
        live = live[n[live] > k]
    for i in np.flatnonzero(n > LANES).tolist():
        out[i] = xxh3_64_intdigest(np.ascontiguousarray(h[first[i] : last[i]]))
    return out


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k values, from those of its parts of a power of two; the last k - 1 results are over fewer
    and mean nothing."""
    n = len(h)
    out = np.full(n, mix(np.full(1, (seed * int(ODD) + int(k)) % (1 << 64), U64))[0], U64)
    part, size, at = h, 1, 0
    while k and at < n:
        if k & 1:
            out[: n - at] = mix(out[: n - at] * _STEP + part[at:])
            at += size
        k >>= 1
        if k and size < n:
            part = part.copy()
            part[: n - size] = mix(part[: n - size] * _STEP + part[size:])
        size *= 2
    return out


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of consecutive documents, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def release() -> None:
    """Gives memory that this process has freed back to the system, which allocators otherwise keep for its next use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
