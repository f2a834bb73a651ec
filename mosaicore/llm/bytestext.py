"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch is one ``uint8`` array and the offsets of its texts; it can come straight from an
Arrow column without a copy.  Words and chunks are slices of that array.  Each slice has a
64-bit hash: a polynomial in an odd base modulo 2**64, read off prefix sums, then mixed.  All
functions see bytes only, so their cost does not depend on how many texts share a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
UNBASE = U64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are worked on at a time, unless one text is longer.
SLICE = 1 << 20

#: A-Z as a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is true within the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: What separates words: the space and \t \n \v \f \r.
WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: What separates words of letters and digits: all other ASCII.
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (multiply and shift, twice)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def text_arrays(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column: (first row, bytes, offsets from 0); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; what is kept takes 64 MB at most."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, BASE), np.full(size, UNBASE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 4 << 20:
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """sum of (byte + 1) * BASE**i over the first n bytes, for n from 0 to the length."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed hash of each slice; equal slices have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


class Words:
    """The words of a slice of texts: doc (row in the slice), start, end, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, fold: bool = True):
        self.n_docs, self.offsets = len(offsets) - 1, offsets
        self.data = LOWER[data] if fold else data
        inside = ~apart[self.data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # words end with their text
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # words of text i: bounds[i] to bounds[i + 1]
        self.count = np.diff(self.bounds)
        self.hash = slice_hash(prefix_hash(self.data), self.start, self.end)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)


def shingle_runs(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-word shingles, repeated ones too; bounds of each text's).

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    h, lo, hi = words.hash, words.bounds[:-1], words.bounds[1:]
    rolled = h.copy()
    for k in range(1, n):
        rolled = mix(rolled[: max(0, len(h) - k)] + U64(0x632BE59BD9B4E019)) + h[k:]
    rolled = mix(rolled)
    counts = np.where(hi > lo, np.maximum(hi - lo - n + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(bounds[-1], U64)
    whole = hi - lo >= n
    flat[ragged(bounds[:-1][whole], counts[whole])] = rolled[ragged(lo[whole], counts[whole])]
    for i in np.flatnonzero((hi > lo) & ~whole).tolist():
        x = h[lo[i] : lo[i] + 1]
        for k in range(int(lo[i]) + 1, int(hi[i])):
            x = mix(x + U64(0x632BE59BD9B4E019)) + h[k : k + 1]
        flat[bounds[i]] = mix(x + U64(hi[i] - lo[i]))[0]
    return flat, bounds


def shingle_hashes(words: Words, n: int) -> list[np.ndarray]:
    """Each text's set of n-word shingles as sorted distinct hashes."""
    flat, bounds = shingle_runs(words, n)
    return [np.unique(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
