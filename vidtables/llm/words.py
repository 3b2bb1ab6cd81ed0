"""Words and word shingles of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes other than ASCII white space. Words are hashed by a polynomial
over their lower-cased bytes (A-Z only), so a batch of texts is hashed in a few passes
over its bytes, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE = 1 << 20  # bytes hashed at once
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n."""
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(max(n, PIECE) + 1, U(b))
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Words of rows lo to hi: start, end (bytes), hash, and first[i], the first word of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int = 0, hi: int | None = None, hashes: bool = True):
        hi = len(offsets) - 1 if hi is None else hi
        self.data = data = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        word = ~SPACE[data]
        edge = at[at < len(data)]
        begins, ends = word.copy(), word.copy()
        if len(data):
            begins[1:] &= ~word[:-1]
            begins[edge] = word[edge]
            ends[:-1] &= ~word[1:]
            last = edge[edge > 0] - 1
            ends[last] = word[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        if hashes:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo, n = 0, len(self.start)
        while lo < n:
            zero = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, zero + PIECE, "right")))
            piece = LOWER[self.data[zero : self.end[hi - 1]]]
            up, down = powers(len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece + U(1)) * up[: len(piece)], out=sums[1:])
            a, b = self.start[lo:hi] - zero, self.end[lo:hi] - zero
            out[lo:hi] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            lo = hi
        return out

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles and first[i], the first shingle of row i.

        A row with fewer words, but one at least, has the whole sequence as its one shingle.
        """
        h, first = self.hash, self.first
        n = np.diff(first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        out_first = np.concatenate(([0], np.cumsum(count)))
        row = np.repeat(np.arange(len(n)), count)
        at = first[:-1][row] + np.arange(len(row)) - out_first[row]
        left = np.minimum(n[row], k)
        out = left.astype(np.uint64)
        for j in range(k):
            inside = j < left
            out = np.where(inside, mix(out + h[np.minimum(at + j, max(len(h) - 1, 0))] * U(2 * j + 3)), out) if len(h) else out
        return out, out_first
