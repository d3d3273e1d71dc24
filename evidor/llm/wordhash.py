"""Words, hashes and sketches of Arrow text columns, as numpy arrays over chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64
#: The modulus of polynomial hashes, a Mersenne prime, and the two independent bases.
PRIME = (1 << 61) - 1
BASES = (0x1A5F29C3D8E6B471, 0x0B7D43F86C21E59D)
_P, _LOW32, _LOW29 = U(PRIME), U(0xFFFFFFFF), U((1 << 29) - 1)


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Space, tab, LF, VT, FF, CR.
SPACE = table_of(b" \t\n\v\f\r")
#: Every ASCII byte that is no letter or digit.
NOT_ALNUM = table_of(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of numbers below PRIME, modulo PRIME, from halves of 32 and 29 bits."""
    x1, x0, y1, y0 = x >> U(32), x & _LOW32, y >> U(32), y & _LOW32
    low, mid = x0 * y0, x1 * y0 + x0 * y1
    return reduced((x1 * y1 << U(3)) + (mid >> U(29)) + ((mid & _LOW29) << U(32)) + (low & _P) + (low >> U(61)))


def powers(n: int, which: int = 0, _have: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo PRIME."""
    if len(_have.get((which, 0), ())) < n:
        m = 1 << (n - 1).bit_length()
        for side, base in enumerate((BASES[which], pow(BASES[which], -1, PRIME))):
            p = np.ones(m, U)
            have = 1
            while have < m:
                p[have:2 * have] = times(p[:min(have, m - have)], np.array(pow(base, have, PRIME), U))
                have *= 2
            _have[which, side] = p
    return _have[which, 0][:n], _have[which, 1][:n]


class Prefix:
    """Polynomial hashes modulo PRIME of any spans of a sequence of values, from one cumulative sum.

    Two different sequences of n values have one hash with a probability of n / PRIME; hashes with another base are
    independent.
    """

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = powers(len(values) + 1, which)
        up = up[:-1]
        if values.dtype == np.uint8 and len(values) < 1 << 26:
            low, values = values * (up & _LOW32), values * (up >> U(32))
            high = values + (low >> U(32))
        else:
            low = times(reduced(values.astype(U)), up)
            high = low >> U(32)
        high, low = np.cumsum(high, dtype=U), np.cumsum(low & _LOW32, dtype=U)
        self.sums = np.zeros(len(values) + 1, U)
        self.sums[1:] = reduced((high >> U(29)) + ((high & _LOW29) << U(32)) + low)

    def _hash(self, upper: np.ndarray, lower: np.ndarray, down: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(times(reduced(upper + _P - lower), down) + size * U(0x9E3779B97F4A7C15))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hash(self.sums[end], self.sums[start], self.down[start], (end - start).astype(U))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` values, by its start."""
        n = len(self.sums) - size
        return self._hash(self.sums[size:], self.sums[:n], self.down[:n], np.array([size], U)) if n > 0 else np.zeros(0, U)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them): consecutive rows of about ``most`` bytes. Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of its first word (one more at the end)."""
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[filled] = inside[filled]
    if len(filled) > 1:
        ends[filled[1:] - 1] = inside[filled[1:] - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)
