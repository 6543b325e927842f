"""Numpy views of Arrow text columns, for the operators that run inside tasks.

A batch is cut into slices of whole texts of about ``SLICE_BYTES`` so that the
arrays beside it stay small; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Rows of a batch whose bytes are copied out at a time.
ROWS = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Primes and bases (drawn at random once) of the two hashes of a span.
_MODULI = ((2147483647, 1672046353), (2147483629, 870340523))
_powers: dict[tuple[int, int], np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, at least one row each."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a column."""
    for at in range(0, len(column), ROWS):
        data, offsets = flat(column.slice(at, ROWS))
        for lo, hi in slices(offsets, limit):
            yield at + lo, at + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's first word.

    A word is a longest run without the six ASCII white-space characters.
    """
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts, ends = inside.copy(), inside
    starts[1:] &= ~inside[:-1] | first[1:-1]
    tail = np.ones(len(data), dtype=bool)
    if len(data):
        tail[:-1] = ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends & tail) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def _reduced(x: np.ndarray, prime: int) -> np.ndarray:
    """x modulo prime; dividing by a constant is faster than taking the remainder."""
    p = np.uint64(prime)
    return x - x // p * p


def _powers_of(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo prime, by doubling; tables of usual size are kept."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 2)
        have = np.ones(size, dtype=np.uint32)
        done = 1
        while done < size:
            more = min(done, size - done)
            step = np.uint64(pow(base, done, prime))
            have[done : done + more] = _reduced(have[:more].astype(np.uint64) * step, prime)
            done += more
        if size <= 4 * SLICE_BYTES:
            _powers[base, prime] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BLOCK = 1 << 20


class SpanHash:
    """64-bit hashes of any byte ranges of one array, by prefix sums.

    Two polynomial hashes modulo primes of 31 bits: different spans of n bytes have
    equal ones with a probability of about (n / 2^31)^2 under random bases, and no
    family of texts collides by its structure, as it does modulo 2^64.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix, self.shift = [], []
        for prime, base in _MODULI:
            powers, total = _powers_of(base, prime, n), np.zeros(n + 1, dtype=np.uint32)
            carry = np.uint64(0)
            for lo in range(0, n, _BLOCK):
                hi = min(n, lo + _BLOCK)
                terms = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[lo:hi]
                sums = _reduced(np.cumsum(terms, dtype=np.uint64) + carry, prime)
                total[lo + 1 : hi + 1] = sums
                carry = sums[-1]
            self.prefix.append(total)
            self.shift.append(_powers_of(pow(base, -1, prime), prime, n + 1))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        both = []
        for (prime, _), total, shift in zip(_MODULI, self.prefix, self.shift, strict=True):
            apart = total[ends].astype(np.uint64) + np.uint64(prime) - total[starts]
            both.append(_reduced(_reduced(apart, prime) * shift[starts], prime))
        h = both[0] << np.uint64(32) | both[1]
        return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sum_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; ``first`` holds the run starts and the end."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
