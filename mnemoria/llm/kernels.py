"""Vectorised NumPy kernels over Arrow string columns.

Texts are handled as one run of UTF-8 bytes with row offsets, in slices that
fit a processor's cache, so that memory stays bounded whatever a batch holds. Hashes
are polynomials over the bytes modulo the prime 2**31 - 1, kept as prefix sums: the hash of any byte range is a subtraction of two of them. A lane
has two such polynomials with bases of their own, so different strings of n
bytes agree in a lane with probability (n / 2**31)**2 and in both lanes with
its square. (Modulo a power of two this would not hold: Thue-Morse strings
collide under every odd base.)
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 17
try:
    _libc = ctypes.CDLL(None)
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):
    _libc = None
U = np.uint64
PRIME = U((1 << 31) - 1)
_rng = np.random.default_rng(20240229)
#: A random base for each of two polynomials in each of two lanes.
BASES = [int(x) for x in _rng.integers(1 << 20, int(PRIME) - 1, size=4)]
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder modulo 2**31 - 1."""
    out = x & PRIME
    out += x >> U(31)
    return out


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a polynomial's base and of its inverse modulo 2**31 - 1, at least ``n`` of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        out = []
        for base in (BASES[which], pow(BASES[which], -1, int(PRIME))):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:  # the known stretch times base**done
                more = min(done, size - done)
                p[done : done + more] = fold(fold(p[:more] * U(pow(base, done, int(PRIME)))))
                done += more
            out.append(p % PRIME)
        have = _powers[which] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of a sum."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Prefix:
    """Hashes of byte ranges of ``data``, 62 bits a lane."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        self.parts = []
        values = data.astype(np.uint64)
        values += U(1)
        for which in (2 * lane, 2 * lane + 1):
            p, inverse = powers(which, len(data) + 1)
            terms = values * p[: len(data)]  # under 2**40
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(terms if len(data) < 1 << 22 else fold(terms), out=sums[1:])
            self.parts.append((sums, inverse))

    @staticmethod
    def _shifted(difference: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        x = fold(difference)  # under 2**32, as sums stay under 2**63
        x *= inverse
        x = fold(fold(x))
        np.subtract(x, PRIME, out=x, where=x >= PRIME)
        return x

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (self._shifted(sums[end] - sums[start], inverse[start]) for sums, inverse in self.parts)
        return mix(mix((one << U(31)) | two) + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """The hash of each ``width`` bytes, as a call gives it."""
        one, two = (self._shifted(sums[width:] - sums[:-width], inverse[: len(sums) - width]) for sums, inverse in self.parts)
        return mix(mix((one << U(31)) | two) + U(width))

    def windows(self, width: int) -> np.ndarray:
        """A hash below 2**31 - 1 of each ``width`` bytes."""
        sums, inverse = self.parts[0]
        return self._shifted(sums[width:] - sums[:-width], inverse[: len(sums) - width])


def give_back() -> None:
    """Returns free memory to the system: workers are used again, and would keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) over a string column; null counts as empty.

    A slice has ``limit`` bytes at most, or one row that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    if at[n] - at[0] > SLICE_BYTES:
        give_back()


def row_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    """For each of n + 1 places, whether a row begins (or the last one ends) there."""
    mark = np.zeros(n + 1, bool)
    mark[offsets] = True
    return mark


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, its first word's index (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    black, mark = ~WHITE[data], row_starts(n, offsets)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~black[:-1]
    after[-1], after[:-1] = True, ~black[1:]
    start = np.flatnonzero(black & (before | mark[:n]))
    end = np.flatnonzero(black & (after | mark[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``, in 64-bit integers or doubles."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles and each row's first one's index (one more at the end).

    A row of fewer than k words has one shingle, its whole sequence; a row without words has none.
    """
    n_words = np.diff(first)
    n_out = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=bounds[1:])
    row = np.repeat(np.arange(len(n_out)), n_out)
    at = first[:-1][row] + (np.arange(bounds[-1]) - bounds[:-1][row])
    out = np.zeros(len(at), np.uint64)
    stop = first[1:][row]
    for j in range(k):
        here = at + j
        there = here < stop
        word = hashes[np.minimum(here, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(there, mix(out * U(0x9E3779B97F4A7C15) + word + U(j + 1)), out)
    return out, bounds
