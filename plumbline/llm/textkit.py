"""Vectorised helpers over the bytes of an Arrow string column.

All functions work on one slice of rows at a time (`slices`), so a task's
memory follows the slice and not the partition. Positions are byte offsets in
the slice's buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are hashed at once; a longer row is a slice of its own.
SLICE_BYTES = 1 << 20

#: Hashes are polynomials modulo this prime, for two bases drawn at random: two different
#: strings of n symbols agree in both with a chance of (n / 2 ** 31) ** 2 at most.
_PRIME = (1 << 31) - 1
_rng = np.random.default_rng(20240229)
_SYMBOL = _rng.integers(1, _PRIME, (2, 256), dtype=np.uint64)
_BASES = [int(b) for b in _rng.integers(1 << 20, _PRIME, 2)]
_powers: dict[int, np.ndarray] = {}

#: True for the bytes that separate words: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, by the prime's form."""
    x = (x & U(_PRIME)) + (x >> U(31))
    x = (x & U(_PRIME)) + (x >> U(31))
    return x - (x >= U(_PRIME)) * U(_PRIME)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo _PRIME; kept for the next call while short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U)
        while len(have) < max(n, 1 << 16):  # twice as many at a time
            have = np.concatenate([have, _mod(have * U(pow(base, len(have), _PRIME)))])
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def _symbol_sums(symbols: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
    """For both bases the prefix sums of symbol * base ** position, symbols below 2 ** 31.

    symbols: a row for each base, or with tables one row of positions in them. Terms
    are folded once, to below 2 ** 33; blocks stay in the processor's cache.
    """
    n = symbols.shape[-1]
    out = np.zeros((2, n + 1), U)
    for j, base in enumerate(_BASES):
        power, own, sums = powers(base, n), symbols if tables is not None else symbols[j], out[j, 1:]
        for at in range(0, n, 1 << 14):
            part = slice(at, at + (1 << 14))
            x = (tables[j][own[part]] if tables is not None else own[part]) * power[part]
            np.add(x & U(_PRIME), x >> U(31), out=sums[part])
        np.cumsum(sums, out=sums)
    return out


def _spans(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, place: np.ndarray | slice, size: int) -> np.ndarray:
    """Both hashes of spans in one number; place: of the power that moves each span to 0, below size."""
    out = []
    for s, base in zip(sums, _BASES, strict=True):
        out.append(_mod(_mod(s[end] - s[start]) * powers(pow(base, -1, _PRIME), size)[place]))
    return mix(out[0] << U(31) | out[1])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, one longer than the input; unsigned values wrap."""
    out = np.zeros(len(values) + 1, values.dtype if values.dtype == U else np.int64)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Slice:
    """Rows `first` to `first + len(offsets) - 1` of a batch, as bytes with row offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about `size` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a slice: their bytes, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray  # rows + 1 positions in start
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words_of(s: Slice, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not separators, within each row."""
    n = len(s.data)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(s.rows + 1, np.int64), np.zeros(0, np.int64))
    inside = ~separator[s.data]
    edge = np.zeros(n + 1, bool)
    edge[s.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row_at = np.searchsorted(start, s.offsets)
    return Words(start, end, row_at, np.repeat(np.arange(s.rows), np.diff(row_at)))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any span."""
    return _symbol_sums(data, _SYMBOL)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: equal bytes give equal hashes wherever they stand."""
    if len(start) == 0:
        return np.zeros(0, U)
    return _spans(sums, start, end, start, int(start.max()) + 1)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of every n consecutive word hashes, row borders ignored."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    sums = _symbol_sums(np.stack([words & U(_PRIME), words >> U(33)]))  # different bits of a word's hash for each base
    return _spans(sums, slice(0, m), slice(n, None), slice(0, m), m)


def whole_grams(w: Words, n: int) -> np.ndarray:
    """Positions at which n consecutive words lie in one row."""
    m = len(w) - n + 1
    return np.flatnonzero(w.row[:m] == w.row[n - 1 :]) if m > 0 else np.zeros(0, np.int64)


def cover(at: np.ndarray, length: int, size: int) -> np.ndarray:
    """True for the positions inside a span of `length` that begins at one of `at`."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def row_sums(values: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions of row_at, as integers."""
    return np.diff(prefix(values.astype(np.int64))[row_at])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it is not its first occurrence."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    again = np.zeros(len(keys), bool)
    many = np.zeros(len(keys), bool)
    again[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, again
