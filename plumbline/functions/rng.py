"""Draws that depend on keys alone: the same keys give the same draw on any plan or cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this bound.
SPAN = 1 << 52


def draw(*keys: Column | int | str, backend: str = "xxhash64") -> Column:
    """A whole number in [0, SPAN) for each combination of keys.

    backend "md5" equals `('0x' || substr(md5(k1 || '-' || k2 ...), 1, 13))::BIGINT`
    in other engines; "xxhash64" is several times cheaper.
    """
    columns = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    if backend == "md5":
        text = F.concat_ws("-", *(c.cast("string") for c in columns))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    if backend == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*columns), 12)
    raise ValueError(f"unknown backend: {backend}")


def uniform(*keys: Column | int | str, backend: str = "xxhash64") -> Column:
    """A double in [0, 1)."""
    return draw(*keys, backend=backend) / F.lit(float(SPAN))


def normal(*keys: Column | int | str, backend: str = "xxhash64") -> Column:
    """A standard normal double, from two uniform draws."""
    u = F.greatest(uniform(*keys, "radius", backend=backend), F.lit(1e-300))
    v = uniform(*keys, "angle", backend=backend)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


#: Constants of the 64-bit hash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def draws_of_range(prefix: int, first: int, last: int) -> np.ndarray:
    """`draw(*keys, k)` for the long k of a range, in a task. prefix: `F.xxhash64` of the keys before k."""

    def turned(a: np.ndarray, bits: int) -> np.ndarray:
        high = a << np.uint64(bits)
        a >>= np.uint64(64 - bits)
        a |= high
        return a

    h = np.arange(first, last, dtype=np.uint64)
    h *= _P2
    h = turned(h, 31)
    h *= _P1
    h ^= np.uint64((prefix + int(_P5) + 8) % (1 << 64))
    h = turned(h, 27)
    h *= _P1
    h += _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    h >>= np.uint64(12)
    return h.view(np.int64)
