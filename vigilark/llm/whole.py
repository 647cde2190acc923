"""Vectors of whole numbers: exact products by matrix multiplication in double precision.

A number is cut into limbs of a few bits; products of limbs summed over a vector stay below 2^53, where doubles are
exact, and are put together again as 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component.

    Components beyond a power of two that the number of components sets (2^27 of 64) count as that power, so that
    squared distances and products of two vectors always fit a long.
    """
    most = F.pow(F.lit(2.0), F.floor((61 - F.log2(F.greatest(F.size(vector), F.lit(1)))) / 2))
    return F.transform(vector, lambda v: F.floor(F.greatest(F.least(v.cast("double") * F.lit(float(scale)), most), -most)))


def limb_bits(width: int) -> int:
    """Bits of a limb: width * 2^(2 * bits) stays below 2^53."""
    return (52 - math.ceil(math.log2(max(1, width)))) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as doubles, lowest limb first; the last limb carries the sign."""
    out = []
    while x.size and max(-int(x.min()), int(x.max())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Inner products of the rows of x with the rows of y, exact where they fit 64 bits."""
    bits = limb_bits(x.shape[1]) if bits is None else bits
    out = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out
