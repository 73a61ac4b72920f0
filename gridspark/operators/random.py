"""Uniform numbers from a counter: xorshift64* of the seed and an element's position, so any partitioning gives the same."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions import unsigned

# The generator's offset and multiplier, and the ends that uniforms are kept within.
GOLDEN = 0x9E3779B97F4A7C15
MULTIPLIER = 2685821657736338717
LEAST = 1e-16


def signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


def uniform(flat: Column, seed: int, float32: bool = False) -> Column:
    """A number in (0, 1) for each position; seed 0 draws a seed."""
    seed = seed or secrets.randbits(63) or 1
    s = F.lit(signed(seed)).bitwiseXOR(flat + F.lit(signed(GOLDEN)))
    s = s.bitwiseXOR(F.shiftrightunsigned(s, 12))
    s = s.bitwiseXOR(F.shiftleft(s, 25))
    s = s.bitwiseXOR(F.shiftrightunsigned(s, 27))
    bits = unsigned.multiply(unsigned.from_bits(s), unsigned.literal(MULTIPLIER).cast(unsigned.TYPE))
    u = F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), bits.cast("double") / F.lit(float(1 << 64))))
    return u.cast("float").cast("double") if float32 else u
