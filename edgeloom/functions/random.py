"""Stateless random numbers: hashes of a seed and the row's own keys, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(seed: int | Column, *keys: str | Column) -> Column:
    return F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, *keys)


def uniform(seed: int | Column, *keys: str | Column) -> Column:
    """In [0, 1), with 53 bits."""
    return F.shiftrightunsigned(bits(seed, *keys), 11) * F.lit(2.0**-53)


def below(n: Column, seed: int | Column, *keys: str | Column) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(bits(seed, *keys), n)


def normal(seed: int, *keys: str | Column) -> Column:
    """N(0, 1) by Box and Muller."""
    u = F.greatest(uniform(seed, *keys), F.lit(2.0**-53))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))
