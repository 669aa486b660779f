"""Draws that depend on a seed and the row's key alone: equal in each run, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(1 << 32)


def bits(seed: str, *keys: Column) -> Column:
    """32 bits of an md5, which other engines can work out too."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(seed: str, *keys: Column) -> Column:
    return bits(seed, *keys) / F.lit(UNIT)


def below(n: Column | int, seed: str, *keys: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(bits(seed, *keys), F.lit(n) if isinstance(n, int) else n).cast("int")


def pick(values: Column, seed: str, *keys: Column) -> Column:
    """An item of an array; null if it is empty."""
    return F.get(values, below(F.greatest(F.size(values), F.lit(1)), seed, *keys))
