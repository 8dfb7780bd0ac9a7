"""Deterministic randomness from md5, the same in any engine and under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_of(seed: int, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part...``; as text it orders rows at random."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def whole(key: Column) -> Column:
    """A number in [0, 2^48) from the first twelve digits of an md5 text."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def unit(key: Column) -> Column:
    """A number in (0, 1), with 48 bits."""
    return (whole(key).cast("double") + 0.5) / float(1 << 48)
