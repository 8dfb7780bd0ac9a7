"""Distinct counts over huge identifier sets: multiresolution bitmaps as plain rows.

An id's hash puts it into slice l with probability 2^-(l+1) and sets one of BITS bits there. A sketch is a set of rows
(keys, slot, bits), a slot being one 64-bit word of one slice's bitmap; only words with a bit are rows. Sketches merge by OR,
which is an ordinary bit_or aggregate, so partial sketches of days, communities or loads combine exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of each slice's bitmap, and slices; the last slice takes the rest. Good for about BITS * 2^SLICES ids.
BITS, SLICES = 16384, 28
WORDS = BITS // 64
#: A slice with more set bits than this is saturated; the estimate starts above the last such slice.
SATURATED = BITS * 4 // 5


def sketch(rows: DataFrame, keys: Sequence[str], ids: Column) -> DataFrame:
    """(keys, slot, bits) of the non-null values of ``ids`` for each combination of ``keys`` (null is a value of a key).

    Rows are combined within each task first, so a hot key sends at most its bitmap from each task.
    """
    h = F.xxhash64("__id")
    low = F.col("__h").bitwiseAND(F.lit((1 << (SLICES - 1)) - 1))
    # zeros below the lowest set bit; none set: the last slice
    level = F.when(F.col("__low") == 0, F.lit(SLICES - 1)).otherwise(F.bit_count(F.col("__low").bitwiseAND(-F.col("__low")) - 1))
    place = F.shiftrightunsigned("__h", 40).bitwiseAND(F.lit(BITS - 1))
    return (
        rows.select(*keys, ids.alias("__id"))
        .where(F.col("__id").isNotNull())
        .select(*keys, h.alias("__h"))
        .withColumn("__low", low)
        .withColumn("__p", place.cast("int"))
        .select(*keys, (level * WORDS + F.shiftright("__p", 6)).cast("int").alias("slot"), F.expr("shiftleft(1L, __p & 63)").alias("bits"))
        .groupBy(*keys, "slot")
        .agg(F.bit_or("bits").alias("bits"))
    )


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches combined to coarser (or other) ``keys``."""
    return sketches.groupBy(*keys, "slot").agg(F.bit_or("bits").alias("bits"))


def estimate(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_est, rel_error) of each sketch; rel_error is the estimate's own standard error.

    Each unsaturated slice gives -BITS ln(1 - filled part) ids; their sum stands for a 2^-base part of all ids, base being the
    first slice above the saturated ones. The error adds the chance of bits that coincide and of which ids fall into these
    slices; with BITS = 16384 it stays below 0.9 percent at any size, and below 0.4 percent up to some 25,000 ids.
    """
    level = F.floor(F.col("slot") / WORDS)
    filled = [F.coalesce(F.sum(F.when(level == i, F.bit_count("bits"))), F.lit(0)).alias(f"__s{i}") for i in range(SLICES)]
    seen = sketches.groupBy(*keys).agg(*filled).select(*keys, F.array(*(F.least(F.col(f"__s{i}"), F.lit(BITS - 1)) for i in range(SLICES))).alias("__s"))
    base = F.array_max(F.transform("__s", lambda x, i: F.when((x > SATURATED) & (i < SLICES - 1), i + 1).otherwise(0)))
    loads = F.transform(F.slice("__s", F.col("__base") + 1, SLICES), lambda x: F.log(F.lit(float(BITS)) / (BITS - x)))
    ids = BITS * F.aggregate("__loads", F.lit(0.0), lambda a, t: a + t)
    coincide = BITS * F.aggregate("__loads", F.lit(0.0), lambda a, t: a + F.exp(t) - t - 1)
    return (
        seen.withColumn("__base", base)
        .withColumn("__loads", loads)
        .withColumn("__part", ids)
        .withColumn("__scale", F.pow(F.lit(2.0), F.col("__base")))
        .select(
            *keys,
            (F.col("__part") * F.col("__scale")).alias("n_est"),
            (F.sqrt(coincide + F.col("__part") * (1 - 1 / F.col("__scale"))) / F.col("__part")).alias("rel_error"),
        )
    )
