"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is what its target share of the total asks for, at most its cap. Every document gets a
uniform number from a hash of (seed, id) and so many copies as the inverse of a Poisson distribution, cut at the cap, gives
for it; the distribution's mean is chosen so that the cut one has the wanted rate. Copies are then shuffled globally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from kithloom.operators.skew import skew_join

#: Rows of a plan that are broadcast at most, some 50 bytes each; a longer one is joined by shuffling, with heavy sources spread.
BROADCAST_SOURCES = 10_000
#: Standard deviations around the mode that a distribution's table covers.
REACH = 40


def spelled(source):
    """Source names as they are compared: trimmed, lower case, null if nothing is left."""
    return F.nullif(F.lower(F.btrim(F.col(source), F.lit(" \t\r\n"))), F.lit(""))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per source; rows with a null are left out, a source stated twice counts once (its largest share)."""
    named = targets.select(spelled("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).dropna()
    return named.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")


def mixture_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of ``targets`` can give: (source, target_share, max_repeats, n_docs, n_tokens, total_tokens, rate, planned_share, is_short).

    ``sized`` has (source, n_tokens) of each document. total_tokens, those of all listed sources once, is the mixture's
    size. rate is the mean number of copies of a document, planned_share the share of total_tokens that the source then
    reaches. A source without tokens and with a target is short; with no tokens at all every target is met by nothing.
    """
    counts = sized.groupBy(spelled("source").alias("source")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    listed = clean_targets(targets).join(counts, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    total = listed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).scalar()
    wanted = F.col("target_share") * F.col("total_tokens")
    return (
        listed.withColumn("total_tokens", total)
        .withColumn("is_short", F.col("max_repeats") * F.col("n_tokens") < wanted)
        .withColumn("rate", F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.least(F.col("max_repeats").cast("double"), wanted / F.col("n_tokens"))))
        .withColumn("planned_share", F.coalesce(F.try_divide(F.col("rate") * F.col("n_tokens"), F.col("total_tokens")), F.lit(0.0)))
        .select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "total_tokens", "rate", "planned_share", "is_short")
    )


def _poisson(mean: float, cap: int) -> tuple[int, np.ndarray]:
    """(first, P(first), P(first + 1), ...) of a Poisson distribution wherever it matters below ``cap``, all from ``cap`` on as the last.

    Built from the mode outwards by the ratios of neighbours, so nothing underflows however large the mean is.
    """
    mode, spread = int(mean), REACH * math.sqrt(mean) + 2 * REACH
    low, high = max(0, int(mode - spread)), int(mode + spread) + 1
    up = np.cumprod(mean / np.arange(mode + 1, high + 1, dtype=float))
    down = np.cumprod(np.arange(mode, low, -1, dtype=float) / mean)[::-1]
    p = np.concatenate([down, [1.0], up])
    p /= p.sum()
    if cap <= low:
        return cap, np.ones(1)
    return (low, np.append(p[: cap - low], p[cap - low :].sum())) if cap <= high else (low, p)


def _cut_mean(mean: float, cap: int) -> float:
    """The mean of the distribution cut at ``cap``."""
    first, p = _poisson(mean, cap)
    return float(np.dot(p, np.minimum(first + np.arange(len(p)), cap)))


@lru_cache(maxsize=4096)
def uncut_mean(rate: float, cap: int) -> float:
    """The mean of the Poisson distribution whose mean, cut at ``cap``, is ``rate``; 0 for no copies, infinite for all ``cap`` of them."""
    if rate <= 0 or cap <= 0:
        return 0.0
    if rate >= cap:
        return math.inf
    low, high = 0.0, max(1.0, rate)
    most = cap + 50 * math.sqrt(cap) + 2000  # beyond it the cut distribution is its cap
    while _cut_mean(high, cap) < rate and high < most:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if _cut_mean(mid, cap) < rate else (low, mid)
    return high


@lru_cache(maxsize=4096)
def _limits(mean: float, cap: int) -> tuple[int, np.ndarray]:
    """(first, P(copies <= first), P(copies <= first + 1), ...) without the last, which is 1."""
    first, p = _poisson(mean, cap)
    return first, np.cumsum(p)[:-1]


def draw_copies(u: np.ndarray, rate: float, cap: int) -> np.ndarray:
    """Copies for uniform numbers within (0, 1): the inverse of the cut distribution of mean ``rate``."""
    mean = uncut_mean(rate, cap)
    if mean == 0 or math.isinf(mean):
        return np.full(len(u), 0 if mean == 0 else cap, np.int64)
    first, limits = _limits(mean, cap)
    return first + np.searchsorted(limits, u, "left").astype(np.int64)


@F.pandas_udf(T.LongType())
def _copies(u: pd.Series, rate: pd.Series, cap: pd.Series) -> pd.Series:
    out = np.zeros(len(u), np.int64)
    frame = pd.DataFrame({"rate": rate.to_numpy(), "cap": cap.to_numpy()})
    for (r, c), at in frame.groupby(["rate", "cap"]).indices.items():
        out[at] = draw_copies(u.to_numpy()[at], float(r), int(c))
    return pd.Series(out)


def replicate(docs: DataFrame, key: str, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` (with source) as the mixture of ``plan``: each document with copy = 1, 2, ... to its number of copies.

    The same seed gives the same copies whatever the partitioning. Documents of unlisted or null sources have none; a
    document whose key is null, or repeated, is drawn like any other (repeated rows alike). Plans may have any number of sources.
    """
    drawn = plan.where("rate > 0").select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("max_repeats").cast("long").alias("__cap"))
    # 52 bits of the hash, in the middle of their interval: within (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 12).cast("double") + 0.5) / 2.0**52
    named = docs.withColumn("__source", spelled("source"))
    few = drawn.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = named.join(F.broadcast(drawn), "__source") if few else skew_join(named, drawn, ["__source"])
    return (
        joined.withColumn("__n", _copies(u, F.col("__rate"), F.col("__cap")))
        .where("__n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
        .drop("source", "__rate", "__cap", "__n")
        .withColumnRenamed("__source", "source")
    )


def shuffled(mixture: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """The rows in a global order that a hash of (seed, keys) fixes: range-partitioned by it and sorted, with the column shuffle_key."""
    return mixture.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), *keys)).orderBy("shuffle_key", *keys)


def reached_shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, total_tokens, planned_share, reached_tokens, reached_share, most_copies) of a mixture with n_tokens and copy."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("reached_tokens"), F.max("copy").alias("most_copies"))
    kept = plan.select("source", "target_share", "max_repeats", "n_tokens", "total_tokens", "planned_share")
    joined = kept.join(got, "source", "left").fillna(0, ["reached_tokens", "most_copies"])
    total = joined.agg(F.sum("reached_tokens").alias("n")).scalar()
    return joined.withColumn("reached_share", F.coalesce(F.try_divide(F.col("reached_tokens"), total), F.lit(0.0)))


def short_sources(shares: DataFrame) -> DataFrame:
    """The rows of reached_shares whose source stays short: each document is there as often as allowed, and that isn't enough.

    Only a source whose rate is its cap has all its copies for sure, and one that has them by chance reaches its target.
    """
    everything = F.col("reached_tokens") == F.col("max_repeats") * F.col("n_tokens")
    return shares.where(everything & (F.col("reached_tokens") < F.col("target_share") * F.col("total_tokens")))
