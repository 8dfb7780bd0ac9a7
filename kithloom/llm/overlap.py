"""Overlap sizes between many large sets from bottom-k hash sketches.

A set's sketch is its k smallest 64-bit hashes; sets of at most k items are held whole. Two sketches merge by keeping
the k smallest hashes of their union: the largest of these gives the union's size, the part of them found in both sketches
the shared fraction, and the product the size of the intersection.

Pairs are discovered from the sketches, never from all pairs of sets: the sketch of the smaller set of a pair is a
uniform sample of it, so its hashes are looked up among all members, which works whatever the sizes of the two sets are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kithloom.operators.pairs import BLOCK, shared_counts
from kithloom.operators.skew import lookup_join
from kithloom.session import cut

#: Hashes a sketch holds.
SKETCH = 512
#: A member of more sets than this isn't used to discover pairs, as far as the pairs' own margin allows it.
HOT_DEGREE = 64
#: Standard deviations a sketch's finding may be off before a pair is given up.
SIGMAS = 6.0


def set_members(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct (g, x) of the rows in which neither column is null."""
    return rows.select(F.col(group).alias("g"), F.col(item).alias("x")).dropna().distinct()


def bottom_k(members: DataFrame, k: int = SKETCH) -> DataFrame:
    """(g, h) with the k smallest hashes of each set, from distinct (g, x).

    The rank limit is applied within each task before rows are shuffled, so a huge set sends at most k rows a task.
    """
    hashed = members.select("g", F.xxhash64("x").alias("h"))
    return hashed.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("r") <= k).drop("r")


def merged_estimate(a: Column, b: Column, n_a: Column, n_b: Column, k: int = SKETCH) -> tuple[Column, Column, Column]:
    """(union size, shared fraction, intersection size) of two sets from their sketches, as ascending arrays of hashes.

    n_a and n_b are the sets' sizes; where neither exceeds k the sketches are whole and the three are exact.
    """
    merged = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    whole = (n_a <= k) & (n_b <= k)
    both = F.array_intersect(a, b)
    top = F.element_at(merged, -1)
    place = (top.cast("double") + 2.0**63) / 2.0**64
    union = F.when(whole, F.size(F.array_union(a, b)).cast("double")).otherwise((F.size(merged) - 1) / place)
    shared = F.when(whole, F.size(both) / F.size(F.array_union(a, b))).otherwise(F.size(F.filter(both, lambda h: h <= top)) / F.size(merged))
    return union, shared, union * shared


def shared_bounds(fraction: Column, n_a: Column, n_b: Column, k: int = SKETCH, sigmas: float = SIGMAS) -> tuple[Column, Column]:
    """The least and the most items that two sets of known sizes share by the shared fraction of their merged sketch.

    A fraction f of the union is n_a + n_b items, the shared ones counted twice: shared = f (n_a + n_b) / (1 + f). The fraction is off
    by at most ``sigmas`` standard deviations of k draws; of sets held whole it is exact.
    """
    spread = sigmas * F.sqrt(F.greatest(fraction, F.lit(sigmas * sigmas / k)) / k)
    spread = F.when((n_a <= k) & (n_b <= k), 1e-9).otherwise(spread)
    low, high = F.greatest(F.lit(0.0), fraction - spread), F.least(F.lit(1.0), fraction + spread)
    return low * (n_a + n_b) / (1 + low), high * (n_a + n_b) / (1 + high)


def estimate_pairs(members: DataFrame, pairs: DataFrame, k: int = SKETCH) -> DataFrame:
    """(a, b, n_a, n_b, union_est, fraction_est, shared_est) of given pairs (a, b) of sets, from their merged sketches; no bounds.

    Repeated pairs come out once; a set without members has size 0 and shares nothing.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("n"))
    arrays = bottom_k(members, k).groupBy("g").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    held = sizes.join(arrays, "g")
    asked = pairs.select("a", "b").dropna().distinct()
    for side in ("a", "b"):
        asked = asked.join(held.select(F.col("g").alias(side), F.col("n").alias(f"n_{side}"), F.col("hs").alias(f"hs_{side}")), side, "left")
    none = F.array().cast("array<bigint>")
    asked = asked.fillna(0, ["n_a", "n_b"]).withColumn("hs_a", F.coalesce("hs_a", none)).withColumn("hs_b", F.coalesce("hs_b", none))
    estimates = merged_estimate(F.col("hs_a"), F.col("hs_b"), F.col("n_a"), F.col("n_b"), k)
    names = ("union_est", "fraction_est", "shared_est")
    return asked.select("a", "b", "n_a", "n_b", *(F.coalesce(e, F.lit(0.0)).alias(n) for e, n in zip(estimates, names)))


def overlapping_pairs(
    members: DataFrame, min_shared: int, min_part: float, k: int = SKETCH, hot: int = HOT_DEGREE, sigmas: float = SIGMAS
) -> DataFrame:
    """Pairs of sets that may share ``min_shared`` items and the part ``min_part`` of the smaller set's items.

    From distinct (g, x): (small, large, n_small, n_large, union_est, fraction_est, shared_est, surely), one row per pair; small has
    fewer items (of equal sets, the first by name). Every pair that meets both bounds is among them, but for chances below
    1e-8 a pair. ``surely`` says that a sketch leaves no doubt that it does: the small set's as a sample, of which so many are found
    in the large set, or the merged one. The others may fall a little short and want an exact count.

    A set's sketch must meet the other set in at least ``need`` hashes: all that the bounds ask for where the sketch is the
    whole set, else the expected number less ``sigmas`` standard deviations. Hashes found in more than ``hot`` sets are left
    out of the lookup as long as fewer than ``need`` of a set's hashes are; what is left out is allowed for, so no pair
    depends on them. A set with more hot hashes than that keeps the less common of them; the rows of such a hash are spread by
    the small set, over a task for each ``hot`` sets that hold it.
    """
    if min_shared < 1 or not 0 < min_part <= 1 or not 8 <= k <= 1000:
        raise ValueError("min_shared must be 1 or more, min_part within (0, 1], k within 8 to 1000")
    sizes = cut(members.groupBy("g").agg(F.count("*").alias("n")))
    hashed = members.select("g", F.xxhash64("x").alias("h"))
    common = hashed.groupBy("h").agg(F.count("*").alias("d")).where("d > 1").withColumn("spread", F.ceil(F.col("d") / hot))
    sketch = cut(bottom_k(members, k))
    # of n items at least s are shared; of k sampled ones about k s / n, give or take the deviation of that draw
    part = F.greatest(F.lit(float(min_part)), F.lit(float(min_shared)) / F.col("n"))
    whole_need = F.greatest(F.lit(min_shared), F.ceil(F.col("n") * F.lit(float(min_part)) - 1e-9))
    deviation = sigmas * math.sqrt(k) * F.sqrt(part * F.greatest(F.lit(0.0), 1 - part))
    is_whole = F.col("n") <= k
    needs = (
        sizes.where(F.col("n") >= min_shared)
        .withColumn("need", F.greatest(F.lit(1), F.when(is_whole, whole_need).otherwise(F.floor(k * part - deviation))).cast("long"))
        .withColumn("enough", F.when(is_whole, whole_need).otherwise(F.ceil(k * part + deviation)).cast("long"))
        .withColumnRenamed("n", "n_small")
    )
    ranked = Window.partitionBy("g").orderBy(F.desc("d"), "h")
    probe = (
        sketch.join(common, "h")
        .join(needs, "g")
        .withColumn("left_out", (F.row_number().over(ranked) < F.col("need")) & (F.col("d") > hot))
        .withColumn("n_out", F.sum(F.col("left_out").cast("long")).over(Window.partitionBy("g")))
        .where(~F.col("left_out"))
        .select(
            F.col("g").alias("small"), "n_small", "h", F.pmod(F.xxhash64("g"), F.col("spread")).alias("salt"), (F.col("need") - F.col("n_out")).alias("to_meet"), "enough"
        )
    )
    index = lookup_join(hashed.join(common, "h"), sizes, ["g"]).select(
        F.col("g").alias("large"), F.col("n").alias("n_large"), "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)).alias("salt")
    )
    bigger = (F.col("n_large") > F.col("n_small")) | ((F.col("n_large") == F.col("n_small")) & (F.col("large") > F.col("small")))
    met = (
        probe.join(index, ["h", "salt"])
        .where(bigger)
        .groupBy("small", "large", "n_small", "n_large", "to_meet", "enough")
        .agg(F.count("*").alias("n_met"))
        .where(F.col("n_met") >= F.col("to_meet"))
        .withColumn("found", F.col("n_met") >= F.col("enough"))
        .drop("n_met", "to_meet", "enough")
    )
    arrays = sketch.groupBy("g").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    with_arrays = met.join(arrays.select(F.col("g").alias("small"), F.col("hs").alias("hs_a")), "small").join(
        arrays.select(F.col("g").alias("large"), F.col("hs").alias("hs_b")), "large"
    )
    union, fraction, shared = merged_estimate(F.col("hs_a"), F.col("hs_b"), F.col("n_small"), F.col("n_large"), k)
    out = with_arrays.select("small", "large", "n_small", "n_large", union.alias("union_est"), fraction.alias("fraction_est"), shared.alias("shared_est"), "found")
    # the merged sketch may rule a pair out, or in
    least, most = shared_bounds(F.col("fraction_est"), F.col("n_small"), F.col("n_large"), k, sigmas)
    wanted = F.greatest(F.lit(float(min_shared)), F.lit(float(min_part)) * F.col("n_small"))
    near = F.lit(1e-6)
    return out.where(most >= wanted - near).withColumn("surely", F.col("found") | (least >= wanted + near)).drop("found")


def exact_shared(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with n_shared, the exact number of items in both sets; pairs without any are left out."""
    pairs = cut(pairs)
    ours = lookup_join(members.withColumnRenamed("g", "small"), pairs.select("small", "large"), ["small"])
    theirs = members.withColumnRenamed("g", "large")
    counts = ours.join(theirs, ["large", "x"], "left_semi").groupBy("small", "large").agg(F.count("*").alias("n_shared"))
    return pairs.join(counts, ["small", "large"])


def all_shared(members: DataFrame, hot: int = HOT_DEGREE, block: int = BLOCK) -> DataFrame:
    """(a, b, n_a, n_b, n_shared) of every pair of sets with a common item, a < b, all exact; from distinct (g, x).

    See shared_counts: items of very many sets are bits of words, so that 64 of them cost a pair of sets one row.
    """
    sizes = cut(members.groupBy("g").agg(F.count("*").alias("n")))
    found = shared_counts(members, hot, block)
    for side in ("a", "b"):
        found = lookup_join(found, sizes.select(F.col("g").alias(side), F.col("n").alias(f"n_{side}")), [side])
    return found.select("a", "b", "n_a", "n_b", "n_shared")
