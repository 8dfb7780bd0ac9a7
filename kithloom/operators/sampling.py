"""Sampling of links, names and sizes; every draw follows from a seed and the keys alone."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from kithloom.functions.hashing import key_of, unit, whole
from kithloom.operators.codes import Codes, coded
from kithloom.operators.order import first_rows, nth_smallest, numbered, ranked, running_total
from kithloom.session import keep

#: Candidates drawn for each non-link wanted, before links and repeats are taken out.
CANDIDATES = 1.5
SIZE_GROUPS = ("min", "quantile10", "quartile1", "median", "mean", "random")


def positive_sample(m: DataFrame, max_edges: int | None = None, seed: int = 0) -> DataFrame:
    """(community, vertex, edge_exist = 1): all links, or ``max_edges`` of them in md5 order, with a warning where there are fewer."""
    if max_edges is None:
        return m.select("community", "vertex", F.lit(1).alias("edge_exist"))
    if (there := m.count()) < max_edges:
        warnings.warn(f"{max_edges} links asked for, {there} exist", stacklevel=2)
    drawn = first_rows(m.withColumn("k", key_of(seed, "community", "vertex")), ["k", "community", "vertex"], max_edges)
    return drawn.select("community", "vertex", F.lit(1).alias("edge_exist"))


def negative_sample(m: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(community, vertex, edge_exist = 0): ``n`` distinct pairs that aren't links, uniform over all such pairs.

    Slots 1, 2, ... each draw a community and a vertex by hash; links and repeats are rejected, the first n slots left count. The
    number of slots grows until enough are left; fewer come out only where fewer non-links exist.
    """
    codes = coded(m)
    return codes.decode(negative_codes(codes, n, seed))


def negative_codes(codes: Codes, n: int, seed: int = 0) -> DataFrame:
    """negative_sample with numbers for names.

    Links and draws are one number each and meet in one shuffle: a pair's first slot counts, and a link has slot 0.
    """
    n_c, n_v, n_m = codes.communities.count(), codes.vertices.count(), codes.links.count()
    spark = codes.links.sparkSession
    pair = lambda ci, vi: ((vi - 1) * F.lit(n_c) + ci - 1).alias("pair")
    links = codes.links.select(pair(F.col("community"), F.col("vertex")), F.lit(0).cast("long").alias("slot"))
    names = ((F.col("pair") % n_c + 1).alias("community"), (F.expr(f"pair div {max(1, n_c)}") + 1).alias("vertex"), F.lit(0).alias("edge_exist"))
    n = min(n, n_c * n_v - n_m)
    if n <= 0:
        return links.select(*names).limit(0)
    slots = candidate_slots(n, n_m, n_c, n_v)
    while True:
        drawn = spark.range(1, slots + 1).select(pair(whole(key_of(seed, F.lit("c"), "id")) % n_c + 1, whole(key_of(seed, F.lit("v"), "id")) % n_v + 1), F.col("id").alias("slot"))
        kept = keep(drawn.unionByName(links).groupBy("pair").agg(F.min("slot").alias("slot")).where("slot > 0"), "drawn")
        if (left := kept.count()) >= n:
            last = nth_smallest(kept, "slot", n, slots) if left > n else slots
            return kept.where(F.col("slot") <= last).select(*names)
        if slots > 40 * n_c * n_v:  # so many draws would have met every pair: take what there is
            return kept.select(*names)
        slots *= 4


def candidate_slots(n: int, n_m: int, n_c: int, n_v: int) -> int:
    """Slots of the first attempt."""
    return math.ceil(CANDIDATES * n / (1 - n_m / (n_c * n_v))) + 100


def draw_names(df: DataFrame, group: list[str], name: str, k: Column | int, seed: int) -> DataFrame:
    """``k`` names of each group without replacement (R3); no task sorts a whole group."""
    keyed = df.withColumn("__key", key_of(seed, *group, name))
    placed = ranked(keyed, group, ["__key", name], "__at") if group else numbered(keyed, ["__key", name], "__at")
    return placed.where(F.col("__at") <= k).drop("__at", "__key")


def draw_slots(spark, n: int, seed: int, population: int, name: str = "idx") -> DataFrame:
    """(slot, idx): ``n`` indices in 1..population with replacement."""
    return spark.range(1, n + 1).select(F.col("id").alias("slot"), (whole(key_of(seed, "id")) % population + 1).alias(name))


def bootstrap_sizes(sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """(slot, size): n sizes with replacement; sizes are numbered by (size, community)."""
    population = numbered(sizes.where("size IS NOT NULL").select("size", "community"), ["size", "community"])
    total = population.count()
    if not total:
        raise ValueError("no sizes to draw from")
    return draw_slots(sizes.sparkSession, n, seed, total).join(population, "idx").select("slot", "size")


def weighted_pick(draws: DataFrame, choices: DataFrame, draw: str, name: str, weight: str, seed: int) -> DataFrame:
    """(draw, name): one name for each draw, with a chance in proportion to its weight.

    Weights are added up in the order of the names; a draw's uniform number falls into one name's span, found by a range join on
    the span's start, for which both sides are put into buckets of equal width.
    """
    spans = choices.select(name, F.col(weight).cast("double").alias("w")).where("w > 0")
    ends = running_total(spans, [name], "w").withColumn("lo", F.col("hi") - F.col("w"))
    total = spans.agg(F.sum("w").alias("t")).first()["t"]
    if not total:
        raise ValueError("no weights to draw from")
    width = total / max(1, spans.count())
    placed = draws.withColumn("u", unit(key_of(seed, draw)) * F.lit(total)).withColumn("b", F.floor(F.col("u") / width))
    bucketed = ends.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return placed.join(bucketed, "b").where("u >= lo AND u < hi").select(draw, name)


def uniform_int(seed: int, low: int, high: int, *keys: str) -> Column:
    """A whole number in [low, high]."""
    return whole(key_of(seed, *keys)) % (high - low + 1) + low


def anomalous_sizes(sizes: DataFrame, n: int, group: str, width: int, seed: int) -> DataFrame:
    """(slot, size): n community sizes of a size group, ascending.

    The group gives the base: the smallest size; or the 0.1 quantile, first quartile, median or mean less half of ``width``, cut
    to a whole number; sizes are uniform in [base, base + width]. 'random' draws from the sizes with replacement.
    """
    if group not in SIZE_GROUPS:
        raise ValueError(f"size group {group} isn't one of {SIZE_GROUPS}")
    if group == "random":
        drawn = bootstrap_sizes(sizes, n, seed).select(F.col("slot").alias("draw"), "size")
    else:
        stat = {
            "min": F.min("size").cast("double"), "quantile10": F.percentile("size", F.lit(0.1)), "quartile1": F.percentile("size", F.lit(0.25)),
            "median": F.percentile("size", F.lit(0.5)), "mean": F.avg("size"),
        }[group]
        base = F.floor(stat) - (0 if group == "min" else width // 2)
        lowest = sizes.agg(base.alias("base")).scalar()
        draws = sizes.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw")
        drawn = draws.select("draw", (lowest + whole(key_of(seed, "draw")) % (width + 1)).alias("size"))
    return drawn.select(F.row_number().over(Window.orderBy("size", "draw")).alias("slot"), "size")


def holdout(df: DataFrame, keys: list[str], share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation): rows by their keys' hash, about ``share`` of them held out; 0 holds out none."""
    u = unit(key_of(seed, *keys))
    return df.where(u >= share), df.where(u < share)
