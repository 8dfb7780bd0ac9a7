"""Structural quality measures of communities in a graph, and their rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kithloom.operators.graph import boundary_degrees, degrees, inside_edges
from kithloom.operators.order import ranked
from kithloom.session import cut, keep

#: Measures whose lowest value comes first in a ranking; of the others the highest does.
ASCENDING = ("avg_degree", "unattr_amen")


def community_counts(graph: DataFrame, m: DataFrame, deg: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """(community, n_s, internal, volume, cut, n_missing, n_nodes, n_edges): what all measures are made of.

    n_s counts the listed members, also those (n_missing) that aren't in the graph; graph is simple, without self loops. ``deg`` and
    ``inner`` are degrees and inside_edges if these are already there.
    """
    deg = degrees(graph) if deg is None else deg
    listed = m.join(deg, "vertex", "left").groupBy("community").agg(
        F.count("*").alias("n_s"), F.coalesce(F.sum("degree"), F.lit(0)).alias("volume"), F.count_if(F.col("degree").isNull()).alias("n_missing")
    )
    inside = (inside_edges(graph, m) if inner is None else inner).groupBy("community").agg(F.count("*").alias("internal"))
    joined = listed.join(inside, "community", "left").fillna(0, ["internal"])
    return joined.select(
        "community", "n_s", "internal", "volume", (F.col("volume") - 2 * F.col("internal")).alias("cut"), "n_missing",
        deg.agg(F.count("*").alias("n")).scalar().alias("n_nodes"), graph.agg(F.count("*").alias("n")).scalar().alias("n_edges"),
    )


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def _simple(name: str) -> Column:
    """A measure as an expression over community_counts: A10, A11, A11b, A11c."""
    size, cut_edges, volume = F.col("n_s"), F.col("cut"), F.col("volume")
    if name == "avg_degree":  # twice the inner edges by the size
        return _ratio(2 * F.col("internal"), size)
    if name == "cut_ratio":  # cut edges by the pairs of inner and outer nodes
        return _ratio(cut_edges, size * (F.col("n_nodes") - size))
    if name == "avg_odf":  # cut edges by the size
        return _ratio(cut_edges, size)
    return _ratio(cut_edges, F.least(volume, 2 * F.col("n_edges") - volume))  # conductance: cut edges by the smaller volume of both sides


def flake_odf(graph: DataFrame, m: DataFrame, deg: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """Share of members with fewer than half their edges inside; -1 where a member isn't in the graph."""
    deg, inner = degrees(graph) if deg is None else deg, inside_edges(graph, m) if inner is None else inner
    inside = inner.select("community", F.explode(F.array("src", "dst")).alias("vertex")).groupBy("community", "vertex").agg(F.count("*").alias("inside"))
    each = m.join(deg, "vertex", "left").join(inside, ["community", "vertex"], "left").fillna(0, ["inside"])
    weak = F.avg(F.when(2 * F.col("inside") < F.col("degree"), 1.0).otherwise(0.0))
    return each.groupBy("community").agg(F.when(F.count_if(F.col("degree").isNull()) > 0, -1.0).otherwise(weak).alias("score"))


def unattr_amen(graph: DataFrame, m: DataFrame, parts: bool = False, counts: DataFrame | None = None, deg: DataFrame | None = None) -> DataFrame:
    """Normality of a community: how much its inner edges exceed, and its outer edges fall short of, what degrees let expect.

    Both double sums depend on degrees only: members and boundary become histograms of degrees, whose product is as small as
    the numbers of different degrees. Null where it is 0 / 0.
    """
    deg = degrees(graph) if deg is None else deg
    counts = (community_counts(graph, m) if counts is None else counts).where("n_edges > 0")
    twice = 2.0 * F.col("n_edges").cast("double")
    own = m.join(deg, "vertex").groupBy("community", F.col("degree").alias("k")).agg(F.count("*").alias("n"))
    edge = boundary_degrees(graph, m, deg=deg).select("community", F.col("degree").alias("k2"), F.col("n").alias("n2"))
    m2 = F.lit(2.0) * graph.agg(F.count("*").alias("n")).scalar()
    short = F.sum(F.col("n").cast("double") * F.col("n2") * (1 - F.least(F.lit(1.0), F.col("k").cast("double") * F.col("k2") / m2)))
    outer = own.join(edge, "community").groupBy("community").agg(short.alias("outer"))
    inner = own.join(own.select("community", F.col("k").alias("k2"), F.col("n").alias("n2")), "community").groupBy("community").agg(short.alias("inner"))
    joined = counts.join(outer, "community", "left").join(inner, "community", "left").fillna(0.0, ["outer", "inner"])
    size, volume = F.col("n_s").cast("double"), F.col("volume").cast("double")
    consistency = F.try_divide(2.0 * F.col("internal"), size * size + volume * volume / twice)
    separability = F.try_divide(-F.col("outer"), F.col("inner") + F.col("outer"))
    found = joined.select("community", consistency.alias("consistency"), separability.alias("separability"))
    return found if parts else found.select("community", (F.col("consistency") + F.col("separability")).alias("score"))


MEASURES = ("avg_degree", "cut_ratio", "conductance", "flake_odf", "avg_odf", "unattr_amen")


def measure(name: str, graph: DataFrame, m: DataFrame, counts: DataFrame | None = None, deg: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """(community, score) of a measure chosen by name (X3, P17); ``counts``, ``deg`` and ``inner`` are community_counts, degrees and inside_edges if these are already there."""
    if name not in MEASURES:
        raise ValueError(f"measure {name} isn't one of {MEASURES}")
    if name == "flake_odf":
        return flake_odf(graph, m, deg, inner)
    if name == "unattr_amen":
        return unattr_amen(graph, m, counts=counts, deg=deg)
    return (community_counts(graph, m, deg, inner) if counts is None else counts).select("community", _simple(name).alias("score"))


def rank_measures(graph: DataFrame, m: DataFrame, names: tuple[str, ...] = MEASURES) -> DataFrame:
    """(feature, rank, community, score) of several measures, the most anomalous community first, nulls last, ties by name.

    What is behind several measures is made once, and the two that need more are cut one after the other, so that they don't have
    shuffle files at a time; ``graph`` and ``m`` are read several times, so they should be kept tables.
    """
    deg, inner = keep(degrees(graph), "degrees"), keep(inside_edges(graph, m), "inner")
    counts = cut(community_counts(graph, m, deg, inner))
    each = ((name, measure(name, graph, m, counts, deg, inner)) for name in names)
    scored = reduce(DataFrame.unionByName, [(cut(found) if name in ("flake_odf", "unattr_amen") else found).withColumn("feature", F.lit(name)) for name, found in each])
    key = F.when(F.col("feature").isin(*ASCENDING), F.col("score")).otherwise(-F.col("score"))
    keyed = scored.withColumn("__key", F.round(key, 9)).withColumn("__none", F.col("__key").isNull())
    return ranked(keyed, ["feature"], ["__none", "__key", "community"]).select("feature", "rank", "community", "score")
