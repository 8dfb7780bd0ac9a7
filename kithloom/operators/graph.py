"""The unipartite graph: cleaning of interaction edges, degrees, subgraphs, boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kithloom.operators.order import numbered
from kithloom.session import cut, keep

#: A member of more communities than this is a hub.
HUB = 32
#: Counting by sets of hubs pays where a set stands for at least so many vertices.
FEW_SETS = 2


def clean_edges(edges: DataFrame, min_weight: int | None = None) -> DataFrame:
    """Edges with two different known ends; with ``min_weight`` (unless None or 0) only those of at least that weight."""
    kept = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return kept.where(F.col("weight") >= min_weight) if min_weight else kept


def concat_edges(parts: list[DataFrame]) -> DataFrame:
    """All communities' edges in one table."""
    return reduce(DataFrame.unionByName, parts)


def simple_graph(edges: DataFrame) -> DataFrame:
    """Distinct undirected (src, dst), src < dst."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()


def nodes_of(graph: DataFrame) -> DataFrame:
    """The ends of all edges, once each."""
    return graph.select(F.col("src").alias("id")).union(graph.select("dst")).distinct()


def both_directions(graph: DataFrame) -> DataFrame:
    return graph.select("src", "dst").union(graph.select("dst", "src"))


def degrees(graph: DataFrame) -> DataFrame:
    """(vertex, degree) of the vertices with an edge."""
    return graph.select(F.explode(F.array("src", "dst")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))


def inside_edges(graph: DataFrame, m: DataFrame) -> DataFrame:
    """(community, src, dst): every edge with both ends in a community, for each such community.

    An edge is looked up by the memberships of that end which has fewer, then by (community, other end): a vertex that is
    in every community multiplies nothing.
    """
    known = m.groupBy("vertex").agg(F.count("*").alias("n"))
    ends = (
        graph.join(known.select(F.col("vertex").alias("src"), F.col("n").alias("n_src")), "src")
        .join(known.select(F.col("vertex").alias("dst"), F.col("n").alias("n_dst")), "dst")
        .select("src", "dst", (F.col("n_src") <= F.col("n_dst")).alias("by_src"))
    )
    turned = ends.select(F.when(F.col("by_src"), F.col("src")).otherwise(F.col("dst")).alias("vertex"), F.when(F.col("by_src"), F.col("dst")).otherwise(F.col("src")).alias("other"))
    found = turned.join(m, "vertex").join(m.withColumnRenamed("vertex", "other"), ["community", "other"], "left_semi")
    return found.select("community", F.least("vertex", "other").alias("src"), F.greatest("vertex", "other").alias("dst"))


def induced_subgraph(graph: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends in the listed vertices, those vertices), isolated ones included."""
    ids = names.select("id").distinct()
    edges = graph.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.select("src", "dst"), ids


def boundary(graph: DataFrame, m: DataFrame) -> DataFrame:
    """(community, vertex): vertices outside a community that an edge joins to it."""
    reached = both_directions(graph).join(m.withColumnRenamed("vertex", "src"), "src").select("community", F.col("dst").alias("vertex")).distinct()
    return reached.join(m, ["community", "vertex"], "left_anti")


def boundary_counts(graph: DataFrame, m: DataFrame, hub: int = HUB) -> DataFrame:
    """(community, n_boundary): how many vertices boundary() has of each community that has any, without listing what hubs touch.

    Vertices are counted by the set of hubs (members of more than ``hub`` communities) that touch them, communities are grouped by the
    set of hubs they have, and only these sets are paired. Taken off are such vertices that are members themselves, added those that
    only an ordinary member joins to the community. ``graph`` and ``m`` are read several times, so they should be kept tables.
    """
    pairs = both_directions(graph)
    names = numbered(m.groupBy("vertex").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("vertex"), ["vertex"], "h")
    sides = pairs.join(names.withColumnRenamed("vertex", "src"), "src")
    touched = keep(sides.groupBy(F.col("dst").alias("vertex")).agg(F.array_sort(F.collect_list("h")).alias("hubs")), "touched")
    inside = keep(m.join(names, "vertex").groupBy("community").agg(F.array_sort(F.collect_list("h")).alias("inside")), "inside")
    v_sets = touched.groupBy("hubs").agg(F.count("*").alias("n")).withColumn("v_set", F.monotonically_increasing_id())
    v_sets = keep(v_sets, "sets")
    met = v_sets.select("v_set", "n", F.explode("hubs").alias("h")).join(inside.select("inside").distinct().select("inside", F.explode("inside").alias("h")), "h")
    reached = met.select("inside", "v_set", "n").distinct().groupBy("inside").agg(F.sum("n").alias("n"))
    by_hub = inside.join(reached, "inside").select("community", "n")
    both = F.coalesce(F.arrays_overlap("hubs", "inside"), F.lit(False))
    own = m.join(touched, "vertex").join(inside, "community").where(both).select("community", F.lit(-1).cast("long").alias("n"))
    near = pairs.join(names.withColumnRenamed("vertex", "src"), "src", "left_anti").join(m.withColumnRenamed("vertex", "src"), "src").select("community", F.col("dst").alias("vertex")).distinct()
    only_near = near.join(m, ["community", "vertex"], "left_anti").join(touched, "vertex", "left").join(inside, "community", "left")
    extra = only_near.where(~both).select("community", F.lit(1).cast("long").alias("n"))
    counted = by_hub.unionByName(own).unionByName(extra).groupBy("community").agg(F.sum("n").alias("n_boundary"))
    return counted.where("n_boundary > 0")


def boundary_degrees(graph: DataFrame, m: DataFrame, hub: int = HUB, deg: DataFrame | None = None) -> DataFrame:
    """(community, degree, n): how many vertices of each degree are in a community's boundary; boundary() counted by degree.

    A vertex next to a hub, a member of more than ``hub`` communities, is in the boundary of nearly all of them, which makes the
    boundaries themselves as large as vertices times communities. So vertices are counted by the set of hubs they touch: all
    vertices with the same set reach the same communities through it. Taken off are those that are members there, added those that
    only an ordinary vertex joins to a community. Sets are known by a 128-bit hash; where there are nearly as many as vertices, which
    leaves nothing to be gained, the boundaries are listed after all. The parts are counted one after the other, so that they don't
    have shuffle files at a time. ``deg`` is degrees(graph) if that is already there.
    """
    deg, pairs = degrees(graph) if deg is None else deg, both_directions(graph)
    hubs = m.groupBy("vertex").agg(F.count("*").alias("n")).where(F.col("n") > hub).select(F.col("vertex").alias("src"))
    touched = pairs.join(hubs, "src", "left_semi").groupBy(F.col("dst").alias("vertex")).agg(F.array_sort(F.collect_list("src")).alias("hubs"))
    touched = keep(touched.withColumn("set", F.md5(F.to_json("hubs"))).join(deg, "vertex"), "touched")
    sets = touched.groupBy("set").agg(F.any_value("hubs").alias("hubs"))
    if sets.count() * FEW_SETS > touched.count():
        return boundary(graph, m).join(deg, "vertex").groupBy("community", "degree").agg(F.count("*").alias("n"))
    near = pairs.join(hubs, "src", "left_anti").join(m.withColumnRenamed("vertex", "src"), "src").select("community", F.col("dst").alias("vertex")).distinct()
    only_near = keep(near.join(m, ["community", "vertex"], "left_anti"), "near")
    reached = keep(sets.select("set", F.explode("hubs").alias("vertex")).join(m, "vertex").select("set", "community").distinct(), "reached")
    by_hub = touched.groupBy("set", "degree").agg(F.count("*").alias("n")).join(reached, "set").select("community", "degree", "n")
    own = m.join(touched.drop("hubs"), "vertex").join(reached, ["set", "community"], "left_semi").select("community", "degree", F.lit(-1).cast("long").alias("n"))
    placed = only_near.join(deg, "vertex").join(touched.select("vertex", "set"), "vertex", "left")
    extra = placed.join(reached, ["set", "community"], "left_anti").select("community", "degree", F.lit(1).cast("long").alias("n"))
    parts = [cut(p.groupBy("community", "degree").agg(F.sum("n").alias("n"))) for p in (by_hub, own, extra)]
    counted = reduce(DataFrame.unionByName, parts).groupBy("community", "degree").agg(F.sum("n").alias("n"))
    return counted.where("n > 0")


def adjacency_lines(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line): ``node neighbour neighbour ...`` for each node, every edge once at its smaller end, isolated nodes too (K4)."""
    later = graph.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("others"))
    return nodes.join(later, "id", "left").select(F.concat_ws(" ", F.col("id"), F.concat_ws(" ", "others")).alias("raw")).select(F.rtrim("raw").alias("line"))


def parse_adjacency(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(simple graph, nodes) of adjacency lines; ``#`` starts a comment."""
    parts = F.split(F.btrim(F.split(F.col(column), "#")[0]), r"\s+")
    kept = lines.select(parts.alias("p")).where("p[0] <> ''")
    edges = kept.select(F.col("p")[0].alias("src"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("dst"))
    return simple_graph(edges), kept.select(F.explode("p").alias("id")).distinct()
