"""Memberships (community, vertex): the bipartite network, its counts, overlaps and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kithloom.functions.hashing import key_of
from kithloom.operators.graph import clean_edges
from kithloom.operators.order import first_rows
from kithloom.operators.pairs import shared_counts
from kithloom.session import keep


def bipartite(members: DataFrame, community: str = "community", vertex: str = "vertex") -> DataFrame:
    """Distinct (community, vertex) as text, without nulls: the edges of the bipartite network."""
    pairs = members.select(F.col(community).cast("string").alias("community"), F.col(vertex).cast("string").alias("vertex"))
    # by vertex alone, so that what is asked of each vertex next needs no other shuffle
    return pairs.dropna().repartition("vertex").distinct()


def labelled(m: DataFrame, community_label: str, vertex_label: str) -> DataFrame:
    """The edges under the two partites' labels (K2)."""
    return m.select(F.col("community").alias(community_label), F.col("vertex").alias(vertex_label))


def from_partition_map(maps: DataFrame, column: str) -> DataFrame:
    """Memberships of a MAP<community, ARRAY<vertex>> column."""
    return bipartite(maps.select(F.explode(column).alias("community", "members")).select("community", F.explode("members").alias("vertex")))


def keep_communities(m: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the listed communities; unknown names raise."""
    unknown = names.select("community").distinct().join(m, "community", "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"unknown communities: {[r.community for r in unknown]}")
    return m.join(names.select("community"), "community", "left_semi")


def drop_communities(m: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of all but the listed communities."""
    return m.join(names.select("community"), "community", "left_anti")


def sizes(m: DataFrame) -> DataFrame:
    """(community, size) (A4)."""
    return m.groupBy("community").agg(F.count("*").alias("size"))


def vertex_degrees(m: DataFrame) -> DataFrame:
    """(vertex, degree): the number of a vertex's communities (A1)."""
    return m.groupBy("vertex").agg(F.count("*").alias("degree"))


def properties(m: DataFrame) -> DataFrame:
    """One row: communities, vertices, nodes, edges."""
    return m.agg(
        F.count_distinct("community").alias("n_communities"), F.count_distinct("vertex").alias("n_vertices"), F.count("*").alias("n_edges")
    ).select("n_communities", "n_vertices", (F.col("n_communities") + F.col("n_vertices")).alias("n_nodes"), "n_edges")


def describe(values: DataFrame, column: Column | str, prefix: str = "") -> DataFrame:
    """count, sum, min, max, mean, median, perc75 and the population's std of a column."""
    c = F.col(column) if isinstance(column, str) else column
    stats = {
        "count": F.count(c), "sum": F.sum(c), "min": F.min(c), "max": F.max(c), "mean": F.avg(c), "median": F.median(c),
        "perc75": F.percentile(c, F.lit(0.75)), "std": F.stddev_pop(c),
    }
    return values.agg(*(v.alias(prefix + k) for k, v in stats.items()))


def size_between(counts: DataFrame, low: int, high: int, column: str = "size") -> DataFrame:
    """Rows with a known size in the inclusive range."""
    return counts.where(F.col(column).between(low, high))


def overlap(m: DataFrame) -> DataFrame:
    """(c1, c2, n), c1 < c2: members that two communities share, for all pairs that share any (J5, U5); ``m`` is read several times, so it should be a kept table."""
    found = shared_counts(m.select(F.col("community").alias("g"), F.col("vertex").alias("x")))
    return found.select(F.col("a").alias("c1"), F.col("b").alias("c2"), F.col("n_shared").alias("n"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in either order."""
    return pairs.unionByName(pairs.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "n"))


def overlapping_pairs(m: DataFrame, min_common: int, min_pairs: int, symmetric: bool = False) -> DataFrame:
    """Pairs with at least ``min_common`` shared members whose first community is in at least ``min_pairs`` of them.

    The first community is the smaller by name; ``symmetric`` counts a community's pairs on either side.
    """
    pairs = overlap(m).where(F.col("n") >= min_common)
    counted = both_ways(pairs) if symmetric else pairs
    often = counted.groupBy("c1").agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= min_pairs).select("c1")
    return pairs.join(often, "c1", "left_semi")


def overlapping_names(pairs: DataFrame) -> DataFrame:
    """Names on either side of the pairs."""
    return pairs.select(F.col("c1").alias("community")).union(pairs.select("c2")).distinct()


def fetch_overlapping(edges: DataFrame, low: int, high: int, min_weight: int | None, min_common: int, min_pairs: int, n: int, seed: int) -> DataFrame:
    """(community, vertex) of ``n`` communities drawn from those that overlap.

    ``edges`` has (community, src, dst, weight); members are the ends of edges of at least ``min_weight`` that aren't self loops, and
    only communities with low to high members take part. All of these are looked at, so no number of tries is needed.
    """
    ends = clean_edges(edges, min_weight).select("community", F.explode(F.array("src", "dst")).alias("vertex"))
    m = bipartite(ends)
    m = keep(m.join(size_between(sizes(m), low, high).select("community"), "community", "left_semi"))
    names = overlapping_names(overlapping_pairs(m, min_common, min_pairs))
    drawn = first_rows(names.withColumn("k", key_of(seed, "community")), ["k", "community"], n)
    return m.join(drawn.select("community"), "community", "left_semi")


def split_communities(names: DataFrame, n_train: int, seed: int, anomalous: str = "is_anomalous") -> DataFrame:
    """names with ``split``: 'train' for ``n_train`` communities drawn from the normal ones, 'test' for all others."""
    drawn = first_rows(names.where(~F.col(anomalous)).select("community", key_of(seed, "community").alias("k")), ["k", "community"], n_train)
    marked = names.join(drawn.select("community", F.lit("train").alias("split")), "community", "left")
    return marked.withColumn("split", F.coalesce("split", F.lit("test")))


def last_communities(m: DataFrame, k: int) -> DataFrame:
    """The last ``k`` community names in their order, which for numbered names are the ones added last."""
    return m.select("community").distinct().orderBy(F.desc("community")).limit(k)


def distinct_users(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_users): exact number of ids at either end of the edges, without filters."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct()
    return ends.groupBy(*keys).agg(F.count("*").alias("n_users"))
