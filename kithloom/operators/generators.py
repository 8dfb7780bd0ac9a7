"""Community-structured random networks with injected anomalous communities."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kithloom.functions.hashing import key_of, unit
from kithloom.functions.text import padded_name
from kithloom.operators.graph import simple_graph
from kithloom.operators.order import numbered, running_total
from kithloom.operators.sampling import draw_names, uniform_int
from kithloom.session import cut

EDGES = "community string, src long, dst long"
#: Numbers of one chunk of a range.
CHUNK = 1 << 16
#: Fixed value: how names of infused communities begin.
ANOMALOUS_PREFIX = "AnomComm"


def offsets(sizes: DataFrame, first: int = 1) -> DataFrame:
    """sizes (idx, community, size) with ``start``, each community's first vertex number."""
    return running_total(sizes, ["idx"], "size", "start").withColumn("start", F.col("start") - F.col("size") + first)


def _spread(rows: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each whole number from ``low`` to ``high`` (at least low), in chunks, so that no range is an array of its length."""
    chunks = rows.withColumn("__low", low).withColumn("__high", high).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__high") - F.col("__low")) / CHUNK))))
    start = F.col("__low") + F.col("__chunk") * CHUNK
    return chunks.withColumn(name, F.explode(F.sequence(start, F.least(F.col("__high"), start + CHUNK - 1)))).drop("__low", "__high", "__chunk")


def community_vertices(placed: DataFrame) -> DataFrame:
    """(community, vertex): start, start + 1, ...."""
    return _spread(placed.where("size > 0"), F.col("start"), F.col("start") + F.col("size") - 1, "vertex").select("community", "vertex")


def er_edges_hashed(placed: DataFrame, p: float, seed: int) -> DataFrame:
    """Erdos-Renyi edges: every pair of a community's vertices is an edge if its hash falls below p.

    Looks at every pair, so it is meant for the small communities of a generated network; er_edges has the same distribution in
    time proportional to the edges.
    """
    v = community_vertices(placed)
    pairs = v.select("community", F.col("vertex").alias("src")).join(v.select("community", F.col("vertex").alias("dst")), "community").where("src < dst")
    return pairs.where(unit(key_of(seed, "community", "src", "dst")) < p)


def er_edges(placed: DataFrame, p: float, seed: int) -> DataFrame:
    """Erdos-Renyi edges by geometric jumps from one neighbour of a vertex to the next: O(edges), vertices spread over all tasks."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie within 0 and 1")
    rows = _spread(placed.where("size > 1"), F.col("start"), F.col("start") + F.col("size") - 2, "src").select("community", "src", (F.col("start") + F.col("size") - 1).alias("last"))
    rows = rows.withColumn("seed", F.xxhash64(F.lit(seed), "community", "src"))

    def jump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for community, src, last, own in pdf.itertuples(index=False):
                if p <= 0:
                    continue
                if p >= 1:
                    found = np.arange(src + 1, last + 1)
                else:
                    rng, at, steps = np.random.default_rng(own & (2**63 - 1)), src, []
                    while at < last:
                        ahead = at + np.cumsum(rng.geometric(p, 64 + int((last - at) * p * 1.2)))
                        steps.append(ahead[ahead <= last])
                        at = ahead[-1]
                    found = np.concatenate(steps) if steps else np.arange(0)
                if len(found):
                    out.append(pd.DataFrame({"community": community, "src": src, "dst": found}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.repartition("community", "src").mapInPandas(jump, EDGES)


def ba_edges(placed: DataFrame, m: int, seed: int) -> DataFrame:
    """Barabasi-Albert edges of each community: every new vertex joins m earlier ones, in proportion to their degrees.

    With m = 1 a vertex draws one of the ends of all earlier edges by hash. An end that is a new vertex is known by its place; an
    end that is itself a drawn target is followed to the draw of its vertex, two on average. So every vertex is settled on its own
    and the vertices of a community, however large, are spread over all tasks (the method is that of Sanders and Schulz, 2016).
    With m > 1 targets must differ, which makes growth sequential: a community is one task's work, in 16 bytes an edge.
    """
    if m < 1:
        raise ValueError("m must be 1 or more")
    rows = placed.where("size > 1")
    if m == 1:
        numbers = _spread(rows.select("community", "start", "size"), F.lit(1).cast("long"), F.col("size") - 1, "v").select("community", "start", "v")
        return numbers.repartition("community", "v").mapInPandas(lambda batches: _attached(batches, seed), EDGES)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        community, start, n = pdf["community"].iloc[0], int(pdf["start"].iloc[0]), int(pdf["size"].iloc[0])
        rng = np.random.default_rng(seed)
        first = min(m, n - 1)
        ends = np.empty(2 * m * n, np.int64)  # each vertex as often as it has edges: target, new vertex, target, ...
        used = 0
        for v in range(first, n):
            targets = set(range(first)) if v == first else set()
            while len(targets) < min(m, v):
                targets.add(int(ends[rng.integers(used)]))
            for t in sorted(targets):
                ends[used : used + 2] = t, v
                used += 2
        return pd.DataFrame({"community": community, "src": ends[:used:2] + start, "dst": ends[1:used:2] + start})

    return rows.groupBy("community").applyInPandas(grow, EDGES)


def _attached(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """The edge of each new vertex v = 1, 2, ... of a community to the earlier vertex that it draws."""
    for pdf in batches:
        targets = []
        for community, v in zip(pdf["community"], pdf["v"]):
            while v > 1:
                # the ends so far: target and new vertex of the edge of each earlier vertex
                end = int(hashlib.md5(f"{seed}:{community}:{v}".encode()).hexdigest()[:12], 16) % (2 * (v - 1))
                v = end // 2 + 1
                if end % 2:
                    break
            else:
                v = 0
            targets.append(v)
        yield pd.DataFrame({"community": pdf["community"], "src": pdf["start"] + np.array(targets, np.int64), "dst": pdf["start"] + pdf["v"]})


Generator = Callable[[DataFrame, float, int], DataFrame]
GENERATORS: dict[str, Generator] = {"er": er_edges, "ba": lambda placed, m, seed: ba_edges(placed, int(m), seed)}


def generator(choice: str | Generator) -> Generator:
    """A generator by name, or the given callable (placed, parameter, seed) -> (community, src, dst)."""
    if callable(choice):
        return choice
    if choice not in GENERATORS:
        raise ValueError(f"generator {choice} isn't one of {tuple(GENERATORS)}")
    return GENERATORS[choice]


def _weighted(draws: DataFrame, choices: DataFrame, name: str, weight: str, group: str | None, seed: int, own: str | None = None) -> DataFrame:
    """draws with ``name``: a choice (of the same ``group``, if any) in proportion to its whole-number weight.

    Weights are laid out one after the other; the draw's hash points into them and finds its span by the span's start, bucketed so
    that the join is an equality on (group, bucket). The choice that the draws' column ``own`` names is passed over: the hash points
    into the other weights, and beyond the own span it is moved on by it; draws without another choice are left out.
    """
    keys = [group] if group else []
    spans = running_total(choices.where(F.col(weight) > 0), [name], weight, "hi", keys)
    spans = spans.withColumn("lo", F.col("hi") - F.col(weight))
    shape = choices.where(F.col(weight) > 0).groupBy(*keys).agg(F.sum(weight).alias("total"), F.count("*").alias("n"))
    shape = shape.withColumn("step", F.ceil(F.col("total") / F.col("n")).cast("long"))
    if keys:
        spans, placed = spans.join(shape, group), draws.join(shape, group)
    else:
        one = shape.withColumn("one", F.lit(1))
        spans, placed = spans.withColumn("one", F.lit(1)).join(one, "one"), draws.withColumn("one", F.lit(1)).join(one, "one")
    spans = spans.select(*keys, name, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("step")), F.floor((F.col("hi") - 1) / F.col("step")))).alias("b"))
    if own:
        passed = spans.select(F.col(name).alias(own), F.col("lo").alias("own_lo"), (F.col("hi") - F.col("lo")).alias("own_weight")).distinct()
        placed = placed.join(passed, own, "left").fillna(0, ["own_lo", "own_weight"]).where("total > own_weight")
    else:
        placed = placed.withColumn("own_lo", F.lit(0)).withColumn("own_weight", F.lit(0))
    placed = placed.withColumn("u", F.floor(unit(key_of(seed, *[c for c in ("draw", "source") if c in draws.columns])) * (F.col("total") - F.col("own_weight"))))
    placed = placed.withColumn("u", F.col("u") + F.when(F.col("u") >= F.col("own_lo"), F.col("own_weight")).otherwise(0))
    placed = placed.withColumn("b", F.floor(F.col("u") / F.col("step")))
    return placed.join(spans, [*keys, "b"]).where("u >= lo AND u < hi").select(*draws.columns, name)


def connecting_count(size, share: float, rounding: str = "even"):
    """Vertices of a community that reach out: size times share, rounded half to even, or cut (F8, Q13)."""
    x = F.col(size).cast("double") * F.lit(float(share)) if isinstance(size, str) else size * share
    return (F.bround(x) if rounding == "even" else F.floor(x)).cast("long")


def inter_edges(placed: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, share: float, k: tuple[int, int], seed: int, rounding: str = "even") -> tuple[DataFrame, DataFrame]:
    """Edges between communities, and the memberships that come with them.

    Of each community in ``sources`` round(size * share) vertices each draw k targets: a community of ``targets`` by size, not the own
    one, and there a vertex by degree, as the degrees were before any of these edges (Q9). Returns (src, dst) and
    (community, vertex): a source joins the community of each target.
    """
    sized = placed.select("community", "size")
    v = community_vertices(placed)
    deg = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))
    weighted = v.join(deg, "vertex").select(F.col("community").alias("to_community"), F.col("vertex").alias("target"), "degree")
    own = v.join(sources.select("community"), "community", "left_semi").join(sized, "community")
    reach = draw_names(own, ["community"], "vertex", connecting_count("size", share, rounding), seed).select("community", F.col("vertex").alias("source"))
    draws = reach.withColumn("k", uniform_int(seed + 1, k[0], k[1], "source")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("k")))).drop("k")
    open_to = sized.join(targets.select("community"), "community", "left_semi").select(F.col("community").alias("to_community"), "size")
    settled = cut(_weighted(draws, open_to, "to_community", "size", None, seed + 10, "community"))
    hit = _weighted(settled, weighted, "target", "degree", "to_community", seed + 2)
    joined = cut(hit)
    return joined.select(F.col("source").alias("src"), F.col("target").alias("dst")), joined.select(F.col("to_community").alias("community"), F.col("source").alias("vertex")).distinct()


@dataclass(frozen=True)
class Network:
    """A generated network: simple edges, all nodes, memberships, and which communities are anomalous."""

    edges: DataFrame
    nodes: DataFrame
    membership: DataFrame
    communities: DataFrame


def _slots(spark: SparkSession, sizes: DataFrame | list[int]) -> DataFrame:
    """(slot, size) of sizes given as such or as a list."""
    if isinstance(sizes, DataFrame):
        return sizes.select(F.col("slot").cast("long"), F.col("size").cast("long"))
    return spark.createDataFrame([(i + 1, int(s)) for i, s in enumerate(sizes)], "slot long, size long")


def named_sizes(spark: SparkSession, normal: DataFrame | list[int], anomalous: DataFrame | list[int]) -> DataFrame:
    """(idx, community, size, is_anomalous): normal communities first, then the anomalous ones.

    Sizes are a list, or a table (slot, size) with slots 1, 2, ..., which may be of any length.
    """
    plain, odd = _slots(spark, normal), _slots(spark, anomalous)
    before, more = plain.count(), odd.count()
    both = plain.select(F.col("slot").alias("idx"), "size", F.lit(False).alias("is_anomalous")).unionByName(odd.select((F.col("slot") + before).alias("idx"), "size", F.lit(True).alias("is_anomalous")))
    return both.withColumn("community", padded_name("comm", F.col("idx"), F.lit(before + more)))


def generate_network(
    communities: DataFrame, normal: str | Generator = "ba", anomalous: str | Generator = "er", m: float = 1, p: float = 0.05, normal_share: float = 0.075,
    anomalous_share: float = 0.2, k: tuple[int, int] = (1, 1), seed: int = 0,
) -> Network:
    """The generator's whole way: normal communities, edges between them, anomalous ones, their edges into normal ones."""
    placed = cut(offsets(communities))
    plain, odd = placed.where("NOT is_anomalous"), placed.where("is_anomalous")
    inner = cut(generator(normal)(plain, m, seed))
    between, joined = inter_edges(placed, inner, plain, plain, normal_share, k, seed + 100)
    grown = cut(inner.select("src", "dst").unionByName(between))
    added = cut(generator(anomalous)(odd, p, seed + 1))
    so_far = grown.unionByName(added.select("src", "dst"))
    out, joined_odd = inter_edges(placed, so_far, odd, plain, anomalous_share, k, seed + 200, "cut")
    vertices = community_vertices(placed)
    text = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    membership = text(vertices.unionByName(joined).unionByName(joined_odd).distinct())
    return Network(simple_graph(text(so_far.unionByName(out))), text(vertices.select(F.col("vertex").alias("id")).distinct()), membership, placed.select("community", "size", "is_anomalous"))


def infuse(graph: DataFrame, membership: DataFrame, sizes: DataFrame | list[int], p: float, share: float, k: tuple[int, int], seed: int, anomalous: str | Generator = "er") -> Network:
    """A real graph with generated anomalous communities added and linked into its communities.

    Vertices of the graph keep their ids; new ones are named GenNode..., new communities AnomComm....
    """
    spark = graph.sparkSession
    rows = cut(_slots(spark, sizes).withColumnRenamed("slot", "idx"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = cut(offsets(rows.withColumn("community", padded_name(ANOMALOUS_PREFIX, F.col("idx"), F.lit(n)))))
    inner = cut(generator(anomalous)(placed, p, seed))
    named = lambda c: padded_name("GenNode", F.col(c), F.lit(total))
    own = community_vertices(placed)
    deg = graph.select(F.explode(F.array("src", "dst")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))
    weighted = membership.join(deg, "vertex").select(F.col("community").alias("to_community"), F.col("vertex").alias("target"), "degree")
    size = membership.groupBy("community").agg(F.count("*").alias("size"))
    reach = draw_names(own.join(placed.select("community", "size"), "community"), ["community"], "vertex", connecting_count("size", share, "cut"), seed)
    draws = reach.select(F.col("vertex").alias("source")).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), uniform_int(seed + 1, k[0], k[1], "source"))))
    picked = _weighted(draws, size.withColumnRenamed("community", "to_community"), "to_community", "size", None, seed + 10)
    hit = cut(_weighted(picked, weighted, "target", "degree", "to_community", seed + 2))
    edges = graph.select("src", "dst").unionByName(inner.select(named("src").alias("src"), named("dst").alias("dst"))).unionByName(hit.select(named("source").alias("src"), F.col("target").alias("dst")))
    joined = membership.select("community", "vertex").unionByName(own.select("community", named("vertex").alias("vertex"))).unionByName(hit.select(F.col("to_community").alias("community"), named("source").alias("vertex")))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(own.select(named("vertex"))).distinct()
    communities = size.withColumn("is_anomalous", F.lit(False)).unionByName(placed.select("community", "size", F.lit(True).alias("is_anomalous")))
    return Network(simple_graph(edges), nodes, joined.distinct(), communities)


def is_infused(community: Column) -> Column:
    """Whether a community is one that infuse added, by its name."""
    return F.coalesce(community.contains(ANOMALOUS_PREFIX), F.lit(False))


def renumbered(vertices: DataFrame) -> DataFrame:
    """(vertex, number): ids of any kind as 1, 2, ... in their order."""
    return numbered(vertices.select("vertex").distinct(), ["vertex"], "number")
