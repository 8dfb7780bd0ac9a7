"""Topological features of links of the bipartite network, with the link itself removed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kithloom.operators.membership import sizes, vertex_degrees
from kithloom.operators.pairs import HOT, set_words
from kithloom.operators.skew import lookup_join
from kithloom.session import cut, keep, keep_result

#: So many of the vertices of the most communities are bits of a word in the search for paths.
PATH_HUBS = 32
FEATURES = ("total_friends", "preferential_attachment_score", "friends_measure", "shortest_path", "vertex_1_degree", "vertex_2_degree")


def with_degrees(m: DataFrame, sample: DataFrame) -> DataFrame:
    """sample (community, vertex, edge_exist) with degrees after the link's removal, their sum and product (A1-A3)."""
    joined = sample.join(sizes(m), "community", "left").join(vertex_degrees(m), "vertex", "left").fillna(0, ["size", "degree"])
    a, b = F.col("size") - F.col("edge_exist"), F.col("degree") - F.col("edge_exist")
    return joined.select(
        "community", "vertex", "edge_exist", (a + b).alias("total_friends"), (a * b).alias("preferential_attachment_score"), a.alias("vertex_1_degree"), b.alias("vertex_2_degree")
    )


def with_vertex_degree(m: DataFrame) -> DataFrame:
    """m with the degree of its vertex, kept as a table."""
    return keep(m.withColumn("degree", F.count("*").over(Window.partitionBy("vertex"))), "members")


def _hub_bound(flat: DataFrame) -> int:
    """Vertices of more communities than this are hubs: the power of two from HOT on for which friends cost the fewest rows.

    Without hubs a vertex costs the square of its degree. With them a community costs the square of its hubs, and each pair of
    communities of an ordinary vertex the second one's hubs.
    """
    most = flat.agg(F.max("degree").alias("d")).first()["d"] or 0
    bounds = [HOT]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 2)
    if len(bounds) == 1:
        return HOT
    below = [F.sum(F.when(F.col("degree") <= t, F.col("degree")).otherwise(0)).cast("double").alias(f"s{t}") for t in bounds]
    above = [F.count_if(F.col("degree") > t).cast("double").alias(f"h{t}") for t in bounds]
    each = flat.where("degree > 1").groupBy("community").agg(*below, *above)
    cost = each.agg(*(F.sum(F.col(f"s{t}") * (1 + F.col(f"h{t}")) + F.col(f"h{t}") * F.col(f"h{t}")).alias(str(t)) for t in bounds)).first()
    return min(bounds, key=lambda t: cost[str(t)])


def _met(flat: DataFrame, lists: DataFrame, rows: DataFrame, own: DataFrame, bound: int) -> DataFrame:
    """(community, vertex, edge_exist, friends_measure) of the rows that meet friends: ``rows`` (community, vertex, edge_exist, at) of ordinary vertices, ``own`` without ``at`` of hubs.

    Members that two communities share are either ordinary vertices, whose pairs of communities are listed, or hubs, which are bits
    of words of each community. A hub's own rows need no pairs of its communities: ordinary members are added up over the listed
    pairs whose second community has the hub, other hubs by how many communities two hubs share.
    """
    key = ["community", "vertex", "edge_exist"]
    pairs = lists.select("at", F.explode("at").alias("community")).select("community", F.explode("at").alias("c2")).where("c2 <> community").groupBy("community", "c2").agg(F.count("*").alias("n"))
    hubs = cut(flat.where(F.col("degree") > bound))
    some = not hubs.isEmpty()
    if some:
        pairs = keep(pairs, "pairs")
    others = rows.select(*key, F.explode("at").alias("c2")).where("c2 <> community")
    # a link's vertex is an ordinary member of each such pair, so what is taken off for it belongs here
    parts = [others.join(pairs, ["community", "c2"]).select(*key, (F.col("n") - F.col("edge_exist")).alias("n"))]
    if some:
        words = cut(set_words(hubs.select(F.col("community").alias("g"), F.col("vertex").alias("x")), hubs.select(F.col("vertex").alias("x"), F.col("degree").alias("d")).distinct()))
        ours = words.select(F.col("g").alias("community"), "w", "bits")
        theirs = words.select(F.col("g").alias("c2"), "w", F.col("bits").alias("bits2"))
        common = lookup_join(lookup_join(others, ours, ["community"]), theirs, ["c2", "w"])
        parts.append(common.select(*key, F.bit_count(F.col("bits").bitwiseAND(F.col("bits2"))).cast("long").alias("n")))

        own = cut(own.select(*key))
        other, member = hubs.select("community", F.col("vertex").alias("u")), hubs.select("community", "vertex")
        together = member.join(other, "community").where("u <> vertex").groupBy("vertex", "u").agg(F.count("*").alias("k"))
        parts.append(own.join(other, "community").where("u <> vertex").join(together, ["vertex", "u"]).select(*key, (F.col("k") - F.col("edge_exist")).alias("n")))
        by_pairs = lookup_join(pairs, member.withColumnRenamed("community", "c2"), ["c2"]).groupBy("community", "vertex").agg(F.sum("n").alias("n"))
        parts.append(own.join(by_pairs, ["community", "vertex"]).select(*key, "n"))
    return reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("n").alias("friends_measure"))


def linked(m: DataFrame, sample: DataFrame | Callable[[], DataFrame] | None = None, flat: DataFrame | None = None) -> DataFrame:
    """sample (community, vertex, edge_exist), or all links of ``m``, with degrees after the link's removal, their sum and product, and the friends measure.

    ``flat`` is with_vertex_degree(m) if that is already there. ``sample`` may be a function; the tables kept by it are removed when
    they are no longer needed.
    """
    flat = with_vertex_degree(m) if flat is None else flat
    bound = _hub_bound(flat)
    lists = flat.where((F.col("degree") > 1) & (F.col("degree") <= bound)).groupBy("vertex").agg(F.collect_list("community").alias("at"), F.first("degree").alias("degree"))
    lists = keep(lists, "lists")
    if sample is None:
        rows = flat.withColumn("edge_exist", F.lit(1))
        near, own = lists.select("vertex", F.explode("at").alias("community"), F.lit(1).alias("edge_exist"), "at"), rows.where(F.col("degree") > bound)
    else:
        lone = flat.where("degree = 1").select("vertex", F.array("community").alias("at"), "degree")
        hubs = flat.where(F.col("degree") > bound).select("vertex", F.lit(None).cast(f"array<{dict(flat.dtypes)['community']}>").alias("at"), "degree").distinct()
        known = lists.unionByName(lone).unionByName(hubs)
        rows = keep_result(m.sparkSession, lambda: (sample() if callable(sample) else sample).join(known, "vertex", "left").fillna(0, ["degree"]), "rows")
        linking = rows.where(F.col("degree") > F.col("edge_exist"))
        near, own = linking.where("at IS NOT NULL"), linking.where("at IS NULL")
        rows = rows.drop("at")
    found = keep(_met(flat, lists, near, own, bound), "found")
    alone = F.col("degree") <= F.col("edge_exist")
    rest = rows.where(~alone).join(found, ["community", "vertex", "edge_exist"], "left").fillna(0, ["friends_measure"])
    both = rows.where(alone).withColumn("friends_measure", F.lit(0).cast("long")).unionByName(rest)
    counted = cut(sizes(flat))
    joined = lookup_join(both, counted, ["community"], "left").fillna(0, ["size"])
    a, b = F.col("size") - F.col("edge_exist"), F.col("degree") - F.col("edge_exist")
    return joined.select(
        "community", "vertex", "edge_exist", (a + b).alias("total_friends"), (a * b).alias("preferential_attachment_score"), "friends_measure", a.alias("vertex_1_degree"), b.alias("vertex_2_degree")
    )


def friends_measure(m: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(community, vertex, edge_exist, friends_measure): links between the two nodes' neighbourhoods.

    Sum, over the vertex's other communities, of the members shared with this one; the vertex itself, which a present link puts
    into both, isn't counted.
    """
    return linked(m, sample).select("community", "vertex", "edge_exist", "friends_measure")


def _other_communities(m: DataFrame, rows: DataFrame) -> DataFrame:
    """(community, vertex, at): the communities each row's vertex has besides the row's own."""
    return rows.join(m.select(F.col("community").alias("at"), "vertex"), "vertex").where("at <> community").select("community", "vertex", "at")


def _next(frontier: DataFrame, bridges: DataFrame, key: list[str]) -> DataFrame:
    """(key, at): the communities that share a member with those of the frontier; of a row with a vertex, another member than that."""
    ends = frontier.join(bridges.select(F.col("community").alias("at"), F.col("vertex").alias("via")), "at")
    ends = ends.where("via <> vertex") if "vertex" in key else ends
    return ends.select(*key, "via").distinct().join(bridges.select(F.col("vertex").alias("via"), F.col("community").alias("at")), "via").select(*key, "at").distinct()


def _hops_of_links(rows: DataFrame, flat: DataFrame, bridges: DataFrame) -> DataFrame | None:
    """(community, vertex, hops) of links without common friends, the link itself left out.

    What is reached depends on the vertex: each row has its own frontier, never through the vertex itself. It starts at the community
    or at the vertex's others, whichever have fewer memberships beside them: a side that leads nowhere is soon seen through, and a hub
    doesn't begin with nearly all communities.
    """
    beside = flat.where("degree > 1").groupBy("community").agg(F.sum("degree").alias("w"))
    around = bridges.join(beside, "community").groupBy("vertex").agg(F.sum("w").alias("all"))
    sides = cut(rows.select("community", "vertex").join(beside, "community").join(around, "vertex").select("community", "vertex", (F.col("all") - F.col("w") < F.col("w")).alias("back")))
    ends = bridges.withColumnRenamed("community", "at")
    back = sides.where("back").select("community", "vertex")
    frontier = cut(sides.where("NOT back").select("community", "vertex", F.col("community").alias("at")).unionByName(back.join(ends, "vertex").where("at <> community")))
    back = cut(back.withColumn("at", F.col("community")))
    seen, found, length = frontier, None, 1
    while not frontier.isEmpty():
        length += 2
        reached = cut(_next(frontier, bridges, ["community", "vertex"]).join(seen, ["community", "vertex", "at"], "left_anti"))
        # of a row that starts at its community this is never reached again, so what is met is the other side
        met = reached.join(ends, ["at", "vertex"], "left_semi").where("at <> community").join(back, ["community", "vertex"], "left_anti").unionByName(reached.join(back, ["community", "vertex", "at"], "left_semi"))
        hit = cut(met.select("community", "vertex").distinct().withColumn("hops", F.lit(length)))
        found = hit if found is None else found.unionByName(hit)
        frontier = cut(reached.join(hit, ["community", "vertex"], "left_anti"))
        seen = seen.unionByName(frontier)
    return found


def _components(bridges: DataFrame) -> DataFrame:
    """(community, part): communities that a path joins have the same part."""
    parts = cut(bridges.select("community", F.col("community").alias("part")).distinct())
    while True:
        by_vertex = bridges.join(parts, "community").groupBy("vertex").agg(F.min("part").alias("part"))
        grown = cut(bridges.join(by_vertex, "vertex").groupBy("community").agg(F.min("part").alias("part")))
        if grown.join(parts, ["community", "part"], "left_anti").isEmpty():
            return grown
        parts = grown


def _hops_of_non_links(rows: DataFrame, m: DataFrame, bridges: DataFrame) -> DataFrame | None:
    """(community, vertex, hops) of non-links without common friends.

    Rows whose ends no path joins are left out at once. What a community reaches doesn't depend on the vertex, so all its rows share
    one frontier of (community, at); a community whose rows are all found leaves it.
    """
    if rows.isEmpty():
        return None
    parts = _components(bridges)
    ends = _other_communities(m, rows).join(parts, "community").join(parts.withColumnRenamed("community", "at"), ["at", "part"])
    open_ends = cut(ends.select("community", "vertex", "at"))
    frontier = cut(open_ends.select("community", F.col("community").alias("at")).distinct())
    seen, found, length = frontier, None, 1
    while not frontier.isEmpty():
        length += 2
        reached = cut(_next(frontier, bridges, ["community"]).join(seen, ["community", "at"], "left_anti"))
        hit = cut(open_ends.join(reached, ["community", "at"], "left_semi").select("community", "vertex").distinct().withColumn("hops", F.lit(length)))
        found = hit if found is None else found.unionByName(hit)
        open_ends = cut(open_ends.join(hit, ["community", "vertex"], "left_anti"))
        frontier = cut(reached.join(open_ends.select("community").distinct(), "community", "left_semi"))
        seen = seen.unionByName(frontier)
    return found


def _hub_words(bridges: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Of communities (community, has, once, twice), of vertices (vertex, own, near), the PATH_HUBS largest hubs as bits; None without hubs.

    ``has``: hubs in the community; ``once`` and ``twice``: hubs that share a community with a member, or with two; ``own``: the bit of
    a hub itself; ``near``: hubs that share a community with the vertex.
    """
    top = [r["vertex"] for r in degrees.where(F.col("degree") > HOT).orderBy(F.desc("degree"), "vertex").limit(PATH_HUBS).collect()]
    if not top:
        return None
    own = reduce(lambda found, i: found.when(F.col("vertex") == F.lit(top[i]), F.lit(1 << i)), range(1, len(top)), F.when(F.col("vertex") == F.lit(top[0]), F.lit(1)))
    marked = bridges.withColumn("own", F.coalesce(own, F.lit(0)).cast("long"))
    has = cut(marked.groupBy("community").agg(F.bit_or("own").alias("has")))
    vertices = keep(lookup_join(marked, has, ["community"]).groupBy("vertex").agg(F.first("own").alias("own"), F.bit_or("has").alias("near")), "near")
    counts = bridges.join(vertices, "vertex").groupBy("community").agg(*(F.count_if(F.col("near").bitwiseAND(F.lit(1 << i)) != 0).alias(f"k{i}") for i in range(len(top))))
    word = lambda least: reduce(Column.bitwiseOR, [F.when(F.col(f"k{i}") >= least, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(len(top))])
    return cut(has.join(counts.select("community", word(1).alias("once"), word(2).alias("twice")), "community")), vertices


def _short_hops(rows: DataFrame, flat: DataFrame, bridges: DataFrame) -> DataFrame | None:
    """(community, vertex, edge_exist, hops) of rows without common friends whose way leads over a hub in 5 or 7 hops; None without hubs.

    Such rows have no way of 3. A hub of one end that is near the other gives 5, so nothing need be enumerated. A hub near both gives
    7 at most; only for these the communities beside both ends are listed, over ordinary members, and 5 is left where they meet. The
    row's vertex is never passed, so a link's own edge isn't.
    """
    words = _hub_words(bridges, flat.where("degree > 1").select("vertex", "degree").distinct())
    if words is None:
        return None
    communities, vertices = words
    key = ["community", "vertex", "edge_exist"]
    ends = rows.join(flat.select(F.col("community").alias("at"), "vertex"), "vertex").where("at <> community")
    ends = lookup_join(lookup_join(ends, communities, ["community"]), communities.toDF("at", "has2", "once2", "twice2"), ["at"])
    ends = ends.join(vertices, "vertex", "left").fillna(0, ["own", "near"])
    linked = F.col("edge_exist") == 1
    others = lambda c: F.when(linked, c.bitwiseAND(F.bitwise_not("own"))).otherwise(c)
    beside = lambda once, twice: others(F.when(linked, F.col(once).bitwiseAND(F.bitwise_not("near")).bitwiseOR(F.col(twice))).otherwise(F.col(once)))
    a, b, near_a, near_b = others(F.col("has")), others(F.col("has2")), beside("once", "twice"), beside("once2", "twice2")
    hops = F.when(a.bitwiseAND(near_b).bitwiseOR(near_a.bitwiseAND(b)) != 0, 5).when(near_a.bitwiseAND(near_b) != 0, 7)
    judged = keep(ends.select(*key, "at", hops.alias("hops")), "ends")
    best = judged.groupBy(*key).agg(F.min("hops").alias("hops")).where("hops IS NOT NULL")
    doubtful = cut(judged.join(best.where("hops = 7"), key, "left_semi").select(*key, "at"))
    if doubtful.isEmpty():
        return cut(best)
    asked = doubtful.select("community").union(doubtful.select("at")).distinct()
    plain = bridges.join(vertices.where("own = 0"), "vertex", "left_semi")
    next_to = plain.join(asked, "community").join(bridges.select("vertex", F.col("community").alias("x")), "vertex").where("x <> community")
    next_to = keep(next_to.groupBy("community", "x").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("hi")), "beside")
    number = next_to.groupBy("community").agg(F.count("*").alias("n"))
    sized = doubtful.join(number, "community").join(number.toDF("at", "n2"), "at")
    ordered = sized.select(*key, F.when(F.col("n") <= F.col("n2"), F.col("community")).otherwise(F.col("at")).alias("p"), F.when(F.col("n") <= F.col("n2"), F.col("at")).otherwise(F.col("community")).alias("q"))
    one, two = next_to.toDF("p", "x", "lo", "hi"), next_to.toDF("q", "x", "lo2", "hi2")
    met = ordered.join(one, "p").where("lo <> vertex OR hi <> vertex").join(two, ["q", "x"]).where("lo2 <> vertex OR hi2 <> vertex").select(*key).distinct()
    return cut(best.join(met.withColumn("less", F.lit(5)), key, "left").select(*key, F.coalesce("less", "hops").alias("hops")))


def shortest_paths(flat: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (community, vertex, edge_exist, friends_measure, both degrees, ...) with shortest_path, -1 where there is none.

    A positive friends measure means 3, a degree of 0 means no path. Ways of 5 or 7 over hubs are read from words of hubs. For the
    other rows the communities within reach grow hop by hop, over members of several communities, until they hold the row's own or nothing new is reached, however long that takes; each
    hop is cut from its lineage. ``flat``, which is with_vertex_degree(m), and ``known`` are read in every hop, so they should be kept tables.
    """
    simple = F.when(F.col("friends_measure") > 0, 3).when((F.col("vertex_1_degree") == 0) | (F.col("vertex_2_degree") == 0), -1)
    known = known.withColumn("shortest_path", simple)
    open_rows = cut(known.where("shortest_path IS NULL").select("community", "vertex", "edge_exist"))
    if open_rows.isEmpty():
        return known
    bridges = flat.where("degree > 1").select("community", "vertex")
    short = _short_hops(open_rows, flat, bridges)
    if short is not None:
        open_rows = cut(open_rows.join(short, ["community", "vertex", "edge_exist"], "left_anti"))
    parts = [
        _hops_of_links(open_rows.where("edge_exist = 1").drop("edge_exist"), flat, bridges),
        _hops_of_non_links(open_rows.where("edge_exist <> 1").drop("edge_exist"), flat, bridges),
    ]
    found = [p.withColumn("edge_exist", F.lit(e)) for p, e in zip(parts, (1, 0)) if p is not None] + ([] if short is None else [short])
    if not found:
        return known.withColumn("shortest_path", F.coalesce("shortest_path", F.lit(-1)))
    joined = known.where("shortest_path IS NULL").join(reduce(DataFrame.unionByName, found), ["community", "vertex", "edge_exist"], "left")
    searched = joined.withColumn("shortest_path", F.coalesce("hops", F.lit(-1))).drop("hops")
    return known.where("shortest_path IS NOT NULL").unionByName(searched)  # so only searched rows are moved for the join


def topological_features(m: DataFrame, sample: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """(community, vertex, FEATURES, edge_exist) of every link of the sample, or of all links (G3, G4); ``sample`` as for linked."""
    flat = with_vertex_degree(m)
    base = keep_result(m.sparkSession, lambda: linked(m, sample, flat), "features")
    return shortest_paths(flat, base).select("community", "vertex", *FEATURES, "edge_exist")
