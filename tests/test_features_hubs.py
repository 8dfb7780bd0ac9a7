"""Features where a few vertices are in nearly every community: right, and without a row for each pair of communities."""

import random

import pytest

from kithloom.operators import features as X
from kithloom.operators.membership import bipartite
from kithloom.plans import graph_queries
from tests.test_features import brute

#: Of some 5,000 links; a row for each two communities of a hub is more than a million.
LINKS_MB = 3
SCHEMA = "community string, vertex string"


def moved(spark):
    """MB that tasks shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size())) / 1e6


@pytest.fixture
def network(frame):
    """14 hubs in nearly all of 300 communities, which have three members of their own and share one with the next."""
    rng = random.Random(5)
    rows = {(f"c{i}", f"v{i}_{j}") for i in range(300) for j in range(3)} | {(f"c{i}", f"v{i + 1}_0") for i in range(299)}
    rows |= {(f"c{i}", f"hub{h}") for i in range(300) for h in range(14) if rng.random() < 0.9}
    return bipartite(frame(sorted(rows), SCHEMA)).localCheckpoint()


def test_friends_measure_follows_the_links(spark, network):
    before = moved(spark)
    got = X.friends_measure(network, network.selectExpr("community", "vertex", "1 AS edge_exist")).where("friends_measure > 0").count()
    assert got > 3700 and moved(spark) - before < LINKS_MB


@pytest.mark.parametrize("seed", [3, 4])
def test_hubs_against_brute_force(frame, monkeypatch, seed):
    monkeypatch.setattr(X, "HOT", 4)
    rng = random.Random(seed)
    edges = {(f"c{rng.randrange(12)}", f"v{rng.randrange(30)}") for _ in range(30)} | {(f"c{i}", f"h{j}") for i in range(12) for j in range(3) if rng.random() < 0.7}
    vertices, communities = sorted({v for _, v in edges}), sorted({c for c, _ in edges})
    sample = [(c, v, int((c, v) in edges)) for c in communities for v in vertices]
    m = bipartite(frame(sorted(edges), SCHEMA))
    assert X._hub_bound(X.with_vertex_degree(m)) < 8
    got = X.linked(m, frame(sample, SCHEMA + ", edge_exist int")).collect()
    assert {(r.community, r.vertex): (r.total_friends, r.preferential_attachment_score, r.friends_measure) for r in got} == {(c, v): brute(edges, c, v)[:3] for c, v, _ in sample}
    links = {(r.community, r.vertex): r.friends_measure for r in X.friends_measure(m).collect()}
    assert links == {e: brute(edges, *e)[2] for e in edges}


def test_probabilities_follow_the_links(spark, network, tmp_path):
    network.withColumnRenamed("vertex", "__id").write.parquet(str(tmp_path / "vertices.parquet"))
    before = moved(spark)
    assert graph_queries.QUERIES["meta_feature_ranking"](spark, str(tmp_path)).count() == 6 * 300
    assert moved(spark) - before < LINKS_MB


@pytest.mark.parametrize("name", ["shortest_path"])
def test_paths_follow_the_links(spark, network, tmp_path, name):
    network.withColumnRenamed("vertex", "__id").write.parquet(str(tmp_path / "vertices.parquet"))
    before = moved(spark)
    graph_queries.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < LINKS_MB


def test_link_of_a_hub_alone(frame):
    # a community that only the hub joins to others: without this link there is no way, and no search among the hub's communities
    edges = {(f"c{i}", "hub") for i in range(12)} | {(f"c{i}", x) for i in range(11) for x in ("w", f"v{i}")} | {("c11", "own")}
    got = X.topological_features(bipartite(frame(sorted(edges), SCHEMA))).collect()
    assert {(r.community, r.vertex): r.shortest_path for r in got} == {e: brute(edges, *e)[3] for e in edges}


def test_curve_follows_the_links(spark, network, tmp_path):
    network.withColumnRenamed("vertex", "__id").write.parquet(str(tmp_path / "vertices.parquet"))
    before = moved(spark)
    graph_queries.QUERIES["pr_curve"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < LINKS_MB
