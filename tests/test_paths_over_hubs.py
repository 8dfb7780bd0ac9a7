"""Paths that lead over vertices of very many communities: exact, and without a row for each pair of communities."""

import random
from collections import Counter

import pytest

from kithloom.operators import features as X
from kithloom.operators.membership import bipartite
from kithloom.plans import io_queries
from tests.test_features import brute
from tests.test_features_hubs import moved

SCHEMA = "community string, vertex string"
#: Of some 3,000 rows; a row for each community that each of 300 others reaches over the hub takes several times that.
PATHS_MB = 3


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(frame, monkeypatch, seed):
    monkeypatch.setattr(X, "HOT", 3)
    rng = random.Random(seed)
    edges = {(f"c{rng.randrange(24)}", f"v{rng.randrange(44)}") for _ in range(44)} | {(f"c{i}", f"h{j}") for j in range(3) for i in rng.sample(range(24), 5)}
    vertices, communities = sorted({v for _, v in edges}), sorted({c for c, _ in edges})
    sample = [(c, v, int((c, v) in edges)) for c in communities for v in vertices]
    got = X.topological_features(bipartite(frame(sorted(edges), SCHEMA)), frame(sample, SCHEMA + ", edge_exist int")).collect()
    want = {(c, v): brute(edges, c, v)[3] for c, v, _ in sample}
    assert {(r.community, r.vertex): r.shortest_path for r in got} == want
    assert {5, 7} <= set(Counter(want.values()))


def test_search_follows_the_rows(spark, frame):
    edges = {(f"b{i}", x) for i in range(1000) for x in ("hub", f"v{i}", f"w{i}")} | {(f"a{i}", x) for i in range(300) for x in (f"v{i}", f"u{i}")}
    sample = [(f"a{i}", f"w{(i * 7 + j) % 600 + 300}", 0) for i in range(300) for j in range(10)] + [(f"a{i}", f"u{i + 1}", 0) for i in range(299)]
    m, rows = bipartite(frame(sorted(edges), SCHEMA)).localCheckpoint(), frame(sample, SCHEMA + ", edge_exist int").localCheckpoint()
    before = moved(spark)
    got = Counter(r.shortest_path for r in X.topological_features(m, rows).collect())
    assert got == {5: 3000, 7: 299} and moved(spark) - before < PATHS_MB


def test_ways_to_nowhere_cost_little(spark, frame):
    # from the large community all others are reached, for each of its members that alone lead to a small one
    edges = {("all", f"v{i}") for i in range(1400)} | {(f"b{i % 700}", f"v{i}") for i in range(1400)} | {(f"s{i}", x) for i in range(300) for x in (f"x{i}", f"y{i}")} | {("all", f"x{i}") for i in range(300)}
    m = bipartite(frame(sorted(edges), SCHEMA)).localCheckpoint()
    before = moved(spark)
    got = Counter(r.shortest_path for r in X.topological_features(m).where("community <> 'all' OR vertex LIKE 'x%'").collect())
    assert got == {-1: 900, 3: 1400} and moved(spark) - before < PATHS_MB


@pytest.mark.parametrize("name", ["features_roundtrip", "feature_csv_roundtrip"])
def test_written_features_cost_little(spark, frame, tmp_path, name):
    edges = {("all", f"v{i}") for i in range(1400)} | {(f"b{i % 700}", f"v{i}") for i in range(1400)} | {(f"s{i}", x) for i in range(300) for x in (f"x{i}", f"y{i}")} | {("all", f"x{i}") for i in range(300)}
    frame(sorted(edges), "community string, __id string").write.parquet(str(tmp_path / "vertices.parquet"))
    before = moved(spark)
    assert io_queries.QUERIES[name](spark, str(tmp_path)).where("shortest_path = -1").count() == 900 and moved(spark) - before < PATHS_MB
