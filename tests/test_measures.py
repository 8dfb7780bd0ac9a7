import random
from collections import Counter

import pytest

from kithloom.operators import graph as G, measures as B
from kithloom.operators.membership import bipartite

EDGES = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (6, 7)]
SETS = {"P": "123", "Q": "456", "S": "17"}
KNOWN = {
    "P": (2.0, 0.142857, 0.0, 0.333333, 0.497409, -0.221311, 0.276098),
    "Q": (2.0, 0.25, 0.0, 0.666667, 0.461538, -0.444444, 0.017094),
    "S": (0.0, 1.0, 1.0, 1.5, 0.0, -0.566929, -0.566929),
}


@pytest.fixture
def graph(frame):
    return G.simple_graph(frame([(str(a), str(b)) for a, b in EDGES] + [("2", "1")], "src string, dst string"))


@pytest.fixture
def sets(frame):
    return bipartite(frame([(s, v) for s, vs in SETS.items() for v in vs], "community string, vertex string"))


def scores(name, graph, sets):
    return {r.community: None if r.score is None else round(r.score, 6) for r in B.measure(name, graph, sets).collect()}


def test_known_values(graph, sets):
    for at, name in ((0, "avg_degree"), (1, "conductance"), (2, "flake_odf"), (3, "avg_odf"), (6, "unattr_amen")):
        assert scores(name, graph, sets) == {s: v[at] for s, v in KNOWN.items()}, name
    parts = {r.community: (round(r.consistency, 6), round(r.separability, 6)) for r in B.unattr_amen(graph, sets, parts=True).collect()}
    assert parts == {s: v[4:6] for s, v in KNOWN.items()}


def test_cut_ratio_counts_graph_nodes(graph, sets):
    assert scores("cut_ratio", graph, sets) == {"P": round(1 / (3 * 4), 6), "Q": round(2 / (3 * 4), 6), "S": round(3 / (2 * 5), 6)}


def test_missing_members(graph, frame):
    odd = bipartite(frame([("R", v) for v in "67x"], "community string, vertex string"))
    assert scores("flake_odf", graph, odd) == {"R": -1.0}
    assert scores("avg_degree", graph, odd) == {"R": round(2 / 3, 6)}


def test_whole_graph_has_no_cut_ratio(graph, frame):
    everything = bipartite(frame([("V", v) for v in "1234567"], "community string, vertex string"))
    assert scores("cut_ratio", graph, everything) == {"V": None}
    assert scores("conductance", graph, everything) == {"V": None}


def test_ranking_directions(graph, sets):
    ranked = {(r.feature, r.rank): r.community for r in B.rank_measures(graph, sets).collect()}
    assert [ranked["avg_degree", i] for i in (1, 2, 3)] == ["S", "P", "Q"]
    assert [ranked["conductance", i] for i in (1, 2, 3)] == ["S", "Q", "P"]
    assert [ranked["unattr_amen", i] for i in (1, 2, 3)] == ["S", "Q", "P"]


def test_unknown_measure(graph, sets):
    with pytest.raises(ValueError):
        B.measure("nothing", graph, sets)


def test_inside_edges_and_boundary_against_brute_force(frame):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(70)}
    sets = {f"s{i}": set(rng.sample(range(25), rng.randrange(1, 12))) for i in range(8)}
    g = G.simple_graph(frame([(f"{a:02}", f"{b:02}") for a, b in edges], "src string, dst string"))
    m = bipartite(frame([(s, f"{v:02}") for s, vs in sets.items() for v in vs], "community string, vertex string"))
    want = {(s, a, b) for s, vs in sets.items() for a, b in edges if a in vs and b in vs}
    assert {(r.community, int(r.src), int(r.dst)) for r in G.inside_edges(g, m).collect()} == want
    outer = {(s, b) for s, vs in sets.items() for x in edges for a, b in (x, x[::-1]) if a in vs and b not in vs}
    assert {(r.community, int(r.vertex)) for r in G.boundary(g, m).collect()} == outer
    ends = Counter(x for e in edges for x in e)
    want = Counter((s, ends[v]) for s, v in outer)
    for hub in (0, 1, 2, 3, 99):
        assert {(r.community, r.degree): r.n for r in G.boundary_degrees(g, m, hub).collect()} == want, hub


def test_cleaning_and_adjacency(frame):
    e = frame([("a", "b", 3), ("a", "a", 5), ("b", "c", 2), (None, "c", 9), ("c", "a", None)], "src string, dst string, weight long")
    assert G.clean_edges(e, 3).count() == 1
    assert G.clean_edges(e, None).count() == G.clean_edges(e, 0).count() == 3
    g = G.simple_graph(G.clean_edges(e))
    nodes = G.nodes_of(g).union(frame([("z",)], "id string"))
    lines = sorted(r.line for r in G.adjacency_lines(g, nodes).collect())
    assert lines == ["a b c", "b c", "c", "z"]
    again, known = G.parse_adjacency(frame([(x + " # note",) for x in lines] + [("# only",), ("",)], "value string"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in g.collect()} and {r.id for r in known.collect()} == set("abcz")


def test_induced_subgraph_keeps_lonely_vertices(graph, frame):
    edges, ids = G.induced_subgraph(graph, frame([("1",), ("2",), ("7",), ("9",)], "id string"))
    assert [tuple(r) for r in edges.collect()] == [("1", "2")] and ids.count() == 4
