import random

import pytest

from kithloom.operators import graph as G, pairs as P


def sets(seed):
    rng = random.Random(seed)
    return {f"s{i:02}": {f"x{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))} | {f"bot{b}" for b in range(70) if rng.random() < 0.8} for i in range(40)}


@pytest.mark.parametrize("hot, block", [(1, 7), (5, 256), (64, 256)])
def test_shared_counts(frame, hot, block):
    data = sets(1)
    names = sorted(data)
    want = {(a, b): len(data[a] & data[b]) for i, a in enumerate(names) for b in names[i + 1 :] if data[a] & data[b]}
    got = P.shared_counts(frame([(g, x) for g, xs in data.items() for x in xs], "g string, x string"), hot, block).collect()
    assert {(r.a, r.b): r.n_shared for r in got} == want and len(got) == len(want)


def test_no_sets_and_no_common_items(frame):
    assert P.shared_counts(frame([], "g string, x string")).count() == 0
    assert P.shared_counts(frame([("a", "1"), ("b", "2")], "g string, x string")).count() == 0


@pytest.mark.parametrize("few", [1, 10**9])
def test_boundary_by_degree_either_way(frame, monkeypatch, few):
    monkeypatch.setattr(G, "FEW_SETS", few)
    rng = random.Random(4)
    g = G.simple_graph(frame([(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(200)], "src string, dst string"))
    m = frame(sorted({(f"c{rng.randrange(9)}", f"v{rng.randrange(70)}") for _ in range(150)} | {(f"c{i}", "v1") for i in range(9)}), "community string, vertex string")
    deg = {r.vertex: r.degree for r in G.degrees(g).collect()}
    want = {}
    for r in G.boundary(g, m).collect():
        want[r.community, deg[r.vertex]] = want.get((r.community, deg[r.vertex]), 0) + 1
    assert {(r.community, r.degree): r.n for r in G.boundary_degrees(g, m, 3).collect()} == want
