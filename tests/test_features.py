import random
from collections import deque

import duckdb
import pytest

from kithloom.operators import features as X, sampling as S
from kithloom.operators.membership import bipartite
from kithloom.plans import graph_queries, graph_sql

ROWS = [("A", "1"), ("A", "2"), ("A", "3"), ("B", "2"), ("B", "3"), ("B", "4"), ("C", "4"), ("C", "5"), ("D", "6")]
KNOWN = """A 1 2 0 0 -1 2 0 1
A 2 3 2 1 3 2 1 1
B 2 3 2 1 3 2 1 1
B 4 3 2 0 -1 2 1 1
C 4 2 1 0 -1 1 1 1
C 5 1 0 0 -1 1 0 1
D 6 0 0 0 -1 0 0 1
A 4 5 6 2 3 3 2 0
A 5 4 3 0 5 3 1 0
B 5 4 3 1 3 3 1 0
D 1 2 1 0 -1 1 1 0
C 1 3 2 0 5 2 1 0"""


def test_known_values(frame):
    m = bipartite(frame(ROWS, "community string, vertex string"))
    want = {(a, b, int(e)): tuple(map(int, v)) for a, b, *v, e in (line.split() for line in KNOWN.splitlines())}
    sample = frame(list(want), "community string, vertex string, edge_exist int")
    got = {(r.community, r.vertex, r.edge_exist): tuple(r[c] for c in X.FEATURES) for r in X.topological_features(m, sample).collect()}
    assert got == want


def brute(edges, c, x):
    """Features by definition, with the edge (c, x) removed."""
    left = edges - {(c, x)}
    of_c = {v for a, v in left if a == c}
    of_x = {a for a, v in left if v == x}
    friends = sum((a, v) in left for a in of_x for v in of_c)
    around = {}
    for a, v in left:
        around.setdefault(("c", a), []).append(("v", v))
        around.setdefault(("v", v), []).append(("c", a))
    seen, todo = {("c", c): 0}, deque([("c", c)])
    while todo:
        at = todo.popleft()
        for n in around.get(at, ()):
            if n not in seen:
                seen[n] = seen[at] + 1
                todo.append(n)
    return (len(of_c) + len(of_x), len(of_c) * len(of_x), friends, seen.get(("v", x), -1), len(of_c), len(of_x))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(frame, seed):
    rng = random.Random(seed)
    edges = {(f"c{rng.randrange(12)}", f"v{rng.randrange(30)}") for _ in range(34)}
    pairs = {(f"c{i}", f"v{j}") for i in range(12) for j in range(30) if any(a == f"c{i}" for a, _ in edges) and any(v == f"v{j}" for _, v in edges)}
    sample = [(*e, 1) for e in edges] + [(*p, 0) for p in sorted(pairs - edges)]
    m = bipartite(frame(list(edges), "community string, vertex string"))
    got = X.topological_features(m, frame(sample, "community string, vertex string, edge_exist int")).collect()
    assert len(got) == len(sample)
    for r in got:
        assert tuple(r[c] for c in X.FEATURES) == brute(edges, r.community, r.vertex), (r, seed)


def test_paths_of_any_length(frame):
    # a chain of communities, each with one member of the next: from c0 to the last vertex it is 2 * 11 + 1 steps
    edges = {(f"c{i}", f"v{j}") for i in range(12) for j in (i, i + 1)} | {("far", "w")}
    sample = [("c0", "v9", 0), ("c0", "v8", 0), ("c0", "v12", 0), ("c0", "w", 0), ("c11", "v0", 0)]
    m = bipartite(frame(list(edges), "community string, vertex string"))
    got = {(r.community, r.vertex): r.shortest_path for r in X.topological_features(m, frame(sample, "community string, vertex string, edge_exist int")).collect()}
    assert got == {(c, v): brute(edges, c, v)[3] for c, v, _ in sample}
    assert sorted(got.values()) == [-1, 15, 17, 23, 23]


def test_links_of_a_ring(frame):
    # every link of a ring of communities has one way round; the link itself doesn't count
    edges = {(f"c{i:02d}", f"v{j % 12:02d}") for i in range(12) for j in (i, i + 1)} | {("c03", "v09"), ("tail", "v00"), ("tail", "end")}
    m = bipartite(frame(list(edges), "community string, vertex string"))
    got = X.topological_features(m, frame([(*e, 1) for e in edges], "community string, vertex string, edge_exist int")).collect()
    assert {(r.community, r.vertex): r.shortest_path for r in got} == {e: brute(edges, *e)[3] for e in edges}
    assert {-1, 11} <= {r.shortest_path for r in got}


def test_sql_searches_as_far(spark, tmp_path):
    rows = [(f"c{i:02d}", f"v{j:02d}") for i in range(12) for j in (i, i + 1)] + [("far", "w"), ("far", "v11x"), ("d", "v00"), ("d", "y")]
    spark.createDataFrame(rows, "community string, __id string").write.parquet(str(tmp_path / "vertices.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW vertices AS SELECT * FROM '{tmp_path}/vertices.parquet/*.parquet'")
    for name in ("topological_features", "shortest_path"):
        got = graph_queries.QUERIES[name](spark, str(tmp_path))
        want = duck.sql(graph_sql.ORACLE[name])
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
        if name == "topological_features":
            assert max(r.shortest_path for r in got.collect()) > 15


def test_negatives(frame):
    m = bipartite(frame(ROWS, "community string, vertex string"))
    got = {(r.community, r.vertex) for r in S.negative_sample(m, 9, 3).collect()}
    assert len(got) == 9 and not got & set(ROWS)
    assert got == {(r.community, r.vertex) for r in S.negative_sample(m.repartition(7), 9, 3).collect()}


def test_negatives_end_where_none_are_left(frame):
    full = bipartite(frame([(c, v) for c in "AB" for v in "12"], "community string, vertex string"))
    assert S.negative_sample(full, 4).count() == 0
    nearly = bipartite(frame([(c, v) for c in "AB" for v in "12"][:3], "community string, vertex string"))
    assert [tuple(r)[:2] for r in S.negative_sample(nearly, 5).collect()] == [("B", "2")]


def test_positive_sample_is_bounded(frame):
    m = bipartite(frame(ROWS, "community string, vertex string"))
    assert S.positive_sample(m).count() == 9 and S.positive_sample(m, 4, 1).count() == 4 and S.positive_sample(m, 99, 1).count() == 9
