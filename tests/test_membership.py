import pytest

from kithloom.operators import membership as M

ROWS = [("A", "1"), ("A", "2"), ("A", "3"), ("B", "2"), ("B", "3"), ("B", "4"), ("C", "4"), ("C", "5"), ("D", "6")]


@pytest.fixture
def m(frame):
    return M.bipartite(frame([*ROWS, ("A", "1"), (None, "9"), ("A", None)], "community string, vertex string"))


def test_bipartite_is_a_set_without_nulls(m):
    assert sorted(map(tuple, m.collect())) == sorted(ROWS)


def test_properties(m):
    assert M.properties(m).first().asDict() == {"n_communities": 4, "n_vertices": 6, "n_nodes": 10, "n_edges": 9}


def test_overlap(m):
    assert sorted(map(tuple, M.overlap(m).collect())) == [("A", "B", 2), ("B", "C", 1)]


def test_overlapping_pairs_by_either_count(m):
    assert [tuple(r) for r in M.overlapping_pairs(m, 2, 1).collect()] == [("A", "B", 2)]
    assert M.overlapping_pairs(m, 1, 2).count() == 0
    assert [tuple(r) for r in M.overlapping_pairs(m, 1, 2, symmetric=True).collect()] == [("B", "C", 1)]
    assert sorted(r[0] for r in M.overlapping_names(M.overlapping_pairs(m, 1, 1)).collect()) == ["A", "B", "C"]


def test_filters(m, frame):
    names = frame([("A",), ("D",)], "community string")
    assert {r.community for r in M.keep_communities(m, names).collect()} == {"A", "D"}
    assert {r.community for r in M.drop_communities(m, names).collect()} == {"B", "C"}
    with pytest.raises(KeyError):
        M.keep_communities(m, frame([("Z",)], "community string"))


def test_sizes_and_describe(m):
    sizes = M.sizes(m)
    assert {r.community: r["size"] for r in sizes.collect()} == {"A": 3, "B": 3, "C": 2, "D": 1}
    d = M.describe(sizes, "size", "norm_comm_").first().asDict()
    assert (d["norm_comm_count"], d["norm_comm_sum"], d["norm_comm_min"], d["norm_comm_max"], d["norm_comm_median"], d["norm_comm_perc75"]) == (4, 9, 1, 3, 2.5, 3.0)
    assert {r.community for r in M.size_between(sizes, 2, 3).collect()} == {"A", "B", "C"}


def test_split(frame):
    names = frame([(f"c{i}", i > 7) for i in range(10)], "community string, is_anomalous boolean")
    split = {r.community: r.split for r in M.split_communities(names, 3, 5).collect()}
    assert sum(v == "train" for v in split.values()) == 3 and split["c8"] == split["c9"] == "test"
    assert split == {r.community: r.split for r in M.split_communities(names.repartition(1), 3, 5).collect()}


def test_distinct_users(frame):
    e = frame([("x", "1", "2"), ("x", "2", "1"), ("y", None, "3"), ("y", "3", "3")], "community string, src string, dst string")
    assert {tuple(r) for r in M.distinct_users(e, ["community"]).collect()} == {("x", 2), ("y", 1)}


def test_empty(frame):
    m = M.bipartite(frame([], "community string, vertex string"))
    assert M.properties(m).first().n_edges == 0 and M.overlap(m).count() == 0
