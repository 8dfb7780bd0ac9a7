"""The queries on small tables with every kind of dirt, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from kithloom.llm import queries as Q

EDGES = "community string, __src_id string, __dst_id string, weight long, mindate timestamp_ntz, maxdate timestamp_ntz, loaded_at timestamp_ntz"


def spelled(x, rng):
    return None if x is None else rng.choice([x, x.upper(), f" {x}", f"{x}\t", f"\t{x} "])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(5)
    edges = []
    for _ in range(2500):
        c = rng.choice(["big", "big", *(f"c{i}" for i in range(6)), None])
        ids = [rng.choice([None, "[deleted]", "bot", *(f"u{rng.randrange(90)}" for _ in range(9))]) for _ in "ab"]
        day = rng.choice([None, *(dt.datetime(2012, 1, d, 23, 59) for d in range(1, 5))])
        edges.append((c, *ids, 1, day, None, None))
    dirty = [(rng.choice(["", "r/", "R/"]) + spelled(e[0], rng).strip() if e[0] and rng.random() < 0.3 else spelled(e[0], rng), spelled(e[1], rng), spelled(e[2], rng), *e[3:]) for e in edges]
    spark.createDataFrame(dirty, EDGES).write.parquet(f"{folder}/edges.parquet")
    vertices = [(c, v) for c in ("big", "c1", "only") for v in ("u1", "u2", "w1", "[deleted]", None)] * 2
    spark.createDataFrame([(*v, None) for v in vertices], "community string, __id string, loaded_at timestamp_ntz").write.parquet(f"{folder}/vertices.parquet")
    return folder, edges, vertices


def test_p5(spark, tables, tmp_path):
    import os
    import shutil

    folder, edges, _ = tables
    users = lambda keep: {x for e in edges if keep(e) for x in e[1:3] if x not in (None, "[deleted]")}
    day = dt.date(2012, 1, 2)
    on = lambda e: e[4] is not None and e[4].date() == day
    slices = {
        (None, None, None): users(lambda e: True), ("big", None, None): users(lambda e: e[0] == "big"), ("R/C1 ", None, day): users(lambda e: e[0] == "c1" and on(e)),
        (None, None, day): users(on), ("c1", "c2", None): users(lambda e: e[0] in ("c1", "c2")), ("c2", "c1", day): users(lambda e: e[0] in ("c1", "c2") and on(e)),
        ("c3", "c3", None): users(lambda e: e[0] == "c3"), ("nowhere", None, None): set(), ("nowhere", "c1", None): users(lambda e: e[0] == "c1"),
    }
    rows, want = [], set()
    for (a, b, d), ids in slices.items():
        for part in (0.0, 0.5, 0.84, 0.85, 0.86, 0.95, 1.0, 1.1, 1.14, 1.15, 1.16, 1.5, 3.0):
            n = round(part * len(ids)) if ids else round(part)
            rows.append((len(rows), a, b, d, n))
            if abs(n - len(ids)) * 100 > 15 * len(ids):
                want.add(len(rows) - 1)
        rows.append((len(rows), a, b, d, None))
    shutil.copytree(folder, tmp_path / "t")
    spark.createDataFrame(rows, "size_id long, subreddit_name string, with_subreddit string, size_day date, num_users long").write.parquet(str(tmp_path / "t/reddit_comm_sizes.parquet"))
    got = [r.size_id for r in Q.p5_found(spark, str(tmp_path / "t")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert os.path.exists(tmp_path / "t/edges.parquet")


def test_p5_estimates(spark, tables):
    folder, edges, _ = tables
    seen = defaultdict(set)
    for c, a, b, _, at, *_ in edges:
        for x in (a, b):
            if x not in (None, "[deleted]"):
                d = at.date() if at else None
                for key in {(c, d), (c, None), (None, d), (None, None)}:
                    seen[key].add(x)
    got = {(r.community, r.day): r for r in Q.p5_distinct_users(spark, folder).collect()}
    assert set(got) == set(seen)
    for key, r in got.items():
        assert abs(r.n_est - len(seen[key])) < 2


def test_p1_and_p4_run_over_dirt(spark, tables):
    folder, edges, vertices = tables
    members = defaultdict(set)
    for c, a, b, *_ in edges:
        members[c] |= {a, b}
    for c, v in vertices:
        members[c].add(v)
    members = {c: xs - {None, "[deleted]"} for c, xs in members.items() if c}
    names = sorted(members)
    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = len(members[a] & members[b])
            if n >= 30 and 4 * n >= min(len(members[a]), len(members[b])):
                want.add((a, b))
    assert {tuple(r) for r in Q.p4_found(spark, folder).collect()} == want and want
    listed = {r.item_a for r in Q.p1_listed_pairs(spark, folder).collect()}
    assert listed <= {"u1", "u2", "w1"}
    assert Q.p1_found(spark, folder).columns == ["src_a", "src_b"]


def test_p4_sizes_of_every_pair(spark, tables):
    folder, edges, vertices = tables
    members = defaultdict(set)
    for c, *ids in [e[:3] for e in edges] + vertices:
        members[c] |= set(ids) - {None, "[deleted]"}
    names = sorted(c for c in members if c)
    want = {(a, b): len(members[a] & members[b]) for a in names for b in names if a < b and members[a] & members[b]}
    got = Q.p4_overlap_sizes(spark, folder).collect()
    assert {tuple(sorted((r.small, r.large))): r.n_shared for r in got} == want and len(got) == len(want)
    assert min(want.values()) < 30


def test_p5_unions(spark, tables, tmp_path):
    import shutil

    folder, edges, _ = tables
    day = dt.date(2012, 1, 2)
    rows = [(1, "R/C2 ", "c1", None, 5), (2, "c1", "c2", None, None), (3, "c1", "big", day, 7), (4, "nowhere", "c3", day, 1), (5, "nowhere", "gone", None, 1), (6, "c1", None, None, 1), (7, "c1", "c1", None, 1)]
    shutil.copytree(folder, tmp_path / "t")
    spark.createDataFrame(rows, "size_id long, subreddit_name string, with_subreddit string, size_day date, num_users long").write.parquet(str(tmp_path / "t/reddit_comm_sizes.parquet"))
    users = lambda cs, d: {x for e in edges if e[0] in cs and (d is None or e[4] and e[4].date() == d) for x in e[1:3] if x not in (None, "[deleted]")}
    want = {(a, b, d): len(users((a, b), d)) for a, b, d in [("c1", "c2", None), ("big", "c1", day), ("c3", "nowhere", day), ("gone", "nowhere", None)]}
    got = Q.p5_union_users(spark, str(tmp_path / "t")).collect()
    assert {(r.community, r.with_community, r.day) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.n_est - want[r.community, r.with_community, r.day]) < 2 and r.rel_error < 0.009 for r in got)


def test_p1_pairs_seen_together_once(spark, tmp_path):
    day = dt.datetime(2012, 1, 2)
    edges = [("c1", a, "x", 1, day, None, None) for a in ("u1", " U2", "w1", "u3")] + [("c1", a, "x", 1, day + dt.timedelta(1), None, None) for a in ("u1", "u2")]
    spark.createDataFrame(edges, EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame([("c1", v, None) for v in ("u1", "u2", "w1")], "community string, __id string, loaded_at timestamp_ntz").write.parquet(str(tmp_path / "vertices.parquet"))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_records, r.lift) for r in Q.p1_all_listed_pairs(spark, str(tmp_path)).collect()}
    assert got == {("u1", "u2"): (2, 2, 1.0), ("u1", "w1"): (1, 2, 1.0), ("u2", "w1"): (1, 2, 1.0)}
