"""What queries over the links leave on disk before their last step."""

import os
import random
import time

import pytest

from kithloom import session as S
from kithloom.operators import graph, measures, order, sampling
from kithloom.operators.codes import Codes, coded
from kithloom.operators.features import FEATURES
from kithloom.operators.membership import bipartite
from kithloom.plans import graph_queries, io_queries
from kithloom.sources import readers as R, writers as W
from tests.test_features_hubs import network  # noqa: F401

#: Of shuffles for some 5,000 links; what counts and other small actions leave is below it, a table of links is not.
LEFT_KB = 30


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    every = [found.apply(i) for i in range(found.size())]
    return {f.getName(): f.length() for f in every if f.getName().startswith("shuffle_")}


def left_since(spark, before, most):
    """KB of new shuffle files, once they are no more than ``most`` or after some seconds; files go a little later than their step ends."""
    for _ in range(50):
        left = sum(size for name, size in shuffle_files(spark).items() if name not in before) / 1e3
        if left <= most:
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("how", [S.keep, S.cut])
def test_kept_tables_leave_no_shuffle_files(spark, how):
    before = shuffle_files(spark)
    kept = how(spark.range(50_000).repartition(4, "id"))
    assert left_since(spark, before, 0) == 0 and kept.count() == 50_000
    assert spark.conf.get(S.REMOVES_SHUFFLES) == "false"


def test_tables_on_the_way_are_removed(spark):
    on_the_way = []

    def build():
        kept = S.keep(spark.range(9))
        on_the_way.extend(f.removeprefix("file://") for f in kept.inputFiles())
        return kept

    assert S.keep_result(spark, build).count() == 9
    assert on_the_way and not any(os.path.exists(f) for f in on_the_way)


def test_codes(spark, network):  # noqa: F811
    codes, names = coded(network), {tuple(r) for r in network.collect()}
    assert {tuple(r) for r in codes.decode(codes.links).collect()} == names
    drawn = {tuple(r) for r in codes.decode(sampling.negative_codes(codes, 99, 5)).collect()}
    assert len(drawn) == 99 and drawn == {tuple(r) for r in sampling.negative_sample(network, 99, 5).collect()} and not {r[:2] for r in drawn} & names


@pytest.mark.parametrize("name", ["confusion_metrics", "topological_features"])
def test_links_leave_no_shuffle_files(spark, network, tmp_path, name):  # noqa: F811
    network.withColumnRenamed("vertex", "__id").write.parquet(str(tmp_path / "vertices.parquet"))
    before = shuffle_files(spark)
    query = (graph_queries.QUERIES | io_queries.QUERIES)[name](spark, str(tmp_path))
    assert left_since(spark, before, LEFT_KB) <= LEFT_KB and query.columns


@pytest.mark.parametrize("name", ["feature_csv_roundtrip", "features_roundtrip"])
def test_names_come_in_when_the_way_is_cleared(spark, network, tmp_path, monkeypatch, name):  # noqa: F811
    network.withColumnRenamed("vertex", "__id").write.parquet(str(tmp_path / "vertices.parquet"))
    there, decode, before = [], Codes.decode, set(S._made)

    def watched(codes, df):
        there.extend(os.path.basename(p).split("-")[0] for p in S._made if p not in before)
        return decode(codes, df)

    monkeypatch.setattr(Codes, "decode", watched)
    assert io_queries.QUERIES[name](spark, str(tmp_path)).count() == network.count()
    assert there.count("features") == 2 and not {"links", "members"} & set(there)  # what is to be written, and the finished features


def test_measures_are_ranked_from_finished_tables(spark, frame, monkeypatch):
    joins = []

    def watched(df, purpose):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return S.keep(df, purpose)

    monkeypatch.setattr(order, "keep", watched)
    g = frame([(f"v{i}", f"v{j}") for i in range(6) for j in range(i + 1, 6)], "src string, dst string")
    m = bipartite(frame([("a", "v0"), ("a", "v1"), ("b", "v1"), ("b", "v2"), ("b", "v3")], "community string, vertex string"))
    assert measures.rank_measures(g, m).count() == 2 * len(measures.MEASURES) and joins == [0]


@pytest.mark.parametrize("seed", [1, 2])
def test_boundary_counts(frame, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample([f"v{i}" for i in range(30)], 2))) for _ in range(60)}
    members = {(f"c{rng.randrange(9)}", f"v{rng.randrange(40)}") for _ in range(40)} | {(f"c{i}", f"v{j}") for i in range(9) for j in (0, 1, 2) if rng.random() < 0.7}
    g, m = frame(sorted(edges), "src string, dst string"), bipartite(frame(sorted(members), "community string, vertex string"))
    want: dict[str, int] = {}
    for r in graph.boundary(g, m).collect():
        want[r.community] = want.get(r.community, 0) + 1
    for hub in (1, 3, 99):
        assert {r.community: r.n_boundary for r in graph.boundary_counts(g, m, hub).collect()} == want


def test_feature_csv_may_be_compressed(frame, tmp_path):
    columns = ", ".join(f"{c} long" for c in FEATURES)
    rows = frame([("a", "x", 1, 2, 3, 4, 5, 6, 1), ("b", "y", 6, 5, 4, 3, 2, 1, 0)], f"community string, vertex string, {columns}, edge_exist int")
    W.write_feature_csv(rows, str(tmp_path / "f"), compression="gzip")
    assert list((tmp_path / "f").glob("*.csv.gz")) and sorted(R.read_feature_csv(rows.sparkSession, str(tmp_path / "f")).collect()) == sorted(rows.collect())
