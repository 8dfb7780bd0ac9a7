import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from kithloom.operators import generators as N, sampling as S
from kithloom.operators.evaluation import average_precision, label_anomalous
from kithloom.operators.graph import nodes_of
from kithloom.operators.measures import MEASURES
from kithloom.operators.meta import META
from kithloom.plans import experiment
from kithloom.plans.detector import detect
from kithloom.sources import readers


@pytest.fixture
def placed(frame):
    return N.offsets(frame([(1, "a", 40), (2, "b", 60), (3, "c", 1)], "idx long, community string, size long", 1))


def test_offsets(placed):
    assert {r.community: r.start for r in placed.collect()} == {"a": 1, "b": 41, "c": 101}
    assert N.community_vertices(placed).count() == 101


@pytest.mark.parametrize("make", [N.er_edges, N.er_edges_hashed])
def test_er_density_and_seed(placed, make):
    edges = {tuple(r) for r in make(placed, 0.2, 1).collect()}
    pairs = 40 * 39 / 2 + 60 * 59 / 2
    assert 0.15 * pairs < len(edges) < 0.25 * pairs and all(s < d for _, s, d in edges)
    assert edges == {tuple(r) for r in make(placed.repartition(5), 0.2, 1).collect()}
    assert make(placed, 0.0, 1).count() == 0 and make(placed, 1.0, 1).count() == pairs


def test_ba_is_a_tree_for_one(placed):
    edges = [tuple(r) for r in N.ba_edges(placed, 1, 1).collect()]
    assert len(edges) == 39 + 59 and len({(c, d) for c, _, d in edges}) == len(edges)
    assert N.ba_edges(placed, 3, 1).count() == 37 * 3 + 57 * 3


def test_inter_edges(placed):
    inner = N.ba_edges(placed, 1, 1)
    names = placed.select("community")
    edges, joined = N.inter_edges(placed, inner, names, names, 0.1, (2, 2), 5)
    home = {r.vertex: r.community for r in N.community_vertices(placed).collect()}
    got = edges.collect()
    assert len(got) == (4 + 6) * 2 and all(home[r.src] != home[r.dst] for r in got)
    assert all(home[r.vertex] != r.community for r in joined.collect())


def test_inter_edges_of_a_community_that_holds_nearly_all(frame):
    placed = N.offsets(frame([(1, "a", 20), (2, "b", 900), (3, "c", 30)], "idx long, community string, size long", 1))
    names = placed.select("community")
    edges, _ = N.inter_edges(placed, N.ba_edges(placed, 1, 1), names, names, 0.1, (2, 2), 5)
    home = {r.vertex: r.community for r in N.community_vertices(placed).collect()}
    got = [(home[r.src], home[r.dst]) for r in edges.collect()]
    assert len(got) == (2 + 90 + 3) * 2 and all(a != b for a, b in got)
    assert 45 <= got.count(("b", "a")) <= 100


def test_network_and_infusion(spark):
    named = N.named_sizes(spark, [30, 40, 50], [20])
    net = N.generate_network(named, p=0.3, seed=3)
    assert net.nodes.count() == 140 and {r.community for r in net.communities.where("is_anomalous").collect()} == {"comm04"}
    assert {r.community for r in net.membership.collect()} == {"comm01", "comm02", "comm03", "comm04"}
    more = N.infuse(net.edges, net.membership, [10, 12], 0.5, 0.3, (1, 2), 4)
    assert more.communities.where("is_anomalous").count() == 2
    assert nodes_of(more.edges).where("id LIKE 'GenNode%'").count() > 10
    assert net.edges.join(more.edges, ["src", "dst"], "left_anti").count() == 0


def test_unknown_generator():
    with pytest.raises(ValueError):
        N.generator("nothing")


def test_sizes_and_draws(spark, frame):
    sizes = frame([(f"c{i}", i) for i in range(1, 101)], "community string, size long")
    for group in S.SIZE_GROUPS:
        got = [r["size"] for r in S.anomalous_sizes(sizes, 50, group, 10, 1).orderBy("slot").collect()]
        assert got == sorted(got) and len(got) == 50
        low = {"min": 1, "quantile10": 5, "quartile1": 20, "median": 45, "mean": 45, "random": 1}[group]
        high = 100 if group == "random" else low + 10
        assert low <= got[0] and got[-1] <= high
    with pytest.raises(ValueError):
        S.anomalous_sizes(sizes, 5, "huge", 10, 1)
    drawn = S.draw_names(sizes, [], "community", 7, 1)
    assert drawn.count() == 7
    picks = S.weighted_pick(spark.range(2000).withColumnRenamed("id", "draw"), frame([("x", 9), ("y", 1), ("z", 0)], "name string, w long"), "draw", "name", "w", 2)
    counts = {r["name"]: r["count"] for r in picks.groupBy("name").count().collect()}
    assert sum(counts.values()) == 2000 and 1700 < counts["x"] < 1900 and "z" not in counts


def test_grid():
    assert len(experiment.grid([0.1, 0.2], [0.01], ["min", "median"], range(5))) == 20


def test_detection_finds_injected_communities(spark):
    """Communities that many of their members share with others score less normal than the rest."""
    rng = random.Random(1)
    sizes = spark.createDataFrame([(f"c{i}", int(30 * 50 ** (0.6 * rng.random() ** 2))) for i in range(200)], "community string, size long")
    setting = experiment.Setting(0.4, 0.05, "median", 1, 5)
    prepared = experiment.prepare(spark, sizes, setting, n_normal=60, n_anomalous=6, n_train=20)
    found = detect(prepared.train, prepared.test, seed=5)
    assert found.predictor.validation.first().acc > 0.7 and found.probabilities.where("prob < 0 OR prob > 1").count() == 0
    judged = label_anomalous(found.ranking, prepared.communities.where("is_anomalous"))
    ap = {r.feature: r.ap for r in average_precision(judged, ["feature"]).collect()}
    assert ap["normality_prob_mean"] > 0.8 and ap["predicted_label_mean"] > 0.8  # 6 of 46 by chance
    last = found.ranking.where("feature = 'predicted_label_mean' AND rank > 40")
    assert last.join(prepared.communities.where("is_anomalous"), "community").count() >= 4


def test_one_setting_of_the_grid(spark, frame, tmp_path):
    sizes = frame([(f"c{i}", 20 + i) for i in range(30)], "community string, size long")
    setting = experiment.grid([0.3], [0.2], ["median"], [1])
    got = experiment.run_grid(spark, sizes, setting, str(tmp_path / "kept"), n_normal=10, n_anomalous=3, n_train=4).cache()
    assert {r.algorithm for r in got.select("algorithm").distinct().collect()} == {*META, *MEASURES}
    by = got.groupBy("algorithm").agg({"is_anomalous": "sum", "community": "count"}).collect()
    assert all(r["sum(is_anomalous)"] == 3 and r["count(community)"] == 9 for r in by)
    again = spark.read.parquet(str(tmp_path / "kept"))
    assert again.count() == got.count() and again.first().enumeration == 1
    judged = {r.algorithm: r.mean_ap for r in experiment.precision(got).collect()}
    turned = {r.algorithm: r.mean_ap for r in experiment.precision(got, baselines_high=False).collect()}
    high = average_precision(got, ["algorithm"], True).collect()
    low = average_precision(got, ["algorithm"], False).collect()
    for rows, one, two in ((high, judged, turned), (low, turned, judged)):
        for r in rows:
            if r.algorithm in MEASURES:
                assert (two if r.algorithm in ("avg_degree", "unattr_amen") else one)[r.algorithm] == pytest.approx(r.ap)
    assert all(judged[a] == turned[a] == pytest.approx(r.ap) for r in low for a in [r.algorithm] if a in META)


def test_experiments_over_files(spark, tmp_path):
    setting = experiment.grid([0.3], [0.2], ["min"], [1])[0]
    folder = experiment.folder_of(str(tmp_path), "Alg", setting)
    for i in range(2):
        net = N.generate_network(N.named_sizes(spark, [20] * 6, [15] * 2), p=0.3, seed=i)
        members = net.membership
        train = members.where("community < 'comm03'")
        graph = net.edges
        experiment.write_data(experiment.Prepared(train, members.where("community >= 'comm03'"), graph, net.communities), folder, "min", f"Net_{i}")
    (tmp_path / "Raw_data").mkdir()
    fast = DecisionTreeClassifier(labelCol="edge_exist", maxDepth=2)
    assert experiment.run_folders(spark, str(tmp_path), 0, 1, size_groups=["min"], n_anomalous=2, max_experiments=1, measured=("avg_degree",), classifier=fast) == 1
    assert experiment.run_folders(spark, str(tmp_path), 1, 3, size_groups=["min"]) == 0
    out = readers.literal(f"{folder}/ResultsAndLogs/min")
    ours = readers.read_results(spark, out, "OurResults", META)
    assert {r.experiment for r in ours.select("experiment").distinct().collect()} == {"OurResults_0"} and ours.count() == 6 * len(META)
    assert readers.read_results(spark, out, "BaselineResults", ("avg_degree",)).count() == 6
    logs = readers.read_logs(spark, out, lines=True)
    assert sorted(r["size"] for r in readers.log_sizes(logs).where("is_anomalous").collect()) == [15, 15]
    assert readers.log_members(logs).where("split = 'train'").count() == train.count()


def test_real_networks_with_infused_communities(spark):
    net = N.generate_network(N.named_sizes(spark, [30] * 6, []), seed=1)
    got = experiment.prepare_infused(net.edges, net.membership, experiment.grid([0.3], [0.3], ["min"], [1])[0], n_anomalous=3, n_train=2)
    odd = {r.community for r in got.communities.where("is_anomalous").collect()}
    assert len(odd) == 3 and {r.community for r in got.test.where(N.is_infused(F.col("community"))).collect()} == odd
    assert got.train.where(N.is_infused(F.col("community"))).count() == 0 and got.graph.count() > 0


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_ranges_come_in_chunks(frame, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    placed = N.offsets(frame([(1, "a", 100), (2, "b", 1), (3, "c", 50)], "idx long, community string, size long", 1))
    assert sorted(r.vertex for r in N.community_vertices(placed).collect()) == list(range(1, 152))
    edges = N.ba_edges(placed, 1, 4).collect()
    assert sorted(r.dst for r in edges) == [*range(2, 101), *range(103, 152)] and all(r.src < r.dst for r in edges)


def test_attachment_prefers_high_degrees(spark):
    placed = N.offsets(spark.createDataFrame([(1, "a", 20_000)], "idx long, community string, size long"))
    degree = {}
    for r in N.ba_edges(placed, 1, 1).collect():
        for v in (r.src, r.dst):
            degree[v] = degree.get(v, 0) + 1
    # of such a network a part 4 / (k (k + 1) (k + 2)) of all vertices has degree k
    for k, part in ((1, 2 / 3), (2, 1 / 6), (3, 1 / 15)):
        assert abs(sum(d == k for d in degree.values()) / 20_000 - part) < 0.015
    assert max(degree.values()) > 60
