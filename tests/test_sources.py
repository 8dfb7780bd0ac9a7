import json
import os

import pytest
from pyspark.sql import functions as F

from kithloom.functions import text
from kithloom.operators.features import FEATURES
from kithloom.operators.membership import bipartite, labelled
from kithloom.sources import readers as R, writers as W

MAP = {"b, c": ["v1", "v2", "v1"], "a": ["v2", "x, y"], "empty": []}


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    return path


def test_partition_map_round_trip(spark, tmp_path):
    m = R.read_partition_map(spark, put(tmp_path, "map.json", json.dumps(MAP)))
    assert {tuple(r) for r in m.collect()} == {("b, c", "v1"), ("b, c", "v2"), ("a", "v2"), ("a", "x, y")}
    W.write_partition_map(m, str(tmp_path / "again"))
    assert {tuple(r) for r in R.read_partition_map(spark, str(tmp_path / "again")).collect()} == {tuple(r) for r in m.collect()}


def test_sizes(spark, tmp_path, frame):
    assert [tuple(r)[1:] for r in R.read_size_list(spark, put(tmp_path, "l.json", "[3, 5]")).collect()] == [(0, 3), (1, 5)]
    known = R.read_size_map(spark, put(tmp_path, "d.json", '{"a": 3, "b": null}'))
    assert {tuple(r) for r in known.collect()} == {("a", 3), ("b", None)}
    W.write_sizes(known, str(tmp_path / "sizes"))
    assert {tuple(r) for r in R.read_size_map(spark, str(tmp_path / "sizes")).collect()} == {("a", 3), ("b", None)}
    assert {tuple(r) for r in R.sizes_of_names(frame([("a",), ("z",)], "community string"), known).collect()} == {("a", 3), ("z", None)}


def test_csv_folders(spark, tmp_path):
    put(tmp_path, "x/x.edges.csv", "__src_id,__dst_id,weight,mindate,maxdate\n1,2,3,a,b\n")
    put(tmp_path, "y/y.edges.csv", "__src_id,__dst_id,weight,mindate,maxdate\n4,5,6,a,b\n")
    put(tmp_path, "x/x.vertices.csv", "__id\n1\n2\n")
    assert {(r.community, r.src, r.weight) for r in R.read_edges(spark, str(tmp_path)).collect()} == {("x", "1", 3), ("y", "4", 6)}
    assert {tuple(r) for r in R.read_vertices(spark, str(tmp_path)).collect()} == {("x", "1"), ("x", "2")}


def test_adjacency_round_trip(spark, tmp_path, frame):
    g, nodes = frame([("a", "b"), ("a", "c")], "src string, dst string"), frame([(x,) for x in "abcz"], "id string")
    W.write_adjacency(g, nodes, str(tmp_path / "adj"))
    again, known = R.read_adjacency(spark, str(tmp_path / "adj"))
    assert {tuple(r) for r in again.collect()} == {("a", "b"), ("a", "c")} and {r.id for r in known.collect()} == set("abcz")


def test_features_round_trip(spark, tmp_path, frame):
    schema = "community string, vertex string, " + ", ".join(f"{c} long" for c in FEATURES) + ", edge_exist int"
    rows = [("a", "v, w", 1, 2, 3, 3, 4, 5, 1), ("b", "x", 1, 2, 0, -1, 4, 5, 0)]
    f = frame(rows, schema)
    W.write_features(f, f.limit(1), str(tmp_path / "f"))
    assert R.read_features(spark, str(tmp_path / "f"))[0].count() == 2
    W.write_feature_csv(f, str(tmp_path / "csv"))
    assert {tuple(r) for r in R.read_feature_csv(spark, str(tmp_path / "csv")).collect()} == set(rows)


def test_results_logs_rankings(spark, tmp_path, frame):
    put(tmp_path, "OurResults_3.csv", "rank,f__ranking,f__score\n0,a,1.5\n1,b,0.5\n")
    assert {tuple(r) for r in R.read_results(spark, str(tmp_path), "OurResults", ("f",)).collect()} == {("OurResults_3", "f", 0, "a", 1.5), ("OurResults_3", "f", 1, "b", 0.5)}
    put(tmp_path, "NetworkLog_3.json", json.dumps({"enumeration": 3, "norm_comm_sizes": [1], "anom_comm_sizes": [2], "bipart_train_part": {"a": ["1"]}, "bipart_test_part": {}}, indent=1))
    assert R.read_logs(spark, str(tmp_path)).first().bipart_train_part == {"a": ["1"]}
    m = bipartite(frame([("a", "1"), ("b", "2")], "community string, vertex string"))
    known = frame([("a", 5, False), ("b", 3, False), ("z", 9, True)], "community string, size long, is_anomalous boolean")
    W.write_log(str(tmp_path / "logs/NetworkLog_4.json"), 4, known, m.where("community = 'a'"), m.where("community = 'b'"))
    for log, n in ((R.read_logs(spark, str(tmp_path / "logs"), lines=True), 4), (R.read_logs(spark, str(tmp_path)), 3)):
        want = {4: ({(4, False, 3), (4, False, 5), (4, True, 9)}, {(4, "train", "a", "1"), (4, "test", "b", "2")}), 3: ({(3, False, 1), (3, True, 2)}, {(3, "train", "a", "1")})}[n]
        assert ({tuple(r) for r in R.log_sizes(log).collect()}, {tuple(r) for r in R.log_members(log).collect()}) == want
    ranking = frame([(2, "b", 0.5), (1, "a", 1.5), (3, "c, d", None)], "rank int, community string, score double")
    for lines in (False, True):
        path = W.write_ranking(ranking, str(tmp_path / f"rank{lines}"), lines, with_time=lines)
        assert sorted(tuple(r) for r in R.read_ranking(spark, path, lines).collect()) == [(1, "a", 1.5), (2, "b", 0.5), (3, "c, d", None)]
    assert {os.path.basename(r.path) for r in R.list_files(spark, str(tmp_path), "Results").collect()} == {"OurResults_3.csv"}


def test_lines_hold_parts_of_a_community(spark, tmp_path, frame):
    m = frame([("big", str(i)) for i in range(500)] + [("a, b", "x\ty"), ("é/ü", "z")], "community string, vertex string")
    lists = W.member_lists(m, 40).collect()
    assert max(len(r.members) for r in lists) < 100 and len(lists) > 10
    W.write_partition_map(m, str(tmp_path / "lines"), lines=True)
    assert sorted(tuple(r) for r in R.read_partition_map(spark, str(tmp_path / "lines"), lines=True).collect()) == sorted(tuple(r) for r in m.collect())
    W.write_vertices(m, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in R.read_vertices(spark, str(tmp_path / "csv"), partitioned=True).collect()) == sorted(tuple(r) for r in m.collect())


def test_names_of_folders(spark, tmp_path):
    put(tmp_path, "a b+c, d/a b+c, d.edges.csv", "__src_id,__dst_id,weight,mindate,maxdate\n1,2,3,a,b\n")
    assert [r.community for r in R.read_edges(spark, str(tmp_path)).collect()] == ["a b+c, d"]


def test_one_document_is_bounded(frame, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "LARGEST_DOCUMENT", 3)
    m = frame([("a", str(i)) for i in range(4)], "community string, vertex string")
    with pytest.raises(ValueError, match="lines"):
        W.write_partition_map(m, str(tmp_path / "x"))


def test_triples_by_stem(spark, tmp_path):
    for name in ("maps/N_2_train_partition.json", "maps/N_2_test_partition.json", "maps/N_1_test_partition.json", "maps/N_1_train_partition.json", "maps/N_0_train_partition.json", "maps/Raw_data/N_0_test_partition.json"):
        put(tmp_path, name, "{}")
    for name in ("N_2", "N_1", "N_0"):
        put(tmp_path, f"nets/{name}_network.adjlist", "a b")
    got = R.file_triples(spark, str(tmp_path / "maps"), str(tmp_path / "nets")).orderBy("enumeration").collect()
    assert [(r.enumeration, r.stem, os.path.basename(r.test)) for r in got] == [(0, "N_1", "N_1_test_partition.json"), (1, "N_2", "N_2_test_partition.json")]


def test_results_guard(spark, tmp_path, frame):
    r = frame([("min", 1, "a", 0.5)], "size_group string, enumeration int, community string, score double")
    W.write_results(r, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        W.write_results(r, str(tmp_path / "out"))
    W.write_results(r, str(tmp_path / "out"), replace=True)
    W.write_config(spark, {"generator": test_results_guard, "p": 0.1}, str(tmp_path / "c.json"))
    assert tuple(spark.read.json(str(tmp_path / "c.json")).select("generator", "p").first()) == ("test_results_guard", 0.1)


def test_labels_and_names(frame):
    m = bipartite(frame([("a", "1")], "community string, vertex string"))
    assert labelled(m, "page", "editor").columns == ["page", "editor"]
    r = frame([(7, 110)], "i int, n int").select(
        text.padded_name("comm", F.col("i"), F.col("n")).alias("name"), text.edge_key(F.lit("a"), F.lit("b, c")).alias("k")
    )
    assert r.first().name == "comm0007"
    ids = frame([("007",), ("x7",), (None,), ("9" * 30,)], "v string")
    assert {x.v: x.n for x in ids.select("v", text.numeric_id(F.col("v")).alias("n")).collect()} == {"007": 7, "x7": None, None: None, "9" * 30: None}
    head, rest = text.parse_edge_key(F.col("k"))
    assert tuple(r.select(head, rest).first()) == ("a", "b, c")
    assert text.setting_name("Alg", 0.05, (1, 1), 0.01) == "Alg_p0.05_k[1,1]_m0.01"
