import os
import random
from collections import Counter

import pytest

from kithloom.streaming import compactor as C

SCHEMA = "file_id long, community string, file_kind string, file_path string, n_bytes long, body string"


def body(records, order=None, quote=False, end="\n", bom=False, last=True):
    names = order or list(records[0])
    show = (lambda x: '"' + x.replace('"', '""') + '"') if quote else (lambda x: x)
    lines = [",".join(names)] + [",".join(show(r[n]) for n in names) for r in records]
    return ("﻿" if bom else "") + end.join(lines) + (end if last else "")


def edge(i):
    return {"__src_id": f"a{i}", "__dst_id": f"b{i}", "weight": str(i), "mindate": "2012-01-01 00:00:00", "maxdate": ""}


ONE, TWO = [edge(1), edge(2)], [edge(2), edge(1)]
ROWS = [
    (5, "x", "edges", "p", 1, body(ONE)),
    (3, " R/X ", "edges", "p", None, body(TWO, ["weight", "maxdate", "__dst_id", "mindate", "__src_id"], True, "\r\n", True, False)),
    (4, "y", "edges", "p", 1, body(ONE)),
    (6, "x", "edges", "p", 1, body(ONE + [edge(1)])),
    (7, "x", "vertices", "p", 1, "__id\nu1\nu1\nu2\n"),
    (8, "x", "vertices", "p", 1, '__id\r"u2"\r"u1"\r"u1"'),
    (9, "x", "vertices", "p", 1, "__id\n"),
    (10, "x", "vertices", "p", 1, ""),
    (11, "x", "vertices", "p", 1, None),
    (12, "x", "vertices", "p", 1, "__id\n"),
    (13, None, "vertices", "p", 1, "__id\nu9\n"),
    (14, None, "vertices", "p", 1, "__id\nu9\n"),
    (15, "x", "edges", "p", 1, "__src_id;__dst_id;weight;mindate;maxdate\na1;b1;1;2012-01-01 00:00:00;\na2;b2;2;2012-01-01 00:00:00;"),
]


def test_parse():
    assert C.parse_records(body(ONE)) == ONE
    assert C.parse_records('a,b\n"x,""1""\ny",2\n\n3,4,5\n6\n') == [{"a": 'x,"1"\ny', "b": "2"}, {"a": "3", "b": "4", "+2": "5"}, {"a": "6"}]
    assert C.parse_records("﻿") == C.parse_records("a,b") == C.parse_records(None) == []
    assert C.fingerprint(ONE) == C.fingerprint(TWO) != C.fingerprint(ONE + ONE)
    assert C.fingerprint([{"a": "1", "b": "2"}]) != C.fingerprint([{"a": "2", "b": "1"}])


def run(spark, tmp_path, tables, **given):
    source = str(tmp_path / "in")
    for i, rows in enumerate(tables):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        done = C.compact(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **given)
    return done


def test_repeats_and_records(spark, tmp_path):
    done = run(spark, tmp_path, [ROWS])
    assert {r.file_id for r in C.repeats(done.deliveries()).collect()} == {5, 8, 14, 15}
    assert Counter((r.community, r["__src_id"], r.weight) for r in done.edges().collect()) == Counter(
        [("x", "a1", "1"), ("x", "a2", "2"), ("y", "a1", "1"), ("y", "a2", "2"), ("x", "a1", "1"), ("x", "a2", "2"), ("x", "a1", "1")]
    )
    assert Counter((r.community, r["__id"]) for r in done.vertices().collect()) == Counter([("x", "u1"), ("x", "u1"), ("x", "u2"), (None, "u9")])


def test_batches_add_up_and_nothing_is_taken_twice(spark, tmp_path):
    done = run(spark, tmp_path, [ROWS[:3], ROWS[3:8], ROWS[8:]])
    assert done.deliveries().count() == len(ROWS)
    assert {r.file_id for r in C.repeats(done.deliveries()).collect()} == {5, 8, 14, 15}
    assert done.edges().count() == 7 and done.vertices().count() == 4
    again = C.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert again.deliveries().count() == len(ROWS) and again.edges().count() == 7


def test_a_retried_batch_replaces_its_output(spark, tmp_path):
    land, root = C._land(str(tmp_path / "out")), str(tmp_path / "out")
    files = spark.createDataFrame(ROWS, SCHEMA)
    first, second = files.where("file_id < 6"), files.where("file_id >= 6")
    for batch, n in ((first, 0), (second, 1), (second, 1), (first, 0)):
        land(batch, n)
    done = C.settle(spark, root)
    assert done.deliveries().count() == len(ROWS) and done.edges().count() == 7 and done.vertices().count() == 4
    assert C.settle(spark, root).edges().count() == 7 and not os.listdir(tmp_path / "out/landed")


def test_a_broken_generation_is_made_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    C._land(root)(spark.createDataFrame(ROWS, SCHEMA), 0)
    put, delete = C._Files.put, C._Files.delete

    def broken(*_):
        raise OSError("gone")

    monkeypatch.setattr(C._Files, "put", broken)
    with pytest.raises(OSError):
        C.settle(spark, root)
    assert C.Compacted(spark, root).edges().count() == 0
    monkeypatch.setattr(C._Files, "put", put)
    monkeypatch.setattr(C._Files, "delete", broken)
    with pytest.raises(OSError):
        C.settle(spark, root)
    monkeypatch.setattr(C._Files, "delete", delete)
    done = C.settle(spark, root)
    assert done.deliveries().count() == len(ROWS) and done.edges().count() == 7 and done.vertices().count() == 4


def test_small_generations_are_taken_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MERGE_AFTER", 3)
    done = run(spark, tmp_path, [[(i, "c", "vertices", "p", 1, f"__id\nu{i % 4}\n")] for i in range(8)])
    assert done.state()["generations"] == [6, 7] and sorted(os.listdir(tmp_path / "out/vertices")) == ["generation=6", "generation=7"]
    assert done.deliveries().count() == 8 and sorted(r["__id"] for r in done.vertices().collect()) == ["u0", "u1", "u2", "u3"]
    assert {r.file_id for r in C.repeats(done.deliveries()).collect()} == {4, 5, 6, 7}
    assert len(list((tmp_path / "out/vertices/generation=6").glob("part-*.parquet"))) == 1


def test_null_ids_and_bytes_that_are_no_text(spark, tmp_path):
    rows = [(None, "c", "vertices", "p", 1, "__id\nu1\n"), (None, "c", "vertices", "p", 1, "__id\nu2\n"), (1, "c", "vertices", "p", 1, "__id\nu2\n"), (1, "c", "vertices", "p", 1, "__id\nu3\n")]
    bad = spark.createDataFrame(rows, SCHEMA).unionByName(spark.sql("SELECT 9L file_id, 'c' community, 'vertices' file_kind, 'p' file_path, 1L n_bytes, concat('__id\n', cast(unhex('FFFE41') AS string)) body"))
    bad.coalesce(1).write.parquet(str(tmp_path / "in"))
    done = C.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted((r.file_id or 0, r["__id"]) for r in done.vertices().collect()) == [(0, "u1"), (1, "u2"), (1, "u3"), (9, "\ufffd\ufffdA")]


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows, seen, want = [], {}, set()
    ids = list(range(300))
    rng.shuffle(ids)
    for i in sorted(ids):
        records = [edge(rng.randrange(3)) for _ in range(rng.randrange(3))]
        names = ["__src_id", "__dst_id", "weight", "mindate", "maxdate"]
        rng.shuffle(names)
        text = body(records, names, rng.random() < 0.5, rng.choice(["\n", "\r\n"])) if records else ",".join(names)
        community = rng.choice(["a", "b"])
        rows.append((i, community, "edges", "p", 1, text))
        key = (community, frozenset(Counter(r["weight"] for r in records).items()))
        if records and key in seen:
            want.add(i)
        seen.setdefault(key, i)
    rng.shuffle(rows)
    done = run(spark, tmp_path, [rows[:100], rows[100:]])
    assert {r.file_id for r in C.repeats(done.deliveries()).collect()} == want


def test_empty_table(spark, tmp_path):
    done = run(spark, tmp_path, [[]])
    assert done.deliveries().count() == done.edges().count() == C.repeats(done.deliveries()).count() == 0


@pytest.mark.parametrize("target", [200, 1 << 20])
def test_number_of_files_follows_the_target(spark, tmp_path, target):
    run(spark, tmp_path, [[(i, "c", "vertices", "p", 1, f"__id\nu{i}\n") for i in range(40)]], target_bytes=target)
    files = list((tmp_path / "out" / "vertices" / "generation=0").glob("part-*.parquet"))
    assert len(files) == 1 if target > 200 else len(files) > 10
