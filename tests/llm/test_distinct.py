import random

import pytest
from pyspark.sql import functions as F

from kithloom.llm import distinct as D

SCHEMA = "c string, id string, slot int, bits long"


@pytest.mark.parametrize("n", [1, 10, 300, 5_000, 60_000, 700_000])
def test_error_stays_within_its_bound(spark, n):
    ids = spark.range(n).select(F.lit("k").alias("c"), F.concat(F.lit("u"), "id").alias("id"))
    r = D.estimate(D.sketch(ids, ["c"], F.col("id")), ["c"]).first()
    assert r.rel_error < 0.009 and abs(r.n_est - n) <= 5 * r.rel_error * n + 1


def test_merged_parts_equal_the_whole(frame):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"u{rng.randrange(3000)}", 1, 1) for _ in range(9000)]
    df = frame(rows, SCHEMA)
    parts = D.sketch(df, ["c"], F.col("id"))
    whole = D.sketch(df.withColumn("all", F.lit(1)), ["all"], F.col("id"))
    merged = D.merge(parts.withColumn("all", F.lit(1)), ["all"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    again = D.merge(merged.unionByName(merged), ["all"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_null_keys_and_ids(frame):
    rows = [(None, "a", 0, 0), (None, None, 0, 0), ("x", None, 0, 0), ("y", "a", 0, 0), ("y", "a", 0, 0)]
    got = {r.c: round(r.n_est, 3) for r in D.estimate(D.sketch(frame(rows, SCHEMA), ["c"], F.col("id")), ["c"]).collect()}
    assert got == {None: 1.0, "y": 1.0}


def test_empty(frame):
    assert D.estimate(D.sketch(frame([], SCHEMA), ["c"], F.col("id")), ["c"]).count() == 0


@pytest.mark.parametrize("key", ["part", "base", "s", "scale", "loads", "level"])
def test_keys_of_any_name(frame, key):
    df = frame([(k, str(i)) for k in "ab" for i in range(50)], f"{key} string, id string")
    got = {r[key]: r.n_est for r in D.estimate(D.sketch(df, [key], F.col("id")), [key]).collect()}
    assert set(got) == {"a", "b"} and all(abs(n - 50) < 1 for n in got.values())
