import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kithloom.operators import skew

SCHEMA = "k string, v string, at int, n_rows string"


def rows(seed=1, n=4000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice(["hot", "hot", "warm", None, *(f"k{rng.randrange(700)}" for _ in range(4))])
        out.append((k, rng.choice([None, f"v{rng.randrange(60)}"]), i, "clash"))
    return out + out[:50]


def test_heavy_keys_have_no_misses(frame):
    data = rows()
    counts = Counter(r[0] for r in data if r[0] is not None)
    total = sum(counts.values())
    found = {r.k for r in skew.heavy_keys(frame(data, SCHEMA), "k", 0.05).collect()}
    assert {k for k, c in counts.items() if c >= 0.05 * total} <= found
    assert len(found) <= 40


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_counts_and_profile(frame, share):
    data = rows()
    df = frame(data, SCHEMA)
    want = Counter(r[0] for r in data)
    assert {r.k: r.n_rows for r in skew.key_counts(df, "k", share).collect()} == want
    values, first = defaultdict(set), {}
    for k, v, at, _ in data:
        if v is not None:
            values[k].add(v)
        first[k] = min(at, first.get(k, at))
    got = skew.key_profile(df.drop("n_rows"), "k", ["v"], [F.min("at").alias("first_at")], share).collect()
    assert {r.k: (r.n_rows, r.n_v, r.first_at) for r in got} == {k: (c, len(values[k]), first[k]) for k, c in want.items()}


def test_empty_and_all_null(frame):
    assert skew.key_counts(frame([], SCHEMA), "k").count() == 0
    assert [tuple(r) for r in skew.key_counts(frame([(None, "a", 1, "")] * 3, SCHEMA), "k").collect()] == [(None, 3)]
    assert skew.key_profile(frame([], SCHEMA).drop("n_rows"), "k", ["v"]).count() == 0


def test_keys_of_several_columns(frame):
    data = [(f, k, i, "") for i, (k, v, *_) in enumerate(rows()) for f, k in (("k", k), ("v", v))]
    df = frame(data, SCHEMA.replace("v string", "w string")).withColumnsRenamed({"k": "f", "w": "k"}).drop("n_rows")
    want = Counter((f, k) for f, k, *_ in data)
    assert {(r.f, r.k): r.n_rows for r in skew.key_counts(df, ["f", "k"], 0.02).collect()} == want
    got = skew.key_profile(df, ["f", "k"], ["at"], [F.max("at").alias("last")], 0.02).collect()
    assert {(r.f, r.k): (r.n_rows, r.n_at) for r in got} == {k: (n, n) for k, n in want.items()}
    assert 2 <= skew.heavy_keys(df, ["f", "k"], 0.05).count() <= 40


def test_sketches_are_combined_in_groups(frame, monkeypatch):
    monkeypatch.setattr(skew, "GROUPS", 2)
    df = frame(rows(), SCHEMA, 9)
    assert "hot" in {r.k for r in skew.heavy_keys(df, "k", 0.05).collect()}


def test_ties_are_all_heavy(frame):
    data = [(f"k{i % 4}", None, i, "") for i in range(400)]
    assert skew.heavy_keys(frame(data, SCHEMA), "k", 0.25).count() == 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_ordinary_join(frame, how):
    left = frame(rows(), SCHEMA)
    right = frame([("hot", "x"), ("hot", "y"), ("k1", "z"), ("k2", None), (None, "n")], "k string, w string")
    want = sorted(map(repr, left.join(right, ["k"], how).collect()))
    assert sorted(map(repr, skew.skew_join(left, right, ["k"], how, 4, 0.05).select(left.join(right, ["k"], how).columns).collect())) == want


@pytest.mark.parametrize("most", [10, 3])
def test_lookups(frame, most):
    left = frame(rows(), SCHEMA)
    right = frame([("hot", "x"), ("hot", "y"), ("k1", "z"), (None, "n")], "k string, w string")
    want = left.join(right, ["k"])
    assert sorted(map(repr, skew.lookup_join(left, right, ["k"], most=most).select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_bad_arguments(frame):
    df = frame(rows(n=10), SCHEMA)
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "k", 0)
    with pytest.raises(ValueError):
        skew.skew_join(df, df, ["k"])
    with pytest.raises(ValueError):
        skew.skew_join(df, frame([("a",)], "k string"), ["k"], "outer")
