import random

import pytest
from pyspark.sql import functions as F

from kithloom.llm import overlap as O

SCHEMA = "g string, x string, n string"


def sets(seed=1):
    """Sets of very different sizes with shared parts of all kinds, and a few members that are everywhere."""
    rng = random.Random(seed)
    out = {"huge": {f"h{i}" for i in range(6000)}, "large": {f"h{i}" for i in range(5000, 7000)}}
    for i in range(60):
        own = {f"m{i}_{j}" for j in range(rng.randrange(40, 400))}
        taken = rng.random() * 1.2
        source = rng.choice(sorted(out))
        k = min(len(out[source]), int(taken * len(own)))
        out[f"s{i}"] = own | set(rng.sample(sorted(out[source]), k)) | {f"bot{b}" for b in range(12)}
    return out


def rows_of(data):
    return [(g, x, "clash") for g, xs in data.items() for x in xs] + [(None, "a", ""), ("huge", None, ""), ("huge", "h1", "")]


def true_pairs(data, shared, part):
    names = sorted(data)
    out = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = len(data[a] & data[b])
            if n >= shared and n >= part * min(len(data[a]), len(data[b])):
                out[a, b] = n
    return out


@pytest.mark.parametrize("k, hot", [(512, 64), (128, 64), (128, 5), (1000, 2)])
def test_no_true_pair_is_missed(frame, k, hot):
    data = sets()
    members = O.set_members(frame(rows_of(data), SCHEMA), "g", "x")
    pairs = O.overlapping_pairs(members, 30, 0.25, k, hot)
    exact = O.exact_shared(members, pairs)
    got = {tuple(sorted((r.small, r.large))): r.n_shared for r in exact.collect() if r.n_shared >= 30 and r.n_shared * 4 >= r.n_small}
    assert got == true_pairs(data, 30, 0.25)


def test_sets_of_hot_members_only(frame):
    # all sets share the same 40 members: each is hot, and there are more of them than the margin allows to leave out
    data = {f"s{i:02}": {f"bot{b}" for b in range(40)} | {f"o{i}_{j}" for j in range(20)} for i in range(25)}
    members = O.set_members(frame(rows_of(data)[:-3], SCHEMA), "g", "x")
    assert O.overlapping_pairs(members, 30, 0.25, 512, 5).count() == 25 * 24 // 2


def test_whole_sketches_are_exact(frame):
    data = {"a": {f"x{i}" for i in range(100)}, "b": {f"x{i}" for i in range(60, 200)}}
    members = O.set_members(frame(rows_of(data)[:-3], SCHEMA), "g", "x")
    r = O.overlapping_pairs(members, 30, 0.25).first()
    assert (r.small, r.large, r.n_small, r.n_large, r.union_est, r.fraction_est, r.shared_est) == ("a", "b", 100, 140, 200.0, 0.2, 40.0)


def test_estimates_of_given_pairs(frame):
    # 30 pairs of sets of 3000 and 4500 items that share 1500: the union's standard error is 4.4 percent, that of the shared fraction 8.9
    data = {}
    for i in range(30):
        data |= {f"a{i}": {f"p{i}_{j}" for j in range(3000)}, f"b{i}": {f"p{i}_{j}" for j in range(1500, 6000)}}
    data["tiny"] = {f"p0_{j}" for j in range(1600)} - {f"p0_{j}" for j in range(1490)}
    members = O.set_members(frame(rows_of(data)[:-3], SCHEMA), "g", "x").cache()
    asked = [(f"a{i}", f"b{i}") for i in range(30)] + [("a0", "b0"), ("a0", "b1"), ("tiny", "nowhere"), ("a0", None)]
    got = {(r.a, r.b): r for r in O.estimate_pairs(members, frame(asked, "a string, b string")).collect()}
    assert len(got) == 32
    union = [got[f"a{i}", f"b{i}"].union_est / 6000 - 1 for i in range(30)]
    shared = [got[f"a{i}", f"b{i}"].fraction_est / 0.25 - 1 for i in range(30)]
    for errors, one in ((union, 0.0443), (shared, 0.0766)):
        assert max(map(abs, errors)) < 5 * one and (sum(e * e for e in errors) / 30) ** 0.5 < 1.5 * one and abs(sum(errors) / 30) < 4 * one / 30**0.5
    assert got["a0", "b1"].shared_est == 0 and (got["tiny", "nowhere"].n_b, got["tiny", "nowhere"].shared_est, got["tiny", "nowhere"].union_est) == (0, 0.0, 110.0)


@pytest.mark.parametrize("k, hot", [(512, 64), (128, 5), (64, 2)])
def test_what_sketches_are_sure_of_is_true(frame, k, hot):
    data = sets(3)
    members = O.set_members(frame(rows_of(data), SCHEMA), "g", "x")
    sure = {tuple(sorted((r.small, r.large))) for r in O.overlapping_pairs(members, 30, 0.25, k, hot).where("surely").collect()}
    assert sure and sure <= set(true_pairs(data, 30, 0.25))


def test_bounds_hold_the_true_size(frame):
    data = {"a": {f"x{i}" for i in range(4000)}, "b": {f"x{i}" for i in range(2000, 8000)}, "c": {f"x{i}" for i in range(100)}, "d": {f"x{i}" for i in range(60, 200)}}
    members = O.set_members(frame(rows_of(data)[:-3], SCHEMA), "g", "x").cache()
    got = O.estimate_pairs(members, frame([("a", "b"), ("c", "d"), ("a", "c")], "a string, b string"))
    low, high = O.shared_bounds(F.col("fraction_est"), F.col("n_a"), F.col("n_b"))
    want = {("a", "b"): 2000, ("c", "d"): 40, ("a", "c"): 100}
    for r in got.select("a", "b", low.alias("low"), high.alias("high")).collect():
        assert r.low - 1e-3 <= want[r.a, r.b] <= r.high + 1e-3


def test_bottom_k_keeps_the_smallest(frame):
    members = O.set_members(frame([("a", str(i), "") for i in range(500)] + [("b", "1", "")], SCHEMA), "g", "x")
    got = sorted(r.h for r in O.bottom_k(members, 20).where("g = 'a'").collect())
    assert got == sorted(r.h for r in members.where("g = 'a'").select(F.xxhash64("x").alias("h")).collect())[:20]


def test_ties_empty_and_equal_sets(frame):
    empty = O.set_members(frame([], SCHEMA), "g", "x")
    assert O.overlapping_pairs(empty, 1, 0.5).count() == 0
    twins = O.set_members(frame([(g, str(i), "") for g in "ab" for i in range(40)], SCHEMA), "g", "x")
    r = O.exact_shared(twins, O.overlapping_pairs(twins, 30, 1.0)).collect()
    assert [(x.small, x.large, x.n_shared) for x in r] == [("a", "b", 40)]
    with pytest.raises(ValueError):
        O.overlapping_pairs(twins, 0, 0.5)


def test_all_pairs_have_their_exact_size(frame):
    # 29 shared members, a fifth of the smaller set, and one shared member: below the bounds of p4_found
    data = {"a": {f"x{i}" for i in range(29)}, "b": {f"x{i}" for i in range(200)}, "c": {f"x{i}" for i in range(160, 360)}, "d": {"x359", "y"}, "e": {"z"}}
    members = O.set_members(frame(rows_of(data)[:-3], SCHEMA), "g", "x")
    assert {tuple(r) for r in O.all_shared(members).collect()} == {("a", "b", 29, 200, 29), ("b", "c", 200, 200, 40), ("c", "d", 200, 2, 1)}


@pytest.mark.parametrize("hot, block", [(1, 7), (3, 256), (64, 256)])
def test_all_pairs_with_hot_members(frame, hot, block):
    data = sets(2)
    members = O.set_members(frame(rows_of(data), SCHEMA), "g", "x")
    got = O.all_shared(members, hot, block).collect()
    assert {(r.a, r.b): r.n_shared for r in got} == true_pairs(data, 1, 0) and len(got) == len(true_pairs(data, 1, 0))
    assert all((r.n_a, r.n_b) == (len(data[r.a]), len(data[r.b])) for r in got)
