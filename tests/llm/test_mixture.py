import math

import numpy as np
import pytest

from kithloom.llm import mixture as X

DOCS = "doc_id long, source string, n_tokens long, copy string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(frame, many=400):
    rows = [(i, " Big ", 10, "") for i in range(10 * many)] + [(100_000 + i, "mid", 20, "") for i in range(many)] + [(200_000 + i, "small", 5, "") for i in range(many // 4)]
    rows += [(300_000, None, 9, ""), (300_001, "unlisted", 9, ""), (300_002, "mid", 0, "")]
    return frame(rows, DOCS).drop("copy")


def targets(frame, extra=()):
    return frame([("big", 0.5, 4), ("MID ", 0.4, 3), ("small", 0.1, 2), *extra], TARGETS)


def test_plan(frame):
    plan = {r.source: r for r in X.mixture_plan(docs(frame), targets(frame)).collect()}
    assert set(plan) == {"big", "mid", "small"}
    total = 40_000 + 8_000 + 500
    assert plan["big"].n_tokens == 40_000 and plan["big"].total_tokens == total and not plan["big"].is_short
    assert plan["big"].rate == pytest.approx(0.5 * total / 40_000)
    assert not plan["mid"].is_short and plan["mid"].rate == pytest.approx(0.4 * total / 8_000)
    assert plan["small"].is_short and plan["small"].rate == 2.0 and plan["small"].planned_share == pytest.approx(1000 / total)


def test_mixture_meets_its_plan(frame):
    d = docs(frame)
    plan = X.mixture_plan(d, targets(frame)).cache()
    mixed = X.replicate(d, "doc_id", plan, 3)
    copies = mixed.groupBy("source", "doc_id").count().collect()
    cap = {"big": 4, "mid": 3, "small": 2}
    assert all(r["count"] <= cap[r.source] for r in copies)
    assert sum(r["count"] for r in copies if r.source == "small") == 2 * 100  # short: every document as often as allowed
    shares = {r.source: r for r in X.reached_shares(mixed, plan).collect()}
    for source in cap:
        spread = 6 * math.sqrt(plan.where(f"source = '{source}'").first().n_docs) * 20 * 2
        want = shares[source].planned_share * 48_500
        assert abs(shares[source].reached_tokens - want) <= spread
    assert sum(r.reached_share for r in shares.values()) == pytest.approx(1)


def test_partitioning_and_order_change_nothing(frame):
    d = docs(frame, 40)
    plan = X.mixture_plan(d, targets(frame)).cache()
    a = X.shuffled(X.replicate(d, "doc_id", plan, 3), ["doc_id", "copy"], 3).collect()
    b = X.shuffled(X.replicate(d.repartition(7), "doc_id", plan, 3), ["doc_id", "copy"], 3).collect()
    assert a == b and [r.shuffle_key for r in a] == sorted(r.shuffle_key for r in a)
    other = X.replicate(d, "doc_id", plan, 4).count()
    assert {(r.doc_id, r["copy"]) for r in a} != {(r.doc_id, r["copy"]) for r in X.replicate(d, "doc_id", plan, 4).collect()} or other != len(a)


@pytest.mark.parametrize(
    "rate, cap",
    [(0.01, 1), (0.5, 1), (0.999, 1), (1.7, 2), (2.5, 100), (99.0, 100), (99.999999, 100), (900.0, 1000), (1500.0, 2000), (900.0, 2000), (10_000.0, 10_001), (10_000.0, 20_000), (9_000.0, 10**9), (1e-9, 5)],
)
def test_cut_poisson_has_the_wanted_mean(rate, cap):
    assert X._cut_mean(X.uncut_mean(rate, cap), cap) == pytest.approx(rate, rel=1e-9, abs=1e-12)
    u = (np.arange(200_000) + 0.5) / 200_000
    copies = X.draw_copies(u, rate, cap)
    assert 0 <= copies.min() and copies.max() <= cap and (np.diff(copies) >= 0).all()
    assert copies.mean() == pytest.approx(rate, rel=1e-3, abs=1e-5)


def test_probabilities_are_those_of_the_distribution():
    first, p = X._poisson(3.5, 6)
    want = [math.exp(-3.5) * 3.5**k / math.factorial(k) for k in range(6)]
    assert first == 0 and p == pytest.approx([*want, 1 - sum(want)])


def test_no_copies_and_all_copies():
    u = np.array([1e-9, 0.5, 1 - 1e-9])
    assert list(X.draw_copies(u, 0.0, 3)) == [0, 0, 0] and list(X.draw_copies(u, 3.0, 3)) == [3, 3, 3] and list(X.draw_copies(u, 0.5, 0)) == [0, 0, 0]


def test_plans_of_many_sources(frame, monkeypatch):
    d = docs(frame, 40)
    plan = X.mixture_plan(d, targets(frame)).cache()
    few = sorted(tuple(r) for r in X.replicate(d, "doc_id", plan, 3).select("doc_id", "source", "copy").collect())
    monkeypatch.setattr(X, "BROADCAST_SOURCES", 1)
    assert sorted(tuple(r) for r in X.replicate(d, "doc_id", plan, 3).select("doc_id", "source", "copy").collect()) == few


def test_null_and_repeated_keys_stay(frame):
    d = frame([(None, "big", 5, ""), (None, "big", 5, ""), (7, "big", 5, ""), (7, "big", 6, "")], DOCS).drop("copy")
    plan = X.mixture_plan(d, frame([("big", 1.0, 3)], TARGETS))
    got = X.replicate(d, "doc_id", plan.withColumn("rate", plan.max_repeats.cast("double")), 1).groupBy("doc_id", "n_tokens").count().collect()
    assert {(r.doc_id, r.n_tokens): r["count"] for r in got} == {(None, 5): 6, (7, 5): 3, (7, 6): 3}


def test_short_sources_are_those_of_the_plan(frame):
    d = docs(frame, 20)
    t = targets(frame, [("nowhere", 0.2, 5), ("none", 0.0, 1)])
    plan = X.mixture_plan(d, t).cache()
    shares = X.reached_shares(X.replicate(d, "doc_id", plan, 3), plan)
    assert {r.source for r in X.short_sources(shares).collect()} == {r.source for r in plan.where("is_short").collect()} == {"small", "nowhere"}


def test_no_tokens_no_sources_and_empty_tables(frame):
    empty = docs(frame, 1).where("doc_id < 0")
    plan = {r.source: r for r in X.mixture_plan(empty, targets(frame)).collect()}
    assert all(r.rate == 0 and not r.is_short and r.planned_share == 0 for r in plan.values())
    assert X.replicate(empty, "doc_id", X.mixture_plan(empty, targets(frame))).count() == 0
    assert X.mixture_plan(docs(frame, 1), frame([], TARGETS)).count() == 0
    absent = {r.source: r for r in X.mixture_plan(docs(frame, 4), targets(frame, [("nowhere", 0.2, 5)])).collect()}
    assert absent["nowhere"].is_short and absent["nowhere"].rate == 0


def test_targets_with_nulls_and_repeats(frame):
    t = targets(frame, [(None, 0.1, 1), ("x", None, 1), ("y", 0.1, None), ("big", 0.2, 9)])
    assert sorted(tuple(r) for r in X.clean_targets(t).collect()) == [("big", 0.5, 4), ("mid", 0.4, 3), ("small", 0.1, 2)]
