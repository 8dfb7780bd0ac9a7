import random
from collections import Counter
from itertools import combinations

import pytest

from kithloom.llm.cooccurrence import item_pairs

SCHEMA = "c string, d int, s string, n_ab string, __n int"


def data(seed=1):
    rng = random.Random(seed)
    out = []
    for r in range(60):
        size = 90 if r == 7 else rng.randrange(1, 12)
        out += [(f"r{r}", r % 3, f"i{min(rng.randrange(40), rng.randrange(40)):02}", "clash", 1) for _ in range(size)]
    return out + out[:40] + [(None, 1, "i01", "", 1), ("r1", None, "i01", "", 1), ("r1", 1, None, "", 1)]


def brute(rows, min_count, min_lift):
    held = {}
    for c, d, s, *_ in rows:
        if None not in (c, d, s):
            held.setdefault((c, d), set()).add(s)
    one, two = Counter(), Counter()
    for items in held.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    n = len(held)
    return {(a, b, one[a], one[b], k, n) for (a, b), k in two.items() if k >= min_count and k * n >= min_lift * one[a] * one[b]}


@pytest.mark.parametrize("min_count, min_lift, chunk", [(1, 0, 256), (1, 0, 3), (4, 0, 5), (2, 3, 4), (5, 8, 256), (1, 1, 2)])
def test_against_brute_force(frame, min_count, min_lift, chunk):
    rows = data()
    got = item_pairs(frame(rows, SCHEMA), ["c", "d"], "s", min_count, min_lift, chunk).collect()
    assert {tuple(r)[:6] for r in got} == brute(rows, min_count, min_lift) and len(got) == len(brute(rows, min_count, min_lift))
    for r in got:
        assert r.lift == pytest.approx(r.n_ab * r.n_records / r.n_a / r.n_b)


def test_bounds_are_exact(frame):
    # n_ab * N = 8 * n_a * n_b is a case, one record fewer is not
    rows = [(f"r{i}", 0, s, "", 1) for i in range(5) for s in "ab"] + [(f"x{i}", 0, "z", "", 1) for i in range(35)]
    assert item_pairs(frame(rows, SCHEMA), ["c", "d"], "s", 5, 8).count() == 1
    assert item_pairs(frame(rows[:-1], SCHEMA), ["c", "d"], "s", 5, 8).count() == 0


def test_one_huge_record(frame):
    rows = [("r", 0, f"i{i:04}", "", 1) for i in range(300)]
    assert item_pairs(frame(rows, SCHEMA), ["c"], "s", chunk=50).count() == 300 * 299 // 2


def test_empty_and_null(frame):
    assert item_pairs(frame([], SCHEMA), ["c", "d"], "s").count() == 0
    assert item_pairs(frame([(None, 1, None, "", 1)] * 3, SCHEMA), ["c", "d"], "s").count() == 0
    assert item_pairs(frame([("r", 1, "a", "", 1)] * 3, SCHEMA), ["c", "d"], "s").count() == 0


def test_bad_bounds(frame):
    with pytest.raises(ValueError):
        item_pairs(frame([], SCHEMA), ["c"], "s", 0)
