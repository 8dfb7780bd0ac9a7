import random

from kithloom.operators import order as O


def test_ranks_within_groups(frame):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(20), i) for i in range(300)]
    got = O.ranked(frame(rows, "g string, v int, i int", 7), ["g"], ["v", "i"]).collect()
    want = {r: n for g in "abc" for n, r in enumerate(sorted(x for x in rows if x[0] == g), 1)}
    assert {(r.g, r.v, r.i): r["rank"] for r in got} == want and len(got) == 300
    assert O.ranked(frame([], "g string, v int", 1), ["g"], ["v"]).count() == 0


def test_running_totals(frame):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(200)]
    df = frame(rows, "g string, i int, w long", 5)
    got = {r.i: r.hi for r in O.running_total(df, ["i"], "w").collect()}
    assert got == {i: sum(w for _, j, w in rows if j <= i) for _, i, _ in rows}
    by = {r.i: r.hi for r in O.running_total(df, ["i"], "w", group=["g"]).collect()}
    assert by == {i: sum(w for h, j, w in rows if j <= i and h == g) for g, i, _ in rows}
    assert O.running_total(frame([], "i int, w long", 1), ["i"], "w").count() == 0
