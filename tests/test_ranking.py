import pytest

from kithloom.operators import evaluation as E, meta as M


def test_meta_features(frame):
    probs = [("X", 0.9), ("X", 0.8), ("X", 0.5), ("Y", 0.4), ("Y", 0.6), ("Z", 0.7)]
    got = {r.community: tuple(round(r[c], 6) for c in M.META) for r in M.meta_features(frame([(c, str(i), p) for i, (c, p) in enumerate(probs)], "community string, vertex string, prob double")).collect()}
    assert got == {
        "X": (0.733333, 0.830033, 0.8, 1.0, 1.0, 0.04835),
        "Y": (0.5, 0.9, 0.5, 0.5, 0.5, 0.2),
        "Z": (0.7, 1.0, 0.7, 1.0, 1.0, 0.15),
    }


def test_ranking_ties_and_tail(frame):
    s = frame([("b", 1.0, 5.0), ("a", 1.0, None), ("c", 2.0, 1.0)], "community string, normality_prob_mean double, weighted_sum double")
    ranked = M.rank_features(s, ("normality_prob_mean", "weighted_sum"))
    by = {(r.feature, r.rank): r.community for r in ranked.collect()}
    assert [by["normality_prob_mean", i] for i in (1, 2, 3)] == ["c", "a", "b"]
    assert [by["weighted_sum", i] for i in (1, 2, 3)] == ["b", "c", "a"]
    wide = {r["rank"]: r for r in M.ranking_wide(ranked, ("normality_prob_mean", "weighted_sum")).collect()}
    assert wide[1]["normality_prob_mean__ranking"] == "c" and wide[1]["weighted_sum__score"] == 5.0
    assert {(r.feature, r.community) for r in M.most_anomalous(ranked, 2).collect()} == {("normality_prob_mean", "a"), ("normality_prob_mean", "b")}


AP = [("a", 0.9, 0), ("b", 0.8, 0), ("c", 0.3, 1), ("d", 0.3, 0), ("e", 0.2, 1), ("f", 0.95, 1)]


@pytest.mark.parametrize("high, want", [(False, 0.722222), (True, 0.633333)])
def test_average_precision(frame, high, want):
    r = frame([("k", *x) for x in AP], "feature string, community string, score double, is_anomalous int")
    assert round(E.average_precision(r, ["feature"], high).first().ap, 6) == want


def test_average_precision_without_anomalies(frame):
    r = frame([("k", "a", 1.0, 0)], "feature string, community string, score double, is_anomalous int")
    assert E.average_precision(r, ["feature"]).first().ap is None


def test_scores_with_one_class(frame):
    labels = frame([(1, 1), (1, 1), (1, 0)], "edge_exist int, predicted int")
    r = E.classification_scores(labels, "edge_exist", "predicted").first()
    assert (r.tn, r.fp, r.fn, r.tp, r.prc, round(r.acc, 6), round(r.f1, 6), r.auc) == (0, 0, 1, 2, 1.0, 0.666667, 0.8, None)
    s = E.prediction_summary(labels, "predicted").first()
    assert (s.predicted_exist, s.predicted_not_exist, round(s.exist_ratio, 6)) == (2, 1, 0.666667)


def test_comparisons(frame):
    rows = [(0.05, "min", "x", 0.2), (0.05, "min", "x", 0.4), (0.05, "max", "x", 0.6), (0.1, "min", "y", 1.0)]
    s = frame(rows, "p double, size_group string, algorithm string, mean_ap double")
    assert {r.p: r["mean"] for r in E.mean_of_means(s, ["p"], ["size_group"]).collect()} == {0.05: pytest.approx(0.45), 0.1: 1.0}
    assert {r.p: (r.x, r.y) for r in E.compare(s, ["p"], "algorithm", ["x", "y"]).collect()} == {0.05: (pytest.approx(0.4), None), 0.1: (None, 1.0)}
