"""DuckDB SQL of the queries in graph_queries, built from shared common table expressions."""

from __future__ import annotations

from kithloom.plans import graph_queries as q
from kithloom.plans.scale import ID_SQL, NAME_SQL

_KNOWN = "nullif(" + ID_SQL + ", '[deleted]')"

#: Name to body; each may use those before it.
CTE = {
    "m": f"SELECT DISTINCT community, vertex FROM (SELECT {NAME_SQL.format('community')} AS community, {_KNOWN.format('__id')} AS vertex FROM vertices) WHERE community IS NOT NULL AND vertex IS NOT NULL",
    "i": f"SELECT {NAME_SQL.format('community')} AS community, {_KNOWN.format('__src_id')} AS src, {_KNOWN.format('__dst_id')} AS dst, weight, mindate, maxdate FROM edges",
    "e": f"SELECT * FROM i WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND weight >= {q.MIN_WEIGHT}",
    "g": "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e",
    "gs": "SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g",
    "nd": "SELECT src AS id, count(*) AS k FROM gs GROUP BY src",
    "sz": "SELECT community, count(*) AS size FROM m GROUP BY community",
    "dg": "SELECT vertex, count(*) AS degree FROM m GROUP BY vertex",
    "chosen": "SELECT community FROM sz WHERE md5(community) < '8'",
    "ov": "SELECT a.community AS c1, b.community AS c2, count(*) AS n FROM m a JOIN m b ON a.vertex = b.vertex AND a.community <> b.community GROUP BY 1, 2",
    "op": f"SELECT c1, c2, n FROM (SELECT *, count(*) OVER (PARTITION BY c1) AS k FROM ov WHERE c1 < c2 AND n >= {q.MIN_COMMON}) WHERE k >= {q.MIN_PAIRS}",
    "ci": "SELECT community, row_number() OVER (ORDER BY community) AS i FROM sz",
    "vi": "SELECT vertex, row_number() OVER (ORDER BY vertex) AS i FROM dg",
    "nn": "SELECT (SELECT count(*) FROM m) AS nm, (SELECT count(*) FROM sz) AS nc, (SELECT count(*) FROM dg) AS nv",
    "sl": "SELECT unnest(generate_series(1, CAST(ceil(1.5::DOUBLE * nm / (1 - nm::DOUBLE / (nc * nv))) AS BIGINT) + 100)) AS slot FROM nn",
    "dr": f"SELECT slot, ('0x' || substr(md5('{q.SEED}:c:' || slot), 1, 12))::BIGINT % nc + 1 AS x, ('0x' || substr(md5('{q.SEED}:v:' || slot), 1, 12))::BIGINT % nv + 1 AS y FROM sl, nn",
    "cand": "SELECT community, vertex, min(slot) AS slot FROM dr JOIN ci ON ci.i = x JOIN vi ON vi.i = y GROUP BY 1, 2",
    "neg": "SELECT community, vertex FROM cand ANTI JOIN m USING (community, vertex) ORDER BY slot LIMIT (SELECT nm FROM nn)",
    "s": "SELECT community, vertex, 1 AS edge_exist FROM m UNION ALL SELECT community, vertex, 0 FROM neg",
    "fd": "SELECT community, vertex, edge_exist, size - edge_exist AS d1, coalesce(degree, 0) - edge_exist AS d2 FROM s JOIN sz USING (community) LEFT JOIN dg USING (vertex)",
    "fr": "SELECT s.community, s.vertex, sum(coalesce(ov.n, 0) - CASE WHEN ov.n IS NULL THEN 0 ELSE s.edge_exist END) AS f FROM s JOIN m b ON b.vertex = s.vertex AND b.community <> s.community LEFT JOIN ov ON ov.c1 = s.community AND ov.c2 = b.community GROUP BY 1, 2",
    "ft": "SELECT fd.community, fd.vertex, edge_exist, d1, d2, CAST(coalesce(f, 0) AS BIGINT) AS f FROM fd LEFT JOIN fr ON fr.community = fd.community AND fr.vertex = fd.vertex",
    "pr": "SELECT community, vertex, edge_exist, f::DOUBLE / (f::DOUBLE + 1.0::DOUBLE + abs(d1 - d2)::DOUBLE) AS prob FROM ft",
    "pp": "SELECT * FROM pr WHERE edge_exist = 1",
    "mf": """SELECT community, avg(prob) AS a, 1 - stddev_pop(prob) AS b, median(prob) AS c, avg(CASE WHEN prob >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS d,
      1 - stddev_pop(CASE WHEN prob >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM pp GROUP BY community""",
    "mr": """SELECT community, round(a, 6) + 0.0::DOUBLE AS normality_prob_mean, round(b, 6) + 0.0::DOUBLE AS normality_prob_std, round(c, 6) + 0.0::DOUBLE AS normality_prob_median, round(d, 6) + 0.0::DOUBLE AS predicted_label_mean,
      round(e, 6) + 0.0::DOUBLE AS predicted_label_std, round(0.5::DOUBLE * (b + e - a - d), 6) + 0.0::DOUBLE AS weighted_sum FROM mf""",
    "m4": """SELECT community, round(a, 4) + 0.0::DOUBLE AS normality_prob_mean, round(b, 4) + 0.0::DOUBLE AS normality_prob_std, round(c, 4) + 0.0::DOUBLE AS normality_prob_median, round(d, 4) + 0.0::DOUBLE AS predicted_label_mean,
      round(e, 4) + 0.0::DOUBLE AS predicted_label_std, round(0.5::DOUBLE * (b + e - a - d), 4) + 0.0::DOUBLE AS weighted_sum FROM mf""",
    "lg": "SELECT feature, community, score FROM mr UNPIVOT (score FOR feature IN (normality_prob_mean, normality_prob_std, normality_prob_median, predicted_label_mean, predicted_label_std, weighted_sum))",
    "rk": "SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY score DESC, community) AS INTEGER) AS rank, community, score FROM lg",
    "l4": "SELECT feature, community, score, CASE WHEN md5(community) < '2' THEN 1 ELSE 0 END AS y FROM m4 UNPIVOT (score FOR feature IN (normality_prob_mean, normality_prob_std, normality_prob_median, predicted_label_mean, predicted_label_std, weighted_sum))",
    "ins": "SELECT a.community, g.src, g.dst FROM g JOIN m a ON a.vertex = g.src JOIN m b ON b.vertex = g.dst AND b.community = a.community",
    "ic": "SELECT community, count(*) AS internal FROM ins GROUP BY community",
    "vol": "SELECT m.community, count(*) AS n_s, coalesce(sum(k), 0)::BIGINT AS volume, count(*) FILTER (k IS NULL) AS n_missing FROM m LEFT JOIN nd ON nd.id = m.vertex GROUP BY m.community",
    "tot": "SELECT (SELECT count(*) FROM nd) AS n, (SELECT count(*) FROM g) AS e",
    "cc": "SELECT community, n_s, volume, n_missing, coalesce(internal, 0) AS internal, volume - 2 * coalesce(internal, 0) AS cut, n, e FROM vol LEFT JOIN ic USING (community), tot",
    "isd": "SELECT community, v, count(*) AS inside FROM (SELECT community, src AS v FROM ins UNION ALL SELECT community, dst FROM ins) GROUP BY 1, 2",
    "fl": "SELECT m.community, CASE WHEN count(*) FILTER (k IS NULL) > 0 THEN -1.0::DOUBLE ELSE avg(CASE WHEN 2 * coalesce(inside, 0) < k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM m LEFT JOIN nd ON nd.id = m.vertex LEFT JOIN isd ON isd.community = m.community AND isd.v = m.vertex GROUP BY m.community",
    "bd": "SELECT DISTINCT m.community, gs.dst AS vertex FROM gs JOIN m ON m.vertex = gs.src",
    "bo": "SELECT community, vertex FROM bd ANTI JOIN m USING (community, vertex)",
    "hs": "SELECT community, k, count(*) AS c FROM m JOIN nd ON nd.id = m.vertex GROUP BY 1, 2",
    "hb": "SELECT community, k, count(*) AS c FROM bo JOIN nd ON nd.id = bo.vertex GROUP BY 1, 2",
    "so": "SELECT hs.community, sum(hs.c::DOUBLE * hb.c * (1 - least(1.0::DOUBLE, hs.k::DOUBLE * hb.k / (2.0::DOUBLE * e)))) AS o FROM hs JOIN hb USING (community), tot GROUP BY 1",
    "si": "SELECT a.community, sum(a.c::DOUBLE * b.c * (1 - least(1.0::DOUBLE, a.k::DOUBLE * b.k / (2.0::DOUBLE * e)))) AS i FROM hs a JOIN hs b USING (community), tot GROUP BY 1",
    "am": """SELECT community, 2.0::DOUBLE * internal / nullif(n_s::DOUBLE * n_s + volume::DOUBLE * volume / (2.0::DOUBLE * e), 0) AS consistency,
      -coalesce(o, 0) / nullif(coalesce(i, 0) + coalesce(o, 0), 0) AS separability FROM cc LEFT JOIN so USING (community) LEFT JOIN si USING (community)""",
    "ms": """SELECT 'avg_degree' AS feature, community, 2.0::DOUBLE * internal / n_s AS score, 1 AS sg FROM cc
      UNION ALL SELECT 'cut_ratio', community, cut::DOUBLE / nullif(n_s * (n - n_s), 0), -1 FROM cc
      UNION ALL SELECT 'conductance', community, cut::DOUBLE / nullif(least(volume, 2 * e - volume), 0), -1 FROM cc
      UNION ALL SELECT 'flake_odf', community, score, -1 FROM fl
      UNION ALL SELECT 'avg_odf', community, cut::DOUBLE / n_s, -1 FROM cc
      UNION ALL SELECT 'unattr_amen', community, consistency + separability, 1 FROM am""",
    "gr": """SELECT community, day(mindate) AS network, count(DISTINCT src) AS n_src, count(*) AS n, sum(weight) AS w FROM i
      WHERE community IS NOT NULL AND mindate IS NOT NULL AND src IS NOT NULL AND weight BETWEEN 1 AND 1000 GROUP BY 1, 2""",
    "gl": """SELECT (network % 4 + 1)::DOUBLE / 20 AS p, (network // 4 % 2 + 1)::DOUBLE / 100 AS m_, CASE WHEN md5(community) < '8' THEN 'min' ELSE 'median' END AS size_group, network, algorithm, score,
      CASE WHEN substr(md5(community), 3, 1) < '4' THEN 1 ELSE 0 END AS y FROM (SELECT *, 'sources' AS algorithm, round(n_src::DOUBLE / n, 6) AS score FROM gr UNION ALL SELECT *, 'weight', round(w::DOUBLE / n, 6) FROM gr)""",
    "gp": "SELECT p, m_, size_group, network, algorithm, -score AS t, count(*) AS k, sum(y) AS pos FROM gl GROUP BY ALL",
    "gq": """SELECT p, m_, size_group, network, algorithm, pos, sum(k) OVER w AS n, sum(pos) OVER w AS np, sum(pos) OVER (PARTITION BY p, m_, size_group, network, algorithm) AS ap FROM gp
      WINDOW w AS (PARTITION BY p, m_, size_group, network, algorithm ORDER BY t DESC ROWS UNBOUNDED PRECEDING)""",
    "ga": "SELECT p, m_, size_group, network, algorithm, sum(np::DOUBLE / n * pos::DOUBLE / nullif(ap, 0)::DOUBLE) AS ap FROM gq GROUP BY ALL",
    "gm": "SELECT p, m_ AS m, size_group, algorithm, avg(ap) AS mean_ap, stddev_samp(ap) AS std_ap, count(ap) AS n_networks FROM ga GROUP BY ALL",
    "az": f"SELECT CAST(floor(quantile_cont(size, 0.5)) AS BIGINT) - {q.WIDTH // 2} AS base FROM sz",
    "ad": f"SELECT draw, base + ('0x' || substr(md5('{q.SEED}:' || draw), 1, 12))::BIGINT % {q.WIDTH + 1} AS size FROM az, (SELECT unnest(generate_series(1, {q.ANOMALOUS})) AS draw)",
    "aa": "SELECT CAST(row_number() OVER (ORDER BY size, draw) AS INTEGER) AS slot, size FROM ad",
    "pl": "SELECT slot, 'c' || lpad(slot::VARCHAR, 3, '0') AS community, size, coalesce(sum(size) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS start FROM aa",
    "em": "SELECT DISTINCT community, v AS vertex FROM (SELECT community, src AS v FROM e UNION ALL SELECT community, dst FROM e) WHERE community IS NOT NULL",
    "es": f"SELECT community, vertex FROM (SELECT *, count(*) OVER (PARTITION BY community) AS n FROM em) WHERE n BETWEEN {q.SIZE_LOW} AND {q.SIZE_HIGH}",
    "eo": f"SELECT a.community AS c1, b.community AS c2 FROM es a JOIN es b ON a.vertex = b.vertex AND a.community < b.community GROUP BY 1, 2 HAVING count(*) >= {q.MIN_COMMON}",
    "ep": f"SELECT c1, c2 FROM (SELECT *, count(*) OVER (PARTITION BY c1) AS k FROM eo) WHERE k >= {q.MIN_PAIRS}",
    "en": f"SELECT community FROM (SELECT c1 AS community FROM ep UNION SELECT c2 FROM ep) ORDER BY md5('{q.SEED}:' || community), community LIMIT {q.TRAIN}",
    "pv": "SELECT community, unnest(generate_series(start, start + size - 1)) AS v FROM pl",
}


def _with(names: str, body: str, recursive: str = "") -> str:
    """body with the tables it uses and all that these need, in their order."""
    import re

    used, todo = set(), names.split()
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo += [x for x in CTE if re.search(rf"(?:\bFROM|\bJOIN|,)\s+\(?{x}\b(?!\.)", CTE[name])]
    ctes = [f"{x} AS ({CTE[x]})" for x in CTE if x in used]
    return f"WITH RECURSIVE {', '.join(ctes)}{recursive} {body}"


def _r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0::DOUBLE AS {name}"


_PATHS = """, w(community, vertex, loc, d) USING KEY (community, vertex, loc) AS (SELECT ft.community, ft.vertex, b.community, 3 FROM ft JOIN m b ON b.vertex = ft.vertex AND b.community <> ft.community WHERE f = 0 AND d1 > 0 AND d2 > 0{0}
  UNION SELECT w.community, w.vertex, ov.c2, min(w.d) + 2 FROM w JOIN ov ON ov.c1 = w.loc AND ov.c2 <> w.community LEFT JOIN recurring.w r ON r.community = w.community AND r.vertex = w.vertex AND r.loc = ov.c2
  WHERE r.loc IS NULL GROUP BY 1, 2, 3),
sp AS (SELECT w.community, w.vertex, min(d) AS d FROM w JOIN ov ON ov.c1 = w.loc AND ov.c2 = w.community WHERE d > 3 GROUP BY 1, 2)"""
_PATH = "CASE WHEN f > 0 THEN 3 WHEN d1 = 0 OR d2 = 0 THEN -1 ELSE coalesce(d, -1) END"
_U = f"('0x' || substr(md5('{q.SEED}:' || {{0}}), 1, 12))::BIGINT"

_SHARE = f"(('0x' || substr(md5('{{0}}:' || draw || ':' || v), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"
_GROWN = f""", ch AS (SELECT community, v, w, CASE WHEN w > 1 THEN {_U.format("community || ':' || w")} % (2 * (w - 1)) END AS e FROM (SELECT community, unnest(generate_series(1, size - 1)) AS v, v AS w FROM pl)
  UNION ALL SELECT community, v, e // 2 + 1, CASE WHEN e // 2 > 0 THEN {_U.format("community || ':' || (e // 2 + 1)")} % (2 * (e // 2)) END FROM ch WHERE e % 2 = 0),
ba AS (SELECT community, start + CASE WHEN e IS NULL THEN 0 ELSE e // 2 + 1 END AS src, start + v AS dst FROM ch JOIN pl USING (community) WHERE e IS NULL OR e % 2 = 1)"""
_BETWEEN = f""", ik AS (SELECT pv.community, v, count(*) AS k FROM pv JOIN (SELECT src AS x FROM ba UNION ALL SELECT dst FROM ba) ON x = v GROUP BY 1, 2),
iw AS (SELECT community, v, k, sum(k) OVER (PARTITION BY community ORDER BY v) AS hi, sum(k) OVER (PARTITION BY community) AS total FROM ik),
iz AS (SELECT community, size, sum(size) OVER (ORDER BY community) AS hi, sum(size) OVER () AS total FROM pl),
ir AS (SELECT community, v FROM (SELECT pv.community, v, size, row_number() OVER (PARTITION BY pv.community ORDER BY {_U.format("pv.community || ':' || v")}, v) AS i FROM pv JOIN pl USING (community)) WHERE i <= round_even(size * 0.075::DOUBLE, 0)),
iu AS (SELECT v, draw, hi - size AS lo, size, floor({_SHARE.format(q.SEED + 10)} * (total - size)) AS u FROM (SELECT *, 1 AS draw FROM ir) JOIN iz USING (community)),
iv AS (SELECT v, draw, iz.community AS other FROM (SELECT v, draw, u + CASE WHEN u >= lo THEN size ELSE 0 END AS pos FROM iu) JOIN iz ON pos >= iz.hi - iz.size AND pos < iz.hi),
ix AS (SELECT v, other, floor({_SHARE.format(q.SEED + 2)} * total) AS u FROM iv JOIN (SELECT DISTINCT community, total FROM iw) t ON t.community = other)"""

ORACLE = {
    "membership_edges": _with("m", "SELECT community, vertex FROM m"),
    "bipartite_properties": _with("m", "SELECT count(DISTINCT community) AS n_communities, count(DISTINCT vertex) AS n_vertices, count(DISTINCT community) + count(DISTINCT vertex) AS n_nodes, count(*) AS n_edges FROM m"),
    "community_sizes": _with("sz", "SELECT community, size FROM sz"),
    "size_describe": _with("sz", f"SELECT count(size) AS count, sum(size)::BIGINT AS sum, min(size) AS min, max(size) AS max, {_r('avg(size)', 'mean')}, {_r('median(size)', 'median')}, {_r('quantile_cont(size, 0.75)', 'perc75')}, {_r('stddev_pop(size)', 'std')} FROM sz"),
    "distinct_users": _with("i", "SELECT community, count(DISTINCT id) AS n_users FROM (SELECT community, src AS id FROM i UNION ALL SELECT community, dst FROM i) WHERE community IS NOT NULL AND id IS NOT NULL GROUP BY community"),
    "edges_filtered": _with("e", "SELECT community, src, dst, weight FROM e"),
    "simple_graph": _with("g", "SELECT src, dst FROM g"),
    "vertex_degrees": _with("dg", "SELECT vertex, degree FROM dg"),
    "community_filter_semi": _with("m chosen", "SELECT community, vertex FROM m WHERE community IN (SELECT community FROM chosen)"),
    "community_exclude_anti": _with("m chosen", "SELECT community, vertex FROM m WHERE community NOT IN (SELECT community FROM chosen)"),
    "size_range_having": _with("sz", f"SELECT community, size FROM sz WHERE size BETWEEN {q.SIZE_LOW} AND {q.SIZE_HIGH}"),
    "community_overlap": _with("ov", "SELECT c1, c2, n FROM ov WHERE c1 < c2"),
    "overlapping_pairs": _with("op", "SELECT c1, c2, n FROM op"),
    "overlapping_names": _with("op", "SELECT c1 AS community FROM op UNION SELECT c2 FROM op"),
    "overlapping_fetch": _with("es en", "SELECT community, vertex FROM es SEMI JOIN en USING (community)"),
    "train_test_split": _with("sz", f"""SELECT community, CASE WHEN md5(community) >= '2' AND row_number() OVER (PARTITION BY md5(community) >= '2' ORDER BY md5('{q.SEED}:' || community), community) <= {q.TRAIN}
      THEN 'train' ELSE 'test' END AS split FROM sz"""),
    "induced_subgraph": _with("g m chosen", "SELECT src, dst FROM g WHERE src IN (SELECT vertex FROM m SEMI JOIN chosen USING (community)) AND dst IN (SELECT vertex FROM m SEMI JOIN chosen USING (community))"),
    "boundary_vertices": _with("bo", "SELECT community, count(*) AS n_boundary FROM bo GROUP BY community"),
    "graph_counts": _with("tot", "SELECT e AS n_edges, n AS n_nodes FROM tot"),
    "adjlist_lines": _with("g nd", "SELECT rtrim(concat_ws(' ', id, string_agg(dst, ' ' ORDER BY dst))) AS line FROM nd LEFT JOIN g ON g.src = nd.id GROUP BY id"),
    "positive_sample": _with("m", f"SELECT community, vertex, 1 AS edge_exist FROM m ORDER BY md5('{q.SEED}:' || community || ':' || vertex), community, vertex LIMIT 500"),
    "negative_sample": _with("neg", "SELECT community, vertex, 0 AS edge_exist FROM neg"),
    "preferential_attachment": _with("fd", "SELECT community, vertex, d1 * d2 AS preferential_attachment_score FROM fd WHERE edge_exist = 1"),
    "total_friends": _with("fd", "SELECT community, vertex, d1 + d2 AS total_friends FROM fd WHERE edge_exist = 1"),
    "friends_measure": _with("ft", "SELECT community, vertex, f AS friends_measure FROM ft WHERE edge_exist = 1"),
    "shortest_path": _with("ft ov", f"SELECT ft.community, ft.vertex, CAST({_PATH} AS INTEGER) AS shortest_path FROM ft LEFT JOIN sp ON sp.community = ft.community AND sp.vertex = ft.vertex WHERE edge_exist = 1", _PATHS.format(" AND edge_exist = 1")),
    "topological_features": _with("ft ov", f"""SELECT ft.community, ft.vertex, d1 + d2 AS total_friends, d1 * d2 AS preferential_attachment_score, f AS friends_measure, CAST({_PATH} AS INTEGER) AS shortest_path,
      d1 AS vertex_1_degree, d2 AS vertex_2_degree, edge_exist FROM ft LEFT JOIN sp ON sp.community = ft.community AND sp.vertex = ft.vertex""", _PATHS.format("")),
    "edge_prob_closed_form": _with("pp", "SELECT community, vertex, round(prob, 9) AS prob FROM pp"),
    "label_by_threshold": _with("pp", "SELECT community, vertex, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS label FROM pp"),
    "meta_features": _with("mr", "SELECT * EXCLUDE (weighted_sum) FROM mr"),
    "weighted_sum": _with("mr", "SELECT community, weighted_sum FROM mr"),
    "meta_feature_ranking": _with("rk", "SELECT feature, rank, community, score FROM rk"),
    "ranking_wide": _with("rk", "SELECT rank, " + ", ".join(f"max(community) FILTER (feature = '{f}') AS {f}__ranking, max(score) FILTER (feature = '{f}') AS {f}__score" for f in q.meta.META) + " FROM rk GROUP BY rank"),
    "most_anomalous_tail": _with("rk", "SELECT feature, rank, community, score FROM (SELECT *, max(rank) OVER (PARTITION BY feature) AS last FROM rk) WHERE rank > last - 3 AND feature NOT IN ('normality_prob_median', 'weighted_sum')"),
    "avg_degree": _with("cc", f"SELECT community, {_r('2.0::DOUBLE * internal / n_s', 'score')} FROM cc"),
    "cut_ratio": _with("cc", f"SELECT community, {_r('cut::DOUBLE / nullif(n_s * (n - n_s), 0)', 'score')} FROM cc"),
    "avg_odf": _with("cc", f"SELECT community, {_r('cut::DOUBLE / n_s', 'score')} FROM cc"),
    "conductance": _with("cc", f"SELECT community, {_r('cut::DOUBLE / nullif(least(volume, 2 * e - volume), 0)', 'score')} FROM cc"),
    "flake_odf": _with("fl", f"SELECT community, {_r('score', 'score')} FROM fl"),
    "amen_normality": _with("am", f"SELECT community, {_r('consistency', 'consistency')}, {_r('separability', 'separability')}, {_r('consistency + separability', 'score')} FROM am"),
    "baseline_ranking_all": _with("ms", f"SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY round(sg * score, 9) NULLS LAST, community) AS INTEGER) AS rank, community, {_r('score', 'score')} FROM ms"),
    "average_precision": _with("l4", f"""SELECT feature, {_r('sum(np::DOUBLE / n * pos::DOUBLE / ap::DOUBLE)', 'ap')} FROM (
      SELECT feature, pos, sum(k) OVER w AS n, sum(pos) OVER w AS np, sum(pos) OVER (PARTITION BY feature) AS ap FROM (SELECT feature, -score AS t, count(*) AS k, sum(y) AS pos FROM l4 GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY feature ORDER BY t DESC ROWS UNBOUNDED PRECEDING)) GROUP BY feature"""),
    "pr_curve": _with("l4", f"""SELECT feature, t + 0.0::DOUBLE AS threshold, n::BIGINT AS n, np::BIGINT AS n_pos, {_r('np::DOUBLE / n', 'precision')}, {_r('np::DOUBLE / ap', 'recall')} FROM (
      SELECT feature, t, sum(k) OVER w AS n, sum(pos) OVER w AS np, sum(pos) OVER (PARTITION BY feature) AS ap FROM (SELECT feature, score AS t, count(*) AS k, sum(y) AS pos FROM l4 GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY feature ORDER BY t DESC ROWS UNBOUNDED PRECEDING))"""),
    "confusion_metrics": _with("pr", f"""SELECT tn, fp, fn, tp, {_r('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 'prc')}, {_r('(tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0)', 'acc')}, {_r('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')},
      {_r('(tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2', 'auc')} FROM (SELECT count(*) FILTER (edge_exist = 0 AND prob < 0.1) AS tn, count(*) FILTER (edge_exist = 0 AND prob >= 0.1) AS fp,
      count(*) FILTER (edge_exist = 1 AND prob < 0.1) AS fn, count(*) FILTER (edge_exist = 1 AND prob >= 0.1) AS tp FROM pr)"""),
    "prediction_summary": _with("pp", f"SELECT count(*) FILTER (prob >= 0.5) AS predicted_exist, count(*) FILTER (prob < 0.5) AS predicted_not_exist, {_r('count(*) FILTER (prob >= 0.5)::DOUBLE / count(*)', 'exist_ratio')} FROM pp"),
    "map_by_algorithm": _with("gm", f"SELECT {_r('p', 'p')}, {_r('m', 'm')}, size_group, algorithm, {_r('mean_ap', 'mean_ap')}, {_r('std_ap', 'std_ap')}, n_networks FROM gm"),
    "meta_feature_comparison": _with("gm", f"SELECT {_r('p', 'p')}, {_r('avg(v) FILTER (algorithm = ' + chr(39) + 'sources' + chr(39) + ')', 'sources')}, {_r('avg(v) FILTER (algorithm = ' + chr(39) + 'weight' + chr(39) + ')', 'weight')} FROM (SELECT p, size_group, algorithm, avg(mean_ap) AS v FROM gm WHERE m = 0.02 GROUP BY ALL) GROUP BY p"),
    "comparison_pivot": _with("gm", f"""SELECT {_r('p', 'p')}, size_group, round(avg(mean_ap) FILTER (m = 0.01), 6) + 0.0::DOUBLE AS "0.01", round(avg(mean_ap) FILTER (m = 0.02), 6) + 0.0::DOUBLE AS "0.02" FROM gm WHERE algorithm = 'sources' GROUP BY p, size_group"""),
    "comparison_by_p": _with("gm", f"SELECT {_r('p', 'p')}, {_r('avg(v)', 'mean')} FROM (SELECT p, size_group, avg(mean_ap) AS v FROM gm WHERE algorithm = 'weight' GROUP BY ALL) GROUP BY p"),
    "comparison_by_group": _with("gm", f"SELECT size_group, {_r('avg(v)', 'mean')} FROM (SELECT size_group, m, avg(mean_ap) AS v FROM gm WHERE algorithm = 'sources' GROUP BY ALL) GROUP BY size_group"),
    "baseline_comparison": _with("gm", f"SELECT {_r('p', 'p')}, {_r('avg(mean_ap) FILTER (algorithm = ' + chr(39) + 'sources' + chr(39) + ')', 'sources')}, {_r('avg(mean_ap) FILTER (algorithm = ' + chr(39) + 'weight' + chr(39) + ')', 'weight')} FROM gm WHERE m = 0.01 AND size_group = 'min' GROUP BY p"),
    "comparison_summary": _with("gm", f"SELECT algorithm AS name, {_r('avg(v)', 'mean')}, {_r('median(v)', 'median')}, {_r('stddev_samp(v)', 'std')} FROM (SELECT p, m, size_group, algorithm, avg(mean_ap) AS v FROM gm GROUP BY ALL) GROUP BY algorithm"),
    "anomalous_sizes": _with("aa", "SELECT slot, size FROM aa"),
    "bootstrap_sizes": _with("sz", f"""SELECT slot, size FROM (SELECT slot, {_U.format('slot')} % (SELECT count(*) FROM sz) + 1 AS i FROM (SELECT unnest(generate_series(1, {q.DRAWS})) AS slot))
      JOIN (SELECT size, row_number() OVER (ORDER BY size, community) AS i FROM sz) USING (i)"""),
    "weighted_pick": _with("sz", f"""SELECT draw, community FROM (SELECT draw, ({_U.format('draw')}::DOUBLE + 0.5) / 281474976710656.0::DOUBLE * (SELECT sum(size)::DOUBLE FROM sz) AS u FROM (SELECT unnest(generate_series(1, 1000)) AS draw))
      JOIN (SELECT community, size::DOUBLE AS w, sum(size::DOUBLE) OVER (ORDER BY community ROWS UNBOUNDED PRECEDING) AS hi FROM sz) ON u >= hi - w AND u < hi"""),
    "er_community_edges": _with("pv", f"""SELECT a.community, a.v AS src, b.v AS dst FROM pv a JOIN pv b ON a.community = b.community AND a.v < b.v
      WHERE ({_U.format("a.community || ':' || a.v || ':' || b.v")}::DOUBLE + 0.5) / 281474976710656.0::DOUBLE < {q.ER_P}"""),
    "ba_community_edges": _with("pl", "SELECT community, src, dst FROM ba", _GROWN),
    "inter_community_edges": _with("pl pv", "SELECT ix.v AS src, iw.v AS dst FROM ix JOIN iw ON iw.community = ix.other AND u >= hi - k AND u < hi", _GROWN + _BETWEEN),
    "edge_key_roundtrip": _with("m", "SELECT '(' || community || ', ' || vertex || ')' AS key, split_part(community || ', ' || vertex, ', ', 1) AS community_head, substr(community || ', ' || vertex, length(split_part(community || ', ' || vertex, ', ', 1)) + 3) AS vertex_rest FROM m"),
}
