"""Queries over the sources and sinks: each writes whole tables in a format below the shared folder, reads them back, and has the SQL of what was written.

Beside them: evaluation of real rankings, and what generated networks and a learnt ranking must keep whatever is drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithloom.operators import evaluation, features, generators, graph, measures, membership, meta, sampling
from kithloom.plans import graph_queries as q, graph_sql
from kithloom.plans.detector import detect
from kithloom.session import cut, fresh_dir, keep, keep_result, kept_folders, remove_kept
from kithloom.sources import readers as R, writers as W


def partition_map_roundtrip(spark, d):
    """JSON objects of members by community, in lines."""
    path = fresh_dir(spark, "map")
    W.write_partition_map(cut(q.members(spark, d)), path, lines=True)
    return R.read_partition_map(spark, path, lines=True)


def size_list_roundtrip(spark, d):
    """JSON arrays of sizes; how often each size occurs."""
    path = fresh_dir(spark, "sizes")
    W.write_size_list(membership.sizes(q.members(spark, d)), path, lines=True)
    return R.read_size_list(spark, path, lines=True).groupBy("size").agg(F.count("*").alias("n"))


def size_map_roundtrip(spark, d):
    """Sizes by community; every community of edges is asked for, and unknown where vertices list none of its members."""
    path = fresh_dir(spark, "sizes")
    W.write_sizes(membership.sizes(q.members(spark, d)), path, lines=True)
    asked = q.interactions(spark, d).where("community IS NOT NULL").select("community")
    return R.sizes_of_names(asked, R.read_size_map(spark, path, lines=True))


def edges_csv_roundtrip(spark, d):
    """Interactions as CSV in a folder for each community."""
    path = fresh_dir(spark, "edges")
    W.write_edges(q.interactions(spark, d), path)
    return R.read_edges(spark, path, partitioned=True).select("community", "src", "dst", F.col("weight").cast("string").alias("weight"), F.to_timestamp_ntz("mindate").alias("mindate"), F.to_timestamp_ntz("maxdate").alias("maxdate"))


def vertices_csv_roundtrip(spark, d):
    """Members as CSV in a folder for each community."""
    path = fresh_dir(spark, "vertices")
    W.write_vertices(q.members(spark, d), path)
    return R.read_vertices(spark, path, partitioned=True)


def adjacency_roundtrip(spark, d):
    """The simple graph as adjacency lines."""
    path, g = fresh_dir(spark, "adjacency"), cut(q.simple(spark, d))
    W.write_adjacency(g, graph.nodes_of(g), path)
    return R.read_adjacency(spark, path)[0]


def bipartite_roundtrip(spark, d):
    """K2: links as CSV under other labels."""
    path = fresh_dir(spark, "bipartite")
    W.write_bipartite(q.members(spark, d), path, "page", "editor")
    return spark.read.schema("page string, editor string").options(header=True, escape='"').csv(path)


def _features(spark, d) -> DataFrame:
    codes = q.coded_members(spark, d)
    found = keep_result(spark, lambda: features.topological_features(codes.links), "features")
    remove_kept(spark, codes.links)
    return codes.decode(found)


def features_roundtrip(spark, d):
    """Features of half of the communities as train, of the rest as test."""
    path = fresh_dir(spark, "features")
    with kept_folders(spark):
        rows = keep_result(spark, lambda: _features(spark, d), "features")
        half = F.md5("community") < "8"
        W.write_features(rows.where(half), rows.where(~half), path)
    train, test = R.read_features(spark, path)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def feature_csv_roundtrip(spark, d):
    """Features as CSV under keys of community and vertex; a community that holds the separator is cut at it."""
    path = fresh_dir(spark, "features")
    with kept_folders(spark):
        W.write_feature_csv(_features(spark, d), path, compression="gzip")
    return R.read_feature_csv(spark, path)


def results_roundtrip(spark, d):
    """Our wide ranking and the baselines' as result files of one experiment."""
    path = fresh_dir(spark, "results")
    W.write_result_csv(q.ranking_wide(spark, d), f"{path}/OurResults_0.csv")
    W.write_result_csv(meta.ranking_wide(q.baseline_ranking_all(spark, d), measures.MEASURES), f"{path}/BaselineResults_0.csv")
    return R.read_results(spark, path, "OurResults", meta.META).unionByName(R.read_results(spark, path, "BaselineResults", measures.MEASURES))


def log_roundtrip(spark, d):
    """An experiment's log; sizes by kind, and numbers of members by part."""
    path, m = fresh_dir(spark, "logs"), cut(q.members(spark, d))
    known = membership.sizes(m).withColumn("is_anomalous", F.md5("community") < "2")
    train = m.join(q._chosen(m), "community", "left_semi")
    W.write_log(f"{path}/NetworkLog_3.json", 3, known, train, m.join(q._chosen(m), "community", "left_anti"))
    logs = R.read_logs(spark, path, lines=True)
    kind = F.when(F.col("is_anomalous"), "anomalous").otherwise("normal")
    sizes = R.log_sizes(logs).groupBy("enumeration", kind.alias("what")).agg(F.count("*").alias("n_communities"), F.sum("size").alias("n_members"))
    parts = R.log_members(logs).groupBy("enumeration", F.col("split").alias("what")).agg(F.count_distinct("community").alias("n_communities"), F.count("*").alias("n_members"))
    return sizes.unionByName(parts)


def ranking_roundtrip(spark, d):
    """A saved ranking, by average degree."""
    path = W.write_ranking(q.baseline_ranking_all(spark, d).where("feature = 'avg_degree'"), fresh_dir(spark, "ranking"), lines=True, with_time=True)
    return R.read_ranking(spark, path, lines=True)


def config_roundtrip(spark, d):
    """K5: a generator's settings."""
    path = fresh_dir(spark, "config")
    W.write_config(spark, {"generator": sampling.anomalous_sizes, "p": 0.05, "k": [1, 1]}, path)
    return spark.read.schema("generator string, p double, k array<int>").json(path).select("generator", "p", F.col("k")[0].alias("k_low"), F.col("k")[1].alias("k_high"))


def file_triples(spark, d):
    """The three files of each network among the files of an experiment."""
    path, m = fresh_dir(spark, "files"), cut(q.members(spark, d).where("md5(community) < '08'"))
    for name in ("Net_02", "Net_10"):
        for part in ("train", "test"):
            W.write_partition_map(m, f"{path}/maps/{name}_{part}_partition.json", lines=True)
        W.write_partition_map(m, f"{path}/nets/{name}_network.adjlist", lines=True)
    W.write_partition_map(m, f"{path}/maps/Lone_train_partition.json", lines=True)
    W.write_partition_map(m, f"{path}/maps/Raw_data/Net_10_test_partition.json", lines=True)
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias(c)
    return R.file_triples(spark, f"{path}/maps", f"{path}/nets").select("enumeration", "stem", name("train"), name("test"), name("network"))


# --- evaluation of real rankings ------------------------------------------------------------------------------------------


def _real_scores(spark, d) -> DataFrame:
    """Our scores and the baselines' of every community, by size group, with made-up anomalies."""
    m = keep(q.members(spark, d))
    ours = keep_result(spark, lambda: meta.rank_features(q.scores(spark, d, 4)), "ours")
    baselines = keep_result(spark, lambda: measures.rank_measures(keep(q.simple(spark, d), "graph"), m), "baselines")
    scores = ours.unionByName(q._rounded(baselines, 4))
    marked = evaluation.label_anomalous(scores, q._anomalous(m).where("is_anomalous").select("community"))
    group = F.when(F.substring(F.md5("community"), 2, 1) < "8", "min").otherwise("median")
    return marked.select(group.alias("size_group"), F.lit(0).alias("network"), F.col("feature").alias("algorithm"), "community", "score", "is_anomalous")


def _real_precision(spark, d) -> DataFrame:
    return evaluation.precision_by_setting(_real_scores(spark, d), ["size_group", "algorithm"], higher_is_anomalous=evaluation.high_is_anomalous(F.col("algorithm")))


def map_real_scores(spark, d):
    """A17 over real rankings: every meta-feature and baseline judged from its own end."""
    return q._rounded(_real_precision(spark, d))


def baseline_comparison_real(spark, d):
    """A22 over real rankings: the meta-feature of the comparison beside the baselines."""
    return q._rounded(evaluation.compare(_real_precision(spark, d), ["size_group"], "algorithm", ["normality_prob_std", *measures.MEASURES]))


def comparison_p_by_m(spark, d):
    """P by m for each size group."""
    chosen = q._by_setting(spark, d).where("algorithm = 'weight'")
    return q._rounded(evaluation.compare(chosen, ["size_group", "p"], "m", ["0.01", "0.02"]))


# --- what draws and learning must keep, whatever they draw ----------------------------------------------------------------


def er_density(spark, d):
    """Of each community's pairs about a part ER_P are edges, within six standard deviations, all inside it and in order."""
    placed = cut(q._placed(spark, d))
    found = generators.er_edges(placed, q.ER_P, q.SEED).join(placed.select("community", "start", "size"), "community")
    fits = (F.col("src") >= F.col("start")) & (F.col("src") < F.col("dst")) & (F.col("dst") < F.col("start") + F.col("size"))
    per = found.groupBy("community").agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("n_distinct"), F.bool_and(fits).alias("fits"))
    joined = placed.join(per, "community", "left").fillna(0, ["n", "n_distinct"])
    pairs = F.col("size") * (F.col("size") - 1) / 2
    close = F.abs(F.col("n") - q.ER_P * pairs) <= 6 * F.sqrt(pairs * q.ER_P * (1 - q.ER_P)) + 1
    return joined.select("community", pairs.cast("long").alias("n_pairs"), (close & F.coalesce("fits", F.lit(True)) & (F.col("n") == F.col("n_distinct"))).alias("as_expected"))


def infused_counts(spark, d):
    """All edges of the real graph stay, every new node is there, and the stated part of each new community reaches out."""
    real = keep(q.simple(spark, d))
    net = generators.infuse(real, keep(q.members(spark, d)), q.anomalous_sizes(spark, d), q.ER_P, 0.2, (1, 2), q.SEED)
    edges = keep(net.edges)
    kept = edges.join(real, ["src", "dst"], "left_semi").agg(F.count("*").alias("n_edges_kept"))
    nodes = net.nodes.agg(F.count_if(F.col("id").startswith("GenNode")).alias("n")).scalar()
    first, second = F.col("src").startswith("GenNode"), F.col("dst").startswith("GenNode")
    out = edges.where(first != second).agg(F.count_distinct(F.when(first, F.col("src")).otherwise(F.col("dst"))).alias("n")).scalar()
    infused = net.membership.where(generators.is_infused(F.col("community"))).agg(F.count_distinct("community").alias("n")).scalar()
    return kept.select("n_edges_kept", nodes.alias("n_new_nodes"), out.alias("n_reaching_out"), infused.alias("n_communities"))


def detection_ranks(spark, d):
    """Every meta-feature ranks all test communities, each once."""
    train, test = q._halves(spark, d)
    ranking = detect(train, test, seed=q.SEED).ranking
    return ranking.groupBy("feature").agg(F.count_distinct("community").alias("n_communities"), F.max("rank").cast("long").alias("last"), F.count("score").alias("n_scores"))


QUERIES = {
    f.__name__: f
    for f in (
        er_density, infused_counts, detection_ranks,
        partition_map_roundtrip, size_list_roundtrip, size_map_roundtrip, edges_csv_roundtrip, vertices_csv_roundtrip, adjacency_roundtrip, bipartite_roundtrip, features_roundtrip,
        feature_csv_roundtrip, results_roundtrip, log_roundtrip, ranking_roundtrip, config_roundtrip, file_triples, map_real_scores, baseline_comparison_real, comparison_p_by_m,
    )
}

_w, _r = graph_sql._with, graph_sql._r
_FEATURES = graph_sql.ORACLE["topological_features"] + " WHERE edge_exist = 1"
_HIGH = "algorithm IN ('cut_ratio', 'conductance', 'flake_odf', 'avg_odf')"
_AP = f""", rs AS (SELECT feature AS algorithm, community, score FROM m4 UNPIVOT (score FOR feature IN ({', '.join(meta.META)})) UNION ALL SELECT feature, community, round(score, 4) + 0.0::DOUBLE FROM ms),
rt AS (SELECT CASE WHEN substr(md5(community), 2, 1) < '8' THEN 'min' ELSE 'median' END AS size_group, algorithm, CASE WHEN {_HIGH} THEN score ELSE -score END AS t, CASE WHEN md5(community) < '2' THEN 1 ELSE 0 END AS y FROM rs),
ru AS (SELECT size_group, algorithm, t, count(*) AS k, sum(y) AS pos FROM rt GROUP BY ALL),
rv AS (SELECT size_group, algorithm, pos, sum(k) OVER w AS n, sum(pos) OVER w AS np, sum(pos) OVER (PARTITION BY size_group, algorithm) AS ap FROM ru WINDOW w AS (PARTITION BY size_group, algorithm ORDER BY t DESC NULLS LAST ROWS UNBOUNDED PRECEDING)),
rw AS (SELECT size_group, algorithm, sum(np::DOUBLE / n * pos::DOUBLE / nullif(ap, 0)::DOUBLE) AS ap FROM rv GROUP BY ALL)"""


def _baseline_rank(where: str = "TRUE") -> str:
    return f"SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY round(sg * score, 9) NULLS LAST, community) AS INTEGER) AS rank, community, {_r('score', 'score')} FROM ms WHERE {where}"


ORACLE = {
    "er_density": _w("pl", "SELECT community, CAST(size * (size - 1) / 2 AS BIGINT) AS n_pairs, TRUE AS as_expected FROM pl"),
    "infused_counts": _w("g pl", "SELECT (SELECT count(*) FROM g) AS n_edges_kept, sum(size)::BIGINT AS n_new_nodes, sum(floor(size * 0.2::DOUBLE))::BIGINT AS n_reaching_out, count(*) AS n_communities FROM pl"),
    "detection_ranks": _w("sz", "SELECT feature, n AS n_communities, n AS last, n AS n_scores FROM (SELECT count(*) AS n FROM sz WHERE md5(community) >= '8'), (SELECT unnest([" + ", ".join(f"'{f}'" for f in meta.META) + "]) AS feature)"),
    "partition_map_roundtrip": _w("m", "SELECT community, vertex FROM m"),
    "size_list_roundtrip": _w("sz", "SELECT size, count(*) AS n FROM sz GROUP BY size"),
    "size_map_roundtrip": _w("sz i", "SELECT community, size FROM (SELECT DISTINCT community FROM i WHERE community IS NOT NULL) LEFT JOIN sz USING (community)"),
    "edges_csv_roundtrip": _w("i", "SELECT community, src, dst, weight::VARCHAR AS weight, mindate, maxdate FROM i WHERE community IS NOT NULL"),
    "vertices_csv_roundtrip": _w("m", "SELECT community, vertex FROM m"),
    "adjacency_roundtrip": _w("g", "SELECT src, dst FROM g"),
    "bipartite_roundtrip": _w("m", "SELECT community AS page, vertex AS editor FROM m"),
    "features_roundtrip": f"SELECT *, CASE WHEN md5(community) < '8' THEN 'train' ELSE 'test' END AS split FROM ({_FEATURES})",
    "feature_csv_roundtrip": f"""SELECT * REPLACE (split_part(community, ', ', 1) AS community, substr(community || ', ' || vertex, length(split_part(community, ', ', 1)) + 3) AS vertex) FROM ({_FEATURES})""",
    "results_roundtrip": _w("rk ms", f"SELECT 'OurResults_0' AS experiment, * FROM rk UNION ALL SELECT 'BaselineResults_0', * FROM ({_baseline_rank()})"),
    "log_roundtrip": _w("sz", """SELECT 3 AS enumeration, what, count(*) AS n_communities, sum(size)::BIGINT AS n_members FROM (
      SELECT CASE WHEN md5(community) < '2' THEN 'anomalous' ELSE 'normal' END AS what, size FROM sz UNION ALL SELECT CASE WHEN md5(community) < '8' THEN 'train' ELSE 'test' END, size FROM sz) GROUP BY what"""),
    "ranking_roundtrip": _w("ms", "SELECT rank, community, score FROM (" + _baseline_rank("feature = 'avg_degree'") + ")"),
    "config_roundtrip": "SELECT 'anomalous_sizes' AS generator, 0.05::DOUBLE AS p, 1 AS k_low, 1 AS k_high",
    "file_triples": """SELECT CAST(i AS INTEGER) AS enumeration, s AS stem, s || '_train_partition.json' AS train, s || '_test_partition.json' AS test, s || '_network.adjlist' AS network
      FROM (VALUES (0, 'Net_02'), (1, 'Net_10')) t(i, s)""",
    "map_real_scores": _w("m4 ms", f"SELECT size_group, algorithm, {_r('ap', 'mean_ap')}, NULL::DOUBLE AS std_ap, CASE WHEN ap IS NULL THEN 0 ELSE 1 END::BIGINT AS n_networks FROM rw", _AP),
    "baseline_comparison_real": _w("m4 ms", "SELECT size_group, " + ", ".join(f"round(max(ap) FILTER (algorithm = '{a}'), 6) + 0.0::DOUBLE AS {a}" for a in ("normality_prob_std", *measures.MEASURES)) + " FROM rw GROUP BY size_group", _AP),
    "comparison_p_by_m": _w("gm", f"""SELECT size_group, {_r('p', 'p')}, round(avg(mean_ap) FILTER (m = 0.01), 6) + 0.0::DOUBLE AS "0.01", round(avg(mean_ap) FILTER (m = 0.02), 6) + 0.0::DOUBLE AS "0.02" FROM gm WHERE algorithm = 'weight' GROUP BY p, size_group"""),
}
