"""Queries over memberships (vertices) and interactions (edges), each with its SQL.

The membership network is vertices in canonical spelling; the graph joins two accounts with an interaction of weight 3 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithloom.functions.canonical import canonical_name, known_account
from kithloom.functions.hashing import key_of
from kithloom.functions.text import edge_key, parse_edge_key
from kithloom.operators import evaluation, features, generators, graph, membership, meta, measures, sampling
from kithloom.operators.codes import Codes, coded
from kithloom.operators.linkpred import fit_links
from kithloom.plans.detector import detect, labelled_features
from kithloom.session import cut, keep, keep_result, remove_kept

MIN_WEIGHT, SEED = 3, 11
MIN_COMMON, MIN_PAIRS = 3, 3
SIZE_LOW, SIZE_HIGH = 30, 1500
TRAIN, DRAWS, ANOMALOUS, WIDTH, ER_P = 20, 110, 10, 16, 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vertices")
    return membership.bipartite(rows.select(canonical_name("community").alias("community"), known_account("__id").alias("vertex")))


def coded_members(spark: SparkSession, sf_dir: str) -> Codes:
    m = keep(members(spark, sf_dir))
    codes = coded(m)
    remove_kept(spark, m)
    return codes


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges").select(
        canonical_name("community").alias("community"), known_account("__src_id").alias("src"), known_account("__dst_id").alias("dst"), "weight", "mindate", "maxdate"
    )


def simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_graph(graph.clean_edges(interactions(spark, sf_dir), MIN_WEIGHT))


def _chosen(m: DataFrame) -> DataFrame:
    """About half of the communities, by hash."""
    return m.select("community").distinct().where(F.md5("community") < "8")


def _anomalous(m: DataFrame) -> DataFrame:
    return m.select("community").distinct().withColumn("is_anomalous", F.md5("community") < "2")


def _sample(codes: Codes) -> DataFrame:
    """All links and as many non-links, as numbers."""
    return sampling.positive_sample(codes.links).unionByName(sampling.negative_codes(codes, codes.links.count(), SEED))


# --- membership -----------------------------------------------------------------------------------------------------------


def membership_edges(spark, d):
    return members(spark, d)


def bipartite_properties(spark, d):
    return membership.properties(members(spark, d))


def community_sizes(spark, d):
    return membership.sizes(members(spark, d))


def size_describe(spark, d):
    return _rounded(membership.describe(membership.sizes(members(spark, d)), "size"))


def distinct_users(spark, d):
    return membership.distinct_users(interactions(spark, d).where("community IS NOT NULL"), ["community"])


def vertex_degrees(spark, d):
    return membership.vertex_degrees(members(spark, d))


def community_filter_semi(spark, d):
    m = members(spark, d)
    return membership.keep_communities(m, _chosen(m))


def community_exclude_anti(spark, d):
    m = members(spark, d)
    return membership.drop_communities(m, _chosen(m))


def size_range_having(spark, d):
    return membership.size_between(membership.sizes(members(spark, d)), SIZE_LOW, SIZE_HIGH)


def community_overlap(spark, d):
    return membership.overlap(keep(members(spark, d)))


def overlapping_pairs(spark, d):
    return membership.overlapping_pairs(keep(members(spark, d)), MIN_COMMON, MIN_PAIRS)


def overlapping_names(spark, d):
    return membership.overlapping_names(membership.overlapping_pairs(keep(members(spark, d)), MIN_COMMON, MIN_PAIRS))


def overlapping_fetch(spark, d):
    rows = interactions(spark, d).where("community IS NOT NULL")
    return membership.fetch_overlapping(rows, SIZE_LOW, SIZE_HIGH, MIN_WEIGHT, MIN_COMMON, MIN_PAIRS, TRAIN, SEED)


def train_test_split(spark, d):
    return membership.split_communities(_anomalous(members(spark, d)), TRAIN, SEED).select("community", "split")


# --- graph ----------------------------------------------------------------------------------------------------------------


def edges_filtered(spark, d):
    return graph.clean_edges(interactions(spark, d), MIN_WEIGHT).select("community", "src", "dst", "weight")


def simple_graph(spark, d):
    return simple(spark, d)


def induced_subgraph(spark, d):
    m = members(spark, d)
    chosen = m.join(_chosen(m), "community", "left_semi").select(F.col("vertex").alias("id"))
    return graph.induced_subgraph(simple(spark, d), chosen)[0]


def boundary_vertices(spark, d):
    return graph.boundary_counts(keep(simple(spark, d)), keep(members(spark, d)))


def adjlist_lines(spark, d):
    g = simple(spark, d)
    return graph.adjacency_lines(g, graph.nodes_of(g))


def graph_counts(spark, d):
    g = simple(spark, d)
    return g.agg(F.count("*").alias("n_edges")).withColumn("n_nodes", graph.nodes_of(g).agg(F.count("*").alias("n")).scalar())


# --- sampling and features ------------------------------------------------------------------------------------------------


def positive_sample(spark, d):
    m = members(spark, d)
    return sampling.positive_sample(m, 500, SEED)


def negative_sample(spark, d):
    m = keep(members(spark, d))
    return sampling.negative_sample(m, m.count(), SEED)


def preferential_attachment(spark, d):
    m = members(spark, d)
    return features.with_degrees(m, sampling.positive_sample(m)).select("community", "vertex", "preferential_attachment_score")


def total_friends(spark, d):
    m = members(spark, d)
    return features.with_degrees(m, sampling.positive_sample(m)).select("community", "vertex", "total_friends")


def friends_measure(spark, d):
    codes = coded_members(spark, d)
    return codes.decode(features.friends_measure(codes.links).select("community", "vertex", "friends_measure"))


def shortest_path(spark, d):
    codes = coded_members(spark, d)
    return codes.decode(features.topological_features(codes.links).select("community", "vertex", "shortest_path"))


def topological_features(spark, d):
    codes = coded_members(spark, d)
    return codes.decode(features.topological_features(codes.links, lambda: _sample(codes)))


def _probs(spark, d) -> tuple[Codes, DataFrame]:
    """The members' numbers, and the probability of each link under them."""
    codes = coded_members(spark, d)
    return codes, meta.closed_form_probability(keep_result(spark, lambda: features.linked(codes.links), "features"))


def edge_prob_closed_form(spark, d):
    codes, probs = _probs(spark, d)
    return codes.decode(probs).withColumn("prob", F.round("prob", 9))


def label_by_threshold(spark, d):
    codes, probs = _probs(spark, d)
    return codes.decode(probs.select("community", "vertex", meta.predicted_label(F.col("prob")).alias("label")))


# --- meta-features --------------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    # + 0.0 turns a negative zero into zero
    return df.select(*((F.round(f"`{c}`", places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def scores(spark, d, places: int = 6) -> DataFrame:
    codes, probs = _probs(spark, d)
    return _rounded(codes.decode_communities(meta.meta_features(probs)), places)


def meta_features(spark, d):
    return scores(spark, d).drop("weighted_sum")


def weighted_sum(spark, d):
    return scores(spark, d).select("community", "weighted_sum")


def meta_feature_ranking(spark, d):
    return meta.rank_features(scores(spark, d))


def ranking_wide(spark, d):
    return meta.ranking_wide(meta.rank_features(scores(spark, d)))


def most_anomalous_tail(spark, d):
    return meta.most_anomalous(meta.rank_features(scores(spark, d)))


# --- baselines ------------------------------------------------------------------------------------------------------------


def _measured(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(measures.measure(name, keep(simple(spark, d)), keep(members(spark, d))))

    return query


def amen_normality(spark, d):
    parts = measures.unattr_amen(keep(simple(spark, d)), keep(members(spark, d)), parts=True)
    return _rounded(parts.withColumn("score", F.col("consistency") + F.col("separability")))


def baseline_ranking_all(spark, d):
    return _rounded(measures.rank_measures(keep(simple(spark, d)), keep(members(spark, d))))


# --- evaluation -----------------------------------------------------------------------------------------------------------


def _judged(spark, d):
    m = members(spark, d)
    ranking = meta.rank_features(scores(spark, d, 4))
    return evaluation.label_anomalous(ranking, _anomalous(m).where("is_anomalous").select("community"))


def average_precision(spark, d):
    return _rounded(evaluation.average_precision(_judged(spark, d), ["feature"]))


def pr_curve(spark, d):
    return _rounded(evaluation.pr_curve(_judged(spark, d), ["feature"], True).drop("gain"))


def confusion_metrics(spark, d):
    codes = coded_members(spark, d)
    found = keep_result(spark, lambda: features.linked(codes.links, lambda: _sample(codes)), "features")
    probs = meta.closed_form_probability(found, "edge_exist")
    labels = probs.withColumn("predicted", meta.predicted_label(F.col("prob"), 0.1))
    return _rounded(evaluation.classification_scores(labels, "edge_exist", "predicted"))


def prediction_summary(spark, d):
    probs = _probs(spark, d)[1]
    return _rounded(evaluation.prediction_summary(probs.withColumn("predicted", meta.predicted_label(F.col("prob"))), "predicted"))


def _grid_results(spark, d):
    """A grid of results from real rows: a day is a network, its number the setting; a community's score is its sources per row, or its mean weight."""
    rows = interactions(spark, d).where("community IS NOT NULL AND mindate IS NOT NULL AND src IS NOT NULL AND weight BETWEEN 1 AND 1000")
    each = rows.groupBy("community", F.dayofmonth("mindate").alias("network")).agg(F.count_distinct("src").alias("n_src"), F.count("*").alias("n"), F.sum("weight").alias("w"))
    cell = {
        "p": (F.col("network") % 4 + 1).cast("double") / 20, "m": (F.floor(F.col("network") / 4) % 2 + 1).cast("double") / 100,
        "size_group": F.when(F.md5("community") < "8", "min").otherwise("median"), "network": F.col("network"),
    }
    scores = F.array(
        F.struct(F.lit("sources").alias("algorithm"), F.round(F.col("n_src").cast("double") / F.col("n"), 6).alias("score")),
        F.struct(F.lit("weight").alias("algorithm"), F.round(F.col("w").cast("double") / F.col("n"), 6).alias("score")),
    )
    return each.select(
        "community", *(v.alias(k) for k, v in cell.items()), F.explode(scores).alias("s"), F.when(F.substring(F.md5("community"), 3, 1) < "4", 1).otherwise(0).alias("is_anomalous")
    ).select("p", "m", "size_group", "network", "s.algorithm", "community", "s.score", "is_anomalous")


def _by_setting(spark, d):
    return evaluation.precision_by_setting(_grid_results(spark, d), ["p", "m", "size_group", "algorithm"])


def map_by_algorithm(spark, d):
    return _rounded(_by_setting(spark, d))


def meta_feature_comparison(spark, d):
    largest = _by_setting(spark, d).where(F.col("m") == 0.02)
    by_group = largest.groupBy("p", "size_group", "algorithm").agg(F.avg("mean_ap").alias("mean_ap"))
    return _rounded(evaluation.compare(by_group, ["p"], "algorithm", ["sources", "weight"]))


def comparison_pivot(spark, d):
    return _rounded(evaluation.compare(_by_setting(spark, d).where("algorithm = 'sources'"), ["p", "size_group"], "m", ["0.01", "0.02"]))


def comparison_by_p(spark, d):
    return _rounded(evaluation.mean_of_means(_by_setting(spark, d).where("algorithm = 'weight'"), ["p"], ["size_group"]))


def comparison_by_group(spark, d):
    return _rounded(evaluation.mean_of_means(_by_setting(spark, d).where("algorithm = 'sources'"), ["size_group"], ["m"]))


def baseline_comparison(spark, d):
    chosen = _by_setting(spark, d).where("m = 0.01 AND size_group = 'min'")
    return _rounded(evaluation.compare(chosen, ["p"], "algorithm", ["sources", "weight"]))


def comparison_summary(spark, d):
    return _rounded(evaluation.summary(evaluation.compare(_by_setting(spark, d), ["p", "m", "size_group"], "algorithm", ["sources", "weight"]), ["sources", "weight"]))


# --- generators -----------------------------------------------------------------------------------------------------------


def anomalous_sizes(spark, d):
    return sampling.anomalous_sizes(membership.sizes(members(spark, d)), ANOMALOUS, "median", WIDTH, SEED)


def bootstrap_sizes(spark, d):
    return sampling.bootstrap_sizes(membership.sizes(members(spark, d)), DRAWS, SEED)


def weighted_pick(spark, d):
    draws = spark.range(1, 1001).withColumnRenamed("id", "draw")
    return sampling.weighted_pick(draws, membership.sizes(members(spark, d)), "draw", "community", "size", SEED)


def _placed(spark, d):
    return generators.offsets(anomalous_sizes(spark, d).select(F.col("slot").alias("idx"), F.concat(F.lit("c"), F.lpad(F.col("slot").cast("string"), 3, "0")).alias("community"), "size"))


def er_community_edges(spark, d):
    return generators.er_edges_hashed(cut(_placed(spark, d)), ER_P, SEED)


def er_sparse_edges(spark, d):
    return generators.er_edges(cut(_placed(spark, d)), ER_P, SEED)


def ba_community_edges(spark, d):
    return generators.ba_edges(cut(_placed(spark, d)), 1, SEED)


def inter_community_edges(spark, d):
    placed = cut(_placed(spark, d))
    inner = cut(generators.ba_edges(placed, 1, SEED))
    names = placed.select("community")
    return generators.inter_edges(placed, inner, names, names, 0.075, (1, 1), SEED)[0]


def infused_network(spark, d):
    return generators.infuse(cut(simple(spark, d)), cut(members(spark, d)), anomalous_sizes(spark, d), ER_P, 0.2, (1, 2), SEED).edges


# --- keys and learning ----------------------------------------------------------------------------------------------------


def edge_key_roundtrip(spark, d):
    keyed = members(spark, d).withColumn("key", edge_key(F.col("community"), F.col("vertex")))
    community, vertex = parse_edge_key(F.col("key"))
    return keyed.select("key", community.alias("community_head"), vertex.alias("vertex_rest"))


def _halves(spark, d):
    m = keep(members(spark, d))
    train = _chosen(m)
    return m.join(train, "community", "left_semi"), m.join(train, "community", "left_anti")


def link_prediction_gbt(spark, d):
    train, test = _halves(spark, d)
    fitted = fit_links(keep(labelled_features(train, seed=SEED), "train"), seed=SEED)
    return fitted.predict(labelled_features(test, seed=SEED, negatives=False))


def detect_end_to_end(spark, d):
    train, test = _halves(spark, d)
    return detect(train, test, seed=SEED).ranking


QUERIES = {
    f.__name__: f
    for f in (
        membership_edges, bipartite_properties, community_sizes, size_describe, distinct_users, edges_filtered, simple_graph, vertex_degrees, community_filter_semi,
        community_exclude_anti, size_range_having, community_overlap, overlapping_pairs, overlapping_names, overlapping_fetch, train_test_split, positive_sample, negative_sample,
        preferential_attachment, total_friends, friends_measure, shortest_path, topological_features, edge_prob_closed_form, label_by_threshold, meta_features, weighted_sum,
        meta_feature_ranking, ranking_wide, most_anomalous_tail, induced_subgraph, boundary_vertices, graph_counts, amen_normality, baseline_ranking_all, average_precision,
        pr_curve, confusion_metrics, prediction_summary, map_by_algorithm, meta_feature_comparison, comparison_pivot, comparison_by_p, comparison_by_group,
        baseline_comparison, comparison_summary, anomalous_sizes, bootstrap_sizes, weighted_pick, er_community_edges, er_sparse_edges, ba_community_edges,
        inter_community_edges, infused_network, adjlist_lines, edge_key_roundtrip, link_prediction_gbt, detect_end_to_end,
    )
} | {name: _measured(name) for name in ("avg_degree", "cut_ratio", "avg_odf", "conductance", "flake_odf")}
