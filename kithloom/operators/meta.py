"""From link probabilities to scores and rankings of communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kithloom.operators.order import ranked

META = ("normality_prob_mean", "normality_prob_std", "normality_prob_median", "predicted_label_mean", "predicted_label_std", "weighted_sum")


def predicted_label(prob: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on, else 0 (P10)."""
    return F.when(prob >= F.lit(threshold), 1).otherwise(0)


def closed_form_probability(features: DataFrame, *kept: str) -> DataFrame:
    """(community, vertex, ``kept`` columns, prob): friends / (friends + 1 + difference of degrees), a stand-in for a classifier that SQL can check."""
    friends = F.col("friends_measure").cast("double")
    gap = F.abs(F.col("vertex_1_degree") - F.col("vertex_2_degree")).cast("double")
    return features.select("community", "vertex", *kept, (friends / (friends + F.lit(1.0) + gap)).alias("prob"))


def meta_features(probs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(community, META) from (community, vertex, prob): mean, 1 - std and median of the probabilities, mean and 1 - std of the labels (population std), and their weighted sum."""
    label = predicted_label(F.col("prob"), threshold).cast("double")
    base = probs.groupBy("community").agg(
        F.avg("prob").alias("normality_prob_mean"),
        (1 - F.stddev_pop("prob")).alias("normality_prob_std"),
        F.median("prob").alias("normality_prob_median"),
        F.avg(label).alias("predicted_label_mean"),
        (1 - F.stddev_pop(label)).alias("predicted_label_std"),
    )
    weighted = 0.5 * (F.col("normality_prob_std") + F.col("predicted_label_std") - F.col("normality_prob_mean") - F.col("predicted_label_mean"))
    return base.withColumn("weighted_sum", weighted)


def rank_features(scores: DataFrame, columns: tuple[str, ...] = META) -> DataFrame:
    """(feature, rank, community, score): communities by falling score, nulls last, ties by name."""
    long = scores.unpivot("community", list(columns), "feature", "score")
    keyed = long.select("feature", "community", "score", F.col("score").isNull().alias("__none"), (-F.col("score")).alias("__key"))
    return ranked(keyed, ["feature"], ["__none", "__key", "community"]).select("feature", "rank", "community", "score")


def ranking_wide(ranking: DataFrame, columns: tuple[str, ...] = META) -> DataFrame:
    """rank, then <feature>__ranking and <feature>__score of each feature, each pair in its own order."""
    picked = []
    for c in columns:
        for what, name in (("community", "ranking"), ("score", "score")):
            picked.append(F.max(F.when(F.col("feature") == c, F.col(what))).alias(f"{c}__{name}"))
    return ranking.groupBy("rank").agg(*picked)


def most_anomalous(ranking: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` ranks of each feature but the median and the weighted sum."""
    kept = ranking.where(~F.col("feature").isin("normality_prob_median", "weighted_sum"))
    last = kept.groupBy("feature").agg(F.max("rank").alias("last"))
    return kept.join(last, "feature").where(F.col("rank") > F.col("last") - n).drop("last")
