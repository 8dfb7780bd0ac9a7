"""How well scores tell anomalous communities, and comparisons over a grid of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kithloom.operators.measures import ASCENDING as TURNED, MEASURES


def label_anomalous(results: DataFrame, names: DataFrame) -> DataFrame:
    """results with is_anomalous 1 or 0."""
    known = names.select("community").distinct().withColumn("is_anomalous", F.lit(1))
    return results.join(known, "community", "left").fillna(0, ["is_anomalous"])


def high_is_anomalous(algorithm: Column, baselines_high: bool = True, ours_high: bool = False) -> Column:
    """Which end of an algorithm's scores is the anomalous one, as a condition.

    ``ours_high`` speaks of the meta-features, ``baselines_high`` of the structural measures; average degree and normality are turned
    the other way than the rest of these.
    """
    turned = algorithm.isin(*TURNED)
    base = ~turned if baselines_high else turned
    return F.when(algorithm.isin(*MEASURES), base).otherwise(F.lit(ours_high))


def pr_curve(results: DataFrame, keys: list[str], higher_is_anomalous: bool | Column = False) -> DataFrame:
    """(keys, threshold, n, n_pos, precision, recall) for each distinct score, the most anomalous first.

    ``results`` has keys, score and is_anomalous. A low score is anomalous unless told otherwise, for all rows or by a condition on
    them; rows without a score come after all others.
    """
    high = F.lit(higher_is_anomalous) if isinstance(higher_is_anomalous, bool) else higher_is_anomalous
    level = F.when(high, F.col("score")).otherwise(-F.col("score"))
    points = results.groupBy(*keys, level.alias("threshold")).agg(F.count("*").alias("__k"), F.sum(F.col("is_anomalous").cast("long")).alias("__p"))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("threshold"))
    run, everything = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    summed = points.select(*keys, "threshold", F.sum("__k").over(run).alias("n"), F.sum("__p").over(run).alias("n_pos"), "__p", F.sum("__p").over(everything).alias("__all"))
    return summed.select(
        *keys, "threshold", "n", "n_pos", (F.col("n_pos").cast("double") / F.col("n")).alias("precision"),
        F.try_divide(F.col("n_pos").cast("double"), F.col("__all").cast("double")).alias("recall"), F.try_divide(F.col("__p").cast("double"), F.col("__all").cast("double")).alias("gain"),
    )


def average_precision(results: DataFrame, keys: list[str], higher_is_anomalous: bool | Column = False) -> DataFrame:
    """(keys, ap): the sum over distinct scores of precision times the gain in recall; null without any anomaly."""
    curve = pr_curve(results, keys, higher_is_anomalous)
    return curve.groupBy(*keys).agg(F.sum(F.col("precision") * F.col("gain")).alias("ap"))


def confusion(labels: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row tn, fp, fn, tp, always all four."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return labels.agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def classification_scores(labels: DataFrame, truth: str, predicted: str) -> DataFrame:
    """confusion with precision, accuracy, F1, and the area under the curve of the hard labels, null with a class missing (M3)."""
    c = {k: F.col(k).cast("double") for k in ("tn", "fp", "fn", "tp")}
    tpr, tnr = F.try_divide(c["tp"], c["tp"] + c["fn"]), F.try_divide(c["tn"], c["tn"] + c["fp"])
    return confusion(labels, truth, predicted).select(
        "tn", "fp", "fn", "tp", F.coalesce(F.try_divide(c["tp"], c["tp"] + c["fp"]), F.lit(0.0)).alias("prc"),
        F.try_divide(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]).alias("acc"), F.coalesce(F.try_divide(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]), F.lit(0.0)).alias("f1"), ((tpr + tnr) / 2).alias("auc"),
    )


def prediction_summary(labels: DataFrame, predicted: str) -> DataFrame:
    """Of links that all exist: predicted to exist, predicted not to, and the former's share (M5)."""
    hit = F.count_if(F.col(predicted) == 1)
    return labels.agg(hit.alias("predicted_exist"), F.count_if(F.col(predicted) == 0).alias("predicted_not_exist"), F.try_divide(hit.cast("double"), F.count("*").cast("double")).alias("exist_ratio"))


def precision_by_setting(results: DataFrame, keys: list[str], network: str = "network", higher_is_anomalous: bool | Column = False) -> DataFrame:
    """(keys, mean_ap, std_ap, n_networks): average precision over a setting's networks, sample std."""
    return average_precision(results, [*keys, network], higher_is_anomalous).groupBy(*keys).agg(F.avg("ap").alias("mean_ap"), F.stddev_samp("ap").alias("std_ap"), F.count("ap").alias("n_networks"))


def compare(by_setting: DataFrame, rows: list[str], columns: str, values: list[str], value: str = "mean_ap") -> DataFrame:
    """``rows`` against the ``values`` of ``columns``, cells the mean of ``value``: the comparisons A18-A22, by choice of both."""
    cells: list[Column] = [F.avg(F.when(F.col(columns) == v, F.col(value))).alias(str(v)) for v in values]
    return by_setting.groupBy(*rows).agg(*cells)


def mean_of_means(by_setting: DataFrame, outer: list[str], inner: list[str], value: str = "mean_ap") -> DataFrame:
    """(outer, mean): mean over ``inner`` of the means of each (outer, inner)."""
    return by_setting.groupBy(*outer, *inner).agg(F.avg(value).alias("v")).groupBy(*outer).agg(F.avg("v").alias("mean"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, median, std) of columns, sample std."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "value")
    return long.groupBy("name").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"))
