"""Sinks for what the readers read.

Documents that would hold a whole table are written as many lines, each a document of the same kind that holds a part; the single
document that other tools expect is written on request, and only below LARGEST_DOCUMENT entries.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithloom.functions.text import edge_key
from kithloom.operators.features import FEATURES
from kithloom.operators.graph import adjacency_lines

#: Entries of a single document at most, and of one line.
LARGEST_DOCUMENT, LINE = 1_000_000, 4096


def write_features(train: DataFrame, test: DataFrame, folder: str) -> None:
    """Features as Parquet, a barrier between extraction and learning (K1)."""
    train.write.mode("overwrite").parquet(f"{folder}/train")
    test.write.mode("overwrite").parquet(f"{folder}/test")


def write_feature_csv(features: DataFrame, path: str, compression: str = "none") -> None:
    """Features as CSV with the text of (community, vertex) first (K1, F1); readers know the compression by the files' names."""
    rows = features.select(edge_key(F.col("community"), F.col("vertex")).alias("key"), *FEATURES, "edge_exist")
    rows.write.mode("overwrite").options(header=True, escape='"', compression=compression).csv(path)


def write_bipartite(m: DataFrame, path: str, community_label: str = "community", vertex_label: str = "vertex") -> None:
    """Links as CSV under the partites' labels (K2)."""
    rows = m.select(F.col("community").alias(community_label), F.col("vertex").alias(vertex_label))
    rows.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _by_community(rows: DataFrame, folder: str) -> None:
    rows.where("community IS NOT NULL").write.mode("overwrite").partitionBy("community").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)


def write_edges(edges: DataFrame, folder: str) -> None:
    """(community, src, dst, weight, mindate, maxdate) as CSV in a folder for each community, which may hold several files; rows without a community are left out."""
    times = [F.col(c).cast("string").alias(c) for c in ("mindate", "maxdate")]
    _by_community(edges.select("community", F.col("src").alias("__src_id"), F.col("dst").alias("__dst_id"), "weight", *times), folder)


def write_vertices(m: DataFrame, folder: str) -> None:
    """(community, vertex) as CSV in a folder for each community."""
    _by_community(m.select("community", F.col("vertex").alias("__id")), folder)


def _checked(df: DataFrame) -> DataFrame:
    """df if a single document may hold it."""
    if df.limit(LARGEST_DOCUMENT + 1).count() > LARGEST_DOCUMENT:
        raise ValueError(f"more than {LARGEST_DOCUMENT} entries for one document; write lines")
    return df


def member_lists(m: DataFrame, line: int = LINE) -> DataFrame:
    """(community, members): a community's members in lists of about ``line`` at most; large communities have several."""
    parts = m.groupBy("community").agg(F.ceil(F.count("*") / line).alias("__parts"))
    placed = m.join(parts, "community").withColumn("__part", F.pmod(F.xxhash64("vertex"), F.col("__parts")))
    return placed.groupBy("community", "__part").agg(F.array_sort(F.collect_list("vertex")).alias("members")).drop("__part")


def partition_map(m: DataFrame) -> DataFrame:
    """One row: the JSON object of members by community, of at most LARGEST_DOCUMENT memberships (K3)."""
    lists = _checked(m).groupBy("community").agg(F.array_sort(F.collect_list("vertex")).alias("members"))
    return lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("community", "members"))))).alias("value"))


def write_partition_map(m: DataFrame, path: str, lines: bool = False) -> None:
    """A partition map as one JSON document, or as ``lines`` of objects for networks of any size (K3)."""
    each = member_lists(m).select(F.to_json(F.create_map("community", "members")).alias("value")) if lines else partition_map(m)
    each.write.mode("overwrite").text(path)


def write_adjacency(graph: DataFrame, nodes: DataFrame, path: str) -> None:
    """An adjacency list (K4)."""
    adjacency_lines(graph, nodes).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_sizes(sizes: DataFrame, path: str, lines: bool = False) -> None:
    """{community: size or null} as one JSON document or as ``lines`` of objects (K8)."""
    kept = {"ignoreNullFields": "false"}
    if lines:
        rows = sizes.select(F.to_json(F.create_map("community", F.col("size").cast("int")), kept).alias("value"))
    else:
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("community", F.col("size").cast("int")))))
        rows = _checked(sizes).agg(F.to_json(entries, kept).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_size_list(sizes: DataFrame, path: str, lines: bool = False) -> None:
    """[size, ...] as one JSON document, ascending, or as ``lines`` of one size each."""
    size = F.col("size").cast("int")
    rows = sizes.select(F.to_json(F.array(size)).alias("value")) if lines else _checked(sizes).agg(F.to_json(F.array_sort(F.collect_list(size))).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str, replace: bool = False) -> None:
    """Experiment results by size group and experiment; an existing folder is an error unless it is to be replaced (K6, K9)."""
    results.write.mode("overwrite" if replace else "errorifexists").partitionBy("size_group", "enumeration").parquet(path)


def write_result_csv(wide: DataFrame, path: str) -> None:
    """One experiment's wide ranking as CSV, ``rank`` first (K6)."""
    wide.select("rank", *[c for c in wide.columns if c != "rank"]).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_log(path: str, enumeration: int, communities: DataFrame, train: DataFrame, test: DataFrame) -> None:
    """One experiment's log as JSON lines: each has the number and a community's size, or members of a community of either map (K6)."""
    size = F.array(F.col("size").cast("int"))
    kind = "map<string,array<string>>"
    known = communities.select(F.when(~F.col("is_anomalous"), size).alias("norm_comm_sizes"), F.when(F.col("is_anomalous"), size).alias("anom_comm_sizes"))
    rows = known.withColumn("bipart_train_part", F.lit(None).cast(kind)).withColumn("bipart_test_part", F.lit(None).cast(kind))
    for name, m in (("bipart_train_part", train), ("bipart_test_part", test)):
        part = member_lists(m).select(F.create_map("community", "members").alias(name))
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows.select(F.lit(enumeration).alias("enumeration"), "*").write.mode("overwrite").json(path)


def stamped(path: str, at: datetime | None = None) -> str:
    """``path`` with MM.dd_HH.mm of a time, now by default, for results that don't replace earlier ones."""
    return f"{path}_{at or datetime.now():%m.%d_%H.%M}"


def write_ranking(ranking: DataFrame, path: str, lines: bool = False, with_time: bool = False) -> str:
    """[[community, score], ...] in rank order as one JSON document, or ``lines`` of [[community, score, rank]] (K7); returns the path, ``with_time`` a stamped one."""
    path = stamped(path) if with_time else path
    if lines:
        rows = ranking.select(F.to_json(F.array(F.array("community", F.col("score").cast("string"), F.col("rank").cast("string")))).alias("value"))
    else:
        pairs = F.array_sort(F.collect_list(F.struct("rank", "community", "score")))
        listed = _checked(ranking).agg(F.transform(pairs, lambda r: F.array(r["community"], r["score"].cast("string"))).alias("v"))
        rows = listed.select(F.to_json("v").alias("value"))
    rows.write.mode("overwrite").text(path)
    return path


def write_config(spark: SparkSession, settings: dict, path: str) -> None:
    """Generator settings as JSON, callables by their names (K5); the path may be of any file system."""
    value = json.dumps({k: getattr(v, "__name__", v) for k, v in settings.items()})
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)
