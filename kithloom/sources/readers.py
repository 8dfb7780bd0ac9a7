"""Sources: partition maps, sizes, interaction CSVs, adjacency lists, checkpoints, results, logs. Schemas are fixed, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kithloom.functions.text import parse_edge_key
from kithloom.operators.features import FEATURES
from kithloom.operators.graph import parse_adjacency
from kithloom.operators.membership import from_partition_map
from kithloom.operators.order import numbered

EDGE_FILE = T.StructType([T.StructField(c, T.LongType() if c == "weight" else T.StringType()) for c in ("__src_id", "__dst_id", "weight", "mindate", "maxdate")])
VERTEX_FILE = T.StructType([T.StructField("__id", T.StringType())])
LOG = "enumeration int, norm_comm_sizes array<int>, anom_comm_sizes array<int>, bipart_train_part map<string,array<string>>, bipart_test_part map<string,array<string>>, num_nodes long, num_edges long, avg_degree double"


def literal(path: str) -> str:
    """A path whose brackets are no pattern: the names of experiment folders hold some."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _unescaped(name: Column) -> Column:
    # a plus sign stands for itself in paths
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _steps() -> Column:
    """The parts of the file's path, from the session's form of it (an encoded URI)."""
    return F.split(_unescaped(F.col("_metadata.file_path")), "/")


def file_stem(suffix: str = "") -> Column:
    """The file's name without folders and ``suffix``; of a file that Spark wrote as a folder of parts, that folder's."""
    parts = _steps()
    name = F.when(F.element_at(parts, -1).startswith("part-"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    return F.regexp_replace(name, suffix + "$" if suffix else r"$", "")


def folder_community() -> Column:
    """The community that the file's folder is named after; characters that folders can't hold are written as %XX."""
    return _unescaped(F.regexp_replace(F.element_at(_steps(), -2), "^community=", ""))


def _json(spark: SparkSession, path: str, kind: str, lines: bool) -> DataFrame:
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", kind).alias("v"))


def read_partition_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(community, vertex) of a JSON object of lists (S1); with ``lines``, of one object a line, which are taken together."""
    return from_partition_map(_json(spark, path, "map<string,array<string>>", lines), "v")


def read_size_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, idx, size) of JSON arrays of numbers."""
    return _json(spark, path, "array<int>", lines).select("path", F.posexplode("v").alias("idx", "size"))


def read_size_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(community, size), size null where unknown (S3)."""
    return _json(spark, path, "map<string,int>", lines).select(F.explode("v").alias("community", "size"))


def _csv(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(path)


def read_edges(spark: SparkSession, folder: str, partitioned: bool = False) -> DataFrame:
    """(community, src, dst, weight, mindate, maxdate) of all <name>/<name>.edges.csv below a folder (S4, P5), or of what write_edges left there."""
    rows = _csv(spark, EDGE_FILE, f"{folder}/community=*/*.csv" if partitioned else f"{folder}/*/*.edges.csv")
    return rows.select(folder_community().alias("community"), F.col("__src_id").alias("src"), F.col("__dst_id").alias("dst"), "weight", "mindate", "maxdate")


def read_vertices(spark: SparkSession, folder: str, partitioned: bool = False) -> DataFrame:
    """(community, vertex) of all <name>/<name>.vertices.csv below a folder (S5), or of what write_vertices left there."""
    rows = _csv(spark, VERTEX_FILE, f"{folder}/community=*/*.csv" if partitioned else f"{folder}/*/*.vertices.csv")
    return rows.select(folder_community().alias("community"), F.col("__id").alias("vertex"))


def sizes_of_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(community, size) for every requested name, null where there is no file."""
    return names.select("community").distinct().join(counts, "community", "left")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(simple graph, nodes) of an adjacency list."""
    return parse_adjacency(spark.read.text(path))


def read_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) features that write_features kept."""
    return spark.read.parquet(f"{folder}/train"), spark.read.parquet(f"{folder}/test")


def read_feature_csv(spark: SparkSession, path: str, vertex_first: bool = False) -> DataFrame:
    """Features of a CSV whose first column is the text of (community, vertex)."""
    schema = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in (*FEATURES, "edge_exist"))])
    rows = _csv(spark, schema, path)
    community, vertex = parse_edge_key(F.col("key"), vertex_first)
    return rows.select(community.alias("community"), vertex.alias("vertex"), *FEATURES, F.col("edge_exist").cast("int"))


def read_results(spark: SparkSession, folder: str, algorithm: str, features: tuple[str, ...]) -> DataFrame:
    """(experiment, feature, rank, community, score) of all result CSVs whose name starts with ``algorithm``."""
    fields = [T.StructField("rank", T.IntegerType())]
    for f in features:
        fields += [T.StructField(f"{f}__ranking", T.StringType()), T.StructField(f"{f}__score", T.DoubleType())]
    rows = _csv(spark, T.StructType(fields), f"{folder}/{algorithm}*.csv")
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__ranking").alias("community"), F.col(f"{f}__score").alias("score")) for f in features]
    return rows.select(file_stem(r"\.csv").alias("experiment"), F.col("rank"), F.explode(F.array(*pairs)).alias("p")).select("experiment", "p.feature", "rank", "p.community", "p.score")


def read_logs(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Experiment logs of all files with NetworkLog in their names; the counts of the network are null where a log has none.

    A log is one JSON document, or with ``lines`` what write_log left: lines that each hold a part of it. log_sizes and log_members
    read either.
    """
    return spark.read.schema(LOG).option("multiLine", not lines).json(f"{folder}/*NetworkLog*")


def log_sizes(logs: DataFrame) -> DataFrame:
    """(enumeration, is_anomalous, size) of every community of the logs."""
    parts = [logs.select("enumeration", F.lit(odd).alias("is_anomalous"), F.explode(f"{kind}_comm_sizes").alias("size")) for kind, odd in (("norm", False), ("anom", True))]
    return parts[0].unionByName(parts[1])


def log_members(logs: DataFrame) -> DataFrame:
    """(enumeration, split, community, vertex) of the logs' partition maps."""
    parts = [logs.select("enumeration", F.lit(s).alias("split"), F.explode(f"bipart_{s}_part").alias("community", "members")) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("enumeration", "split", "community", F.explode("members").alias("vertex"))


def read_ranking(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(rank, community, score) of a JSON list of pairs (S10); with ``lines``, of lists of (community, score, rank), which may be many."""
    rows = _json(spark, path, "array<array<string>>", lines).select(F.posexplode("v").alias("at", "pair"))
    rank = F.col("pair")[2].cast("int") if lines else F.col("at") + 1
    return rows.select(rank.alias("rank"), F.col("pair")[0].alias("community"), F.col("pair")[1].cast("double").alias("score"))


def list_folders(spark: SparkSession, root: str, skip: str = "Raw_data") -> list[str]:
    """Paths of the folders in ``root`` but the one named ``skip``, in order of their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f"{root}/{x.getPath().getName()}" for x in found if x.isDirectory() and x.getPath().getName() != skip)


def list_files(spark: SparkSession, folder: str, contains: str = "", skip: str = "Raw_data") -> DataFrame:
    """(path, stem) of files below a folder, by parts of their names (S11); a folder of parts that Spark wrote is one file.

    The stem is the name without the words train, test, network and partition and the ending, so the files of one network share it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "/part-[^/]*$", "").alias("path")).distinct()
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(name.contains(contains) & ~F.col("path").contains(skip))
    return kept.select("path", F.regexp_replace(name, r"_?(train|test|network)?_?(network|partition)?\.\w+$", "").alias("stem"))


def file_triples(spark: SparkSession, maps: str, networks: str) -> DataFrame:
    """(enumeration, stem, train, test, network): files of one network, paired by their stems and not by their places in a listing.

    Enumeration is 0, 1, ... by stem; stems without all three files are left out.
    """
    found = list_files(spark, maps, "train").select("stem", F.col("path").alias("train"))
    for kind, folder in (("test", maps), ("network", networks)):
        found = found.join(list_files(spark, folder, kind if folder == maps else "").select("stem", F.col("path").alias(kind)), "stem")
    return numbered(found, ["stem"], "enumeration").withColumn("enumeration", (F.col("enumeration") - 1).cast("int")).select("enumeration", "stem", "train", "test", "network")
