"""Session defaults and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every scale; sizes of partitions stay with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Spark's setting that removes an execution's shuffle files when it ends.
REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders made by fresh_dir in this process, in their order.
_made: list[str] = []


def build_session(app: str = "kithloom", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf (dots as double underscores) overrides them."""
    given = {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=DEFAULTS | given).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that setting is absent a local master (tests) gets a folder of this machine; a cluster raises, as its executors wouldn't
    share such a folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kithloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(REMOVES_SHUFFLES, "false")
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVES_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, as a plan keeps the setting it was made under


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


@contextmanager
def kept_folders(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the folders that ``keep`` and ``fresh_dir`` made within it; results must be written or collected by then."""
    before = len(_made)
    try:
        yield
    finally:
        _remove(spark, _made[before:])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _made.remove(path)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, purpose: str = "kept") -> DataFrame:
    """df, computed once and written as a table in the shared folder: columnar, so later steps read only what they need.

    For larger results than ``cut``; as with that, the folder is the caller's to empty when the job is over, for which there is ``kept_folders``.
    """
    path = fresh_dir(df.sparkSession, purpose)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_result(spark: SparkSession, build: Callable[[], DataFrame], purpose: str = "kept") -> DataFrame:
    """What ``build`` returns, kept; the tables that were kept on the way to it are removed, so nothing else may read them."""
    before = len(_made)
    kept = keep(build(), purpose)
    _remove(spark, _made[before:-1])
    return kept


def remove_kept(spark: SparkSession, df: DataFrame) -> None:
    """Removes the folder of a table that ``keep`` returned and that nothing reads any more."""
    files = df.inputFiles()
    _remove(spark, [p for p in _made if any(f"/{os.path.basename(p)}/" in f for f in files)])
