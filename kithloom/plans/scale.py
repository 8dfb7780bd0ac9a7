"""Queries of the core's scale problems: p2 (heavy keys) and p3 (tiny files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithloom.functions.canonical import canonical_id, canonical_name
from kithloom.operators import skew
from kithloom.session import cut, fresh_dir
from kithloom.streaming import compactor

#: A key counts as holding a large part with 1 row in so many.
P2_ONE_IN = 40


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.read.parquet(f"{sf_dir}/edges.parquet")
    return edges.select(
        canonical_name("community").alias("community"), canonical_id("__src_id").alias("src"), canonical_id("__dst_id").alias("dst"), "mindate"
    )


def _both_keys(edges: DataFrame) -> DataFrame:
    """Each row once for its community and once for its source: (key_field, key_value, other columns)."""
    keys = F.array(F.struct(F.lit("community").alias("f"), F.col("community").alias("v")), F.struct(F.lit("__src_id").alias("f"), F.col("src").alias("v")))
    return edges.select(F.explode(keys).alias("k"), "dst", "mindate").select(F.col("k.f").alias("key_field"), F.col("k.v").alias("key_value"), "dst", "mindate")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of community and of __src_id with at least 2.5 percent of all rows."""
    counts = cut(skew.key_counts(_both_keys(_keyed(spark, sf_dir)), ["key_field", "key_value"]))
    total = counts.where("key_field = 'community'").agg(F.sum("n_rows").alias("n")).scalar()  # rows without a value are counted too
    return counts.where(F.col("key_value").isNotNull() & (F.col("n_rows") * P2_ONE_IN >= total)).select("key_field", "key_value")


def p2_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every community and every source: rows, distinct partners, first and last interaction."""
    measures = [F.min("mindate").alias("first_at"), F.max("mindate").alias("last_at")]
    found = skew.key_profile(_both_keys(_keyed(spark, sf_dir)), ["key_field", "key_value"], ["dst"], measures)
    return found.where(F.col("key_value").isNotNull()).select("key_field", "key_value", "n_rows", F.col("n_dst").alias("n_partners"), "first_at", "last_at")


def p2_listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of edges per community whose source is a listed member of it: a join on a skewed key."""
    edges = _keyed(spark, sf_dir).select("community", F.col("src").alias("id"))
    listed = (
        spark.read.parquet(f"{sf_dir}/vertices.parquet")
        .select(canonical_name("community").alias("community"), canonical_id("__id").alias("id"))
        .dropna()
        .distinct()
    )
    met = skew.skew_join(edges, listed, ["community", "id"], "left_semi")
    return met.groupBy("community").agg(F.count("*").alias("n_listed_rows"))


def _compacted(spark: SparkSession, sf_dir: str) -> compactor.Compacted:
    root = fresh_dir(spark, "compacted")
    return compactor.compact(spark, f"{sf_dir}/community_files.parquet", f"{root}/data", f"{root}/checkpoint")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that only repeat another of smaller file_id."""
    return compactor.repeats(_compacted(spark, sf_dir).deliveries())


def p3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted edge records of the deliveries that count."""
    return _compacted(spark, sf_dir).edges().drop("file_id")


def p3_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted vertex records of the deliveries that count."""
    return _compacted(spark, sf_dir).vertices().drop("file_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_key_profile, p2_listed_rows, p3_found, p3_edges, p3_vertices)}

ID_SQL = "nullif(lower(trim({0}, ' ' || chr(9))), '')"
NAME_SQL = "nullif(regexp_replace(" + ID_SQL + ", '^r/', ''), '')"


def canonical_edges_sql() -> str:
    return (
        f"k AS (SELECT {NAME_SQL.format('community')} AS community, {ID_SQL.format('__src_id')} AS src, "
        f"{ID_SQL.format('__dst_id')} AS dst, mindate FROM edges)"
    )


ORACLE = {
    "p2_found": f"""WITH {canonical_edges_sql()}, n AS (SELECT count(*) AS total FROM k)
SELECT 'community' AS key_field, community AS key_value FROM k, n WHERE community IS NOT NULL GROUP BY community, total HAVING count(*) * 40 >= total
UNION ALL
SELECT '__src_id', src FROM k, n WHERE src IS NOT NULL GROUP BY src, total HAVING count(*) * 40 >= total""",
    "p2_key_profile": f"""WITH {canonical_edges_sql()}
SELECT 'community' AS key_field, community AS key_value, count(*) AS n_rows, count(DISTINCT dst) AS n_partners, min(mindate) AS first_at, max(mindate) AS last_at FROM k WHERE community IS NOT NULL GROUP BY community
UNION ALL
SELECT '__src_id', src, count(*), count(DISTINCT dst), min(mindate), max(mindate) FROM k WHERE src IS NOT NULL GROUP BY src""",
    "p2_listed_rows": f"""WITH {canonical_edges_sql()}, v AS (SELECT DISTINCT {NAME_SQL.format('community')} AS community, {ID_SQL.format('__id')} AS src FROM vertices)
SELECT community, count(*) AS n_listed_rows FROM k SEMI JOIN v USING (community, src) GROUP BY community""",
}
