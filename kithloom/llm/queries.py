"""The queries of this subpackage and their SQL where SQL can say it over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithloom.functions.canonical import canonical_name, known_account
from kithloom.llm import bpe, cooccurrence, distinct, mixture, overlap, residue
from kithloom.operators import skew
from kithloom.session import cut, keep

#: p1: least records of a pair, and how much more often than by chance.
P1_COUNT, P1_LIFT = 5, 8
#: p4: least shared members, and part of the smaller set.
P4_SHARED, P4_PART = 30, 0.25
#: p5: a recorded size is wrong beyond this part of the true one; standard errors a sketch is trusted within, and ids a coincidence of bits may hide.
P5_OFF, P5_SIGMAS, P5_HIDDEN = 0.15, 6.0, 2.0
#: p5: slices that are broadcast at most, some 50 bytes each; more are joined by shuffling.
P5_BROADCAST = 500_000
#: Seed of the mixture.
P7_SEED = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "edges")
    return edges.select(canonical_name("community").alias("community"), F.to_date("mindate").alias("day"), known_account("__src_id").alias("src"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that appear together in at least 5 records and 8 times as often as by chance."""
    pairs = cooccurrence.item_pairs(_appearances(spark, sf_dir), ["community", "day"], "src", P1_COUNT, P1_LIFT)
    return pairs.select(F.col("item_a").alias("src_a"), F.col("item_b").alias("src_b"))


def p1_listed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and lift of all pairs with at least 5 records, of the accounts that vertices list."""
    listed = _table(spark, sf_dir, "vertices").select(known_account("__id").alias("src")).dropna().distinct()
    rows = _appearances(spark, sf_dir).join(listed, "src", "left_semi")
    return cooccurrence.item_pairs(rows, ["community", "day"], "src", P1_COUNT)


def p1_all_listed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and lift of all pairs seen together at all, of the accounts that vertices list."""
    listed = _table(spark, sf_dir, "vertices").select(known_account("__id").alias("src")).dropna().distinct()
    rows = _appearances(spark, sf_dir).join(listed, "src", "left_semi")
    return cooccurrence.item_pairs(rows, ["community", "day"], "src")


def _member_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = _table(spark, sf_dir, "edges"), _table(spark, sf_dir, "vertices")
    ends = edges.select("community", F.explode(F.array("__src_id", "__dst_id")).alias("id"))
    rows = ends.unionByName(vertices.select("community", F.col("__id").alias("id")))
    return keep(overlap.set_members(rows.select(canonical_name("community").alias("community"), known_account("id").alias("id")), "community", "id"), "members")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of communities that share at least 30 members and a quarter of the smaller one.

    Sketches decide wherever they leave no doubt; the members of the other pairs are counted.
    """
    members = _member_sets(spark, sf_dir)
    pairs = cut(overlap.overlapping_pairs(members, P4_SHARED, P4_PART))
    exact = overlap.exact_shared(members, pairs.where("NOT surely")).where((F.col("n_shared") >= P4_SHARED) & (F.col("n_shared") * round(1 / P4_PART) >= F.col("n_small")))
    found = pairs.where("surely").select("small", "large").unionByName(exact.select("small", "large"))
    return found.select(F.least("small", "large").alias("community_a"), F.greatest("small", "large").alias("community_b"))


def p4_overlap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overlap of every pair of communities with a shared member; the sketches' estimates beside it for the pairs that they find under p4_found's bounds, else null."""
    members = _member_sets(spark, sf_dir)
    found = overlap.overlapping_pairs(members, P4_SHARED, P4_PART)
    found = found.select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"), "union_est", "fraction_est", "shared_est")
    first = F.col("n_a") <= F.col("n_b")
    return (
        overlap.all_shared(members)
        .join(found, ["a", "b"], "left")
        .select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("small"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("large"),
            F.least("n_a", "n_b").alias("n_small"),
            F.greatest("n_a", "n_b").alias("n_large"),
            "union_est",
            "fraction_est",
            "shared_est",
            "n_shared",
        )
    )


def _seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "edges")
    return edges.select(
        canonical_name("community").alias("community"),
        F.to_date("mindate").alias("day"),
        F.explode(F.array(known_account("__src_id"), known_account("__dst_id"))).alias("id"),
    ).where(F.col("id").isNotNull())


def p5_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated distinct users, with standard error, of each community, day, community and day, and of everything; unions are in p5_union_users."""
    base = distinct.sketch(_seen_users(spark, sf_dir), ["community", "day"], F.col("id"))
    null = {"community": F.lit(None).cast("string"), "day": F.lit(None).cast("date")}
    parts = []
    for keys in (["community", "day"], ["community"], ["day"], []):
        known = base
        for k in keys:
            known = known.where(F.col(k).isNotNull())
        found = distinct.estimate(known if len(keys) == 2 else distinct.merge(known, keys), keys)
        parts.append(found.select(*(F.col(c) if c in keys else null[c].alias(c) for c in null), "n_est", "rel_error"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _slices(sizes: DataFrame) -> DataFrame:
    """(a, b, day) of each slice: names canonical; b null unless two communities are meant; a null means all rows."""
    a, b = canonical_name("subreddit_name"), canonical_name("with_subreddit")
    second = F.when(a.isNotNull() & b.isNotNull() & (a != b), b)
    return sizes.select("size_id", "num_users", F.coalesce(F.when(second.isNotNull(), F.least(a, b)), a).alias("a"), F.when(second.isNotNull(), F.greatest(a, b)).alias("b"), F.col("size_day").alias("day"))


def _slice_id():
    return F.xxhash64("a", F.coalesce("b", F.lit("")), F.coalesce(F.col("day").cast("string"), F.lit("")))


def _part_id(c, day):
    """A part's id by community and day, either of which may stand for all."""
    return F.xxhash64(F.coalesce(c, F.lit("\0")), F.coalesce(day.cast("string"), F.lit("\0")))


def _parts(slices: DataFrame) -> DataFrame:
    """A row (sid, part) for each community of a slice."""
    each = slices.select("sid", "day", F.explode(F.when(F.col("b").isNull(), F.array("a")).otherwise(F.array("a", "b"))).alias("c"))
    return each.select("sid", _part_id(F.col("c"), F.col("day")).alias("part"))


def _users_of_parts(spark: SparkSession, sf_dir: str, parts: DataFrame) -> DataFrame:
    """(part, id) of the users of the parts that are asked for, from one reading of all rows: each counts for its community and day, for either, and for everything."""
    users = _seen_users(spark, sf_dir)
    c, day, none = F.col("community"), F.col("day"), F.lit(None)
    own = F.array(
        F.when(c.isNotNull() & day.isNotNull(), _part_id(c, day)), F.when(c.isNotNull(), _part_id(c, none)), F.when(day.isNotNull(), _part_id(none, day)), _part_id(none, none)
    )
    asked = cut(parts.select("part").distinct())
    return skew.lookup_join(users.select("id", F.explode(F.array_compact(own)).alias("part")), asked, ["part"], "left_semi", P5_BROADCAST)


def _estimated_slices(spark: SparkSession, sf_dir: str, slices: DataFrame) -> DataFrame:
    """(sid, n_est, rel_error) of each slice with users. Only parts that slices ask for are sketched, once; unions merge their communities' sketches."""
    parts = cut(_parts(slices))
    base = keep(distinct.sketch(_users_of_parts(spark, sf_dir, parts), ["part"], F.col("id")), "sketches")
    unions = slices.where("b IS NOT NULL").select("sid")
    single = distinct.estimate(base, ["part"]).join(parts.join(unions, "sid", "left_anti"), "part").select("sid", "n_est", "rel_error")
    merged = distinct.merge(base.join(parts.join(unions, "sid", "left_semi"), "part").select("sid", "slot", "bits"), ["sid"])
    return single.unionByName(distinct.estimate(merged, ["sid"]))


def p5_union_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated distinct users, with standard error, of each union of two communities that sizes are recorded for, of the day where one is named; 0 without any."""
    unions = cut(_slices(_table(spark, sf_dir, "reddit_comm_sizes")).where("b IS NOT NULL").withColumn("sid", _slice_id()).select("sid", "a", "b", "day").distinct())
    found = unions.join(_estimated_slices(spark, sf_dir, unions), "sid", "left").fillna(0.0, ["n_est", "rel_error"])
    return found.select(F.col("a").alias("community"), F.col("b").alias("with_community"), "day", "n_est", "rel_error")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded sizes that differ by more than 15 percent from the slice's distinct users.

    Sketches decide wherever their error leaves no doubt; the slices of the other rows are counted exactly.
    """
    stated = cut(_slices(_table(spark, sf_dir, "reddit_comm_sizes").where("num_users IS NOT NULL")).withColumn("sid", _slice_id()))
    slices = stated.select("sid", "a", "b", "day").distinct()
    judged = stated.join(_estimated_slices(spark, sf_dir, slices), "sid", "left").fillna(0.0, ["n_est", "rel_error"])
    doubt = F.col("n_est") * F.col("rel_error") * P5_SIGMAS + F.when(F.col("n_est") > 0, P5_HIDDEN).otherwise(0.0)
    low, high, n = F.col("n_est") - doubt, F.col("n_est") + doubt, F.col("num_users")
    surely_wrong = (n > high * (1 + P5_OFF)) | (n < low * (1 - P5_OFF))
    surely_right = (n <= low * (1 + P5_OFF)) & (n >= high * (1 - P5_OFF))
    judged = cut(judged.select("size_id", "sid", "a", "b", "day", "num_users", surely_wrong.alias("wrong"), (~surely_wrong & ~surely_right).alias("open")))
    open_slices = judged.where("open").select("sid", "a", "b", "day").distinct()
    open_parts = cut(_parts(open_slices))
    members = _users_of_parts(spark, sf_dir, open_parts).distinct().join(open_parts, "part")
    counted = members.select("sid", "id").distinct().groupBy("sid").agg(F.count("*").alias("d"))
    off = F.abs(F.col("num_users") - F.col("d")) * 100 > F.col("d") * round(100 * P5_OFF)
    settled = judged.where("open").join(counted, "sid").where(off).select("size_id")
    return judged.where("wrong").select("size_id").unionByName(settled)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _plan(spark: SparkSession, sf_dir: str, sized: DataFrame) -> DataFrame:
    return mixture.mixture_plan(sized, _table(spark, sf_dir, "mix_targets"))


def _listed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", mixture.spelled("source").alias("source"))
    targets = mixture.clean_targets(_table(spark, sf_dir, "mix_targets")).select("source")
    return docs.join(targets, "source", "left_semi").select("doc_id", "source", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay short of their target share in the mixture even though it repeats them as often as allowed."""
    copies, plan = _mixture(spark, sf_dir)
    return mixture.short_sources(mixture.reached_shares(copies, plan)).select("source")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the copies with their sizes, the plan)."""
    sized = cut(bpe.count_tokens(_listed_docs(spark, sf_dir), ["doc_id", "source"], "text"))
    plan = cut(_plan(spark, sf_dir, sized))
    return mixture.replicate(sized, "doc_id", plan, P7_SEED), plan


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself in its shuffled order: every copy of every document, with its text."""
    docs = _listed_docs(spark, sf_dir)
    plan = cut(_plan(spark, sf_dir, bpe.count_tokens(docs, ["source"], "text")))
    return mixture.shuffled(mixture.replicate(docs, "doc_id", plan, P7_SEED), ["doc_id", "copy"], P7_SEED)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, planned and reached share of each source."""
    copies, plan = _mixture(spark, sf_dir)
    return mixture.reached_shares(copies, plan)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an unfilled placeholder, or without any content of their own."""
    judged = residue.judge(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return judged.where("verdict IS NOT NULL").select("doc_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(p8_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_listed_pairs, p1_all_listed_pairs, p4_found, p4_overlap_sizes, p5_distinct_users, p5_union_users, p5_found, p6_ids, p7_found, p7_mixture, p7_shares, p8_found, p8_kept)
}

_ID = "nullif(lower(trim({0}, ' ' || chr(9))), '')"
_NAME = "nullif(regexp_replace(" + _ID + ", '^r/', ''), '')"
_KNOWN = "nullif(" + _ID + ", '[deleted]')"
_REC = f"""rec AS (SELECT DISTINCT c, d, s FROM (SELECT {_NAME.format('community')} AS c, CAST(mindate AS DATE) AS d, {_KNOWN.format('__src_id')} AS s FROM edges)
  WHERE c IS NOT NULL AND d IS NOT NULL AND s IS NOT NULL{{0}}),
n AS (SELECT count(*) AS total FROM (SELECT DISTINCT c, d FROM rec)),
f AS (SELECT s, count(*) AS k FROM rec GROUP BY s HAVING count(*) >= 5),
p AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM rec x JOIN rec y ON x.c = y.c AND x.d = y.d AND x.s < y.s
  WHERE x.s IN (SELECT s FROM f) AND y.s IN (SELECT s FROM f) GROUP BY x.s, y.s HAVING count(*) >= 5)"""
_MEM = f"""m AS (SELECT DISTINCT c, s FROM (
  SELECT {_NAME.format('community')} AS c, {_KNOWN.format('__src_id')} AS s FROM edges UNION ALL
  SELECT {_NAME.format('community')}, {_KNOWN.format('__dst_id')} FROM edges UNION ALL
  SELECT {_NAME.format('community')}, {_KNOWN.format('__id')} FROM vertices) WHERE c IS NOT NULL AND s IS NOT NULL),
z AS (SELECT c, count(*) AS n FROM m GROUP BY c),
o AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM m x JOIN m y ON x.s = y.s AND x.c < y.c GROUP BY x.c, y.c HAVING count(*) >= 30)"""

ORACLE = {
    "p1_found": f"""WITH {_REC.format('')}
SELECT a AS src_a, b AS src_b FROM p, n, f u, f v WHERE u.s = a AND v.s = b AND p.k * total >= 8 * u.k * v.k""",
    "p1_listed_pairs": f"""WITH v0 AS (SELECT DISTINCT {_KNOWN.format('__id')} AS s FROM vertices), {_REC.format(' AND s IN (SELECT s FROM v0 WHERE s IS NOT NULL)')}
SELECT a AS item_a, b AS item_b, u.k AS n_a, v.k AS n_b, p.k AS n_ab, total AS n_records,
  CAST(p.k AS DOUBLE) / u.k * total / v.k AS lift FROM p, n, f u, f v WHERE u.s = a AND v.s = b""",
    "p4_found": f"""WITH {_MEM}
SELECT a AS community_a, b AS community_b FROM o JOIN z x ON x.c = a JOIN z y ON y.c = b WHERE 4 * k >= least(x.n, y.n)""",
    "p5_found": f"""WITH u AS (SELECT {_NAME.format('community')} AS c, CAST(mindate AS DATE) AS d, s FROM (
    SELECT community, mindate, {_KNOWN.format('__src_id')} AS s FROM edges UNION ALL SELECT community, mindate, {_KNOWN.format('__dst_id')} FROM edges) WHERE s IS NOT NULL),
q AS (SELECT size_id, {_NAME.format('subreddit_name')} AS a, {_NAME.format('with_subreddit')} AS b, size_day AS dd, num_users AS m FROM reddit_comm_sizes WHERE num_users IS NOT NULL),
r AS (
  SELECT size_id, m, (SELECT count(DISTINCT s) FROM u WHERE u.c IN (q.a, q.b)) AS d FROM q WHERE a IS NOT NULL AND dd IS NULL UNION ALL
  SELECT size_id, m, (SELECT count(DISTINCT s) FROM u WHERE u.c IN (q.a, q.b) AND u.d = q.dd) FROM q WHERE a IS NOT NULL AND dd IS NOT NULL UNION ALL
  SELECT size_id, m, (SELECT count(DISTINCT s) FROM u WHERE u.d = q.dd) FROM q WHERE a IS NULL AND dd IS NOT NULL UNION ALL
  SELECT size_id, m, (SELECT count(DISTINCT s) FROM u) FROM q WHERE a IS NULL AND dd IS NULL)
SELECT size_id FROM r WHERE abs(m - d) * 100 > 15 * d""",
}
