"""Per-key processing where a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch, their rows are handled beside a broadcast of the
(at most 2 / share) heavy keys and spread over all tasks, the remaining keys go through an ordinary shuffle, and
the two results are united.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kithloom.session import cut

#: Counters of the frequent-items sketch; its error is below 3.5 / SKETCH_COUNTERS of the rows.
SKETCH_COUNTERS = 8192
#: A key with at least this share of the rows is processed as heavy.
HEAVY_SHARE = 0.01
#: Tasks' sketches are combined in so many groups first, and then those of the groups.
GROUPS = 1024
#: Rows of a table that lookup_join broadcasts.
LOOKUP_ROWS = 200_000
#: Stands for a key of several columns.
TAG = "__kl_key"


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _mark(key: str | Sequence[str]) -> Column:
    """A key as one value, null if any part is null; keys of several columns that share a hash are heavy or not together."""
    names = _names(key)
    if len(names) == 1:
        return F.col(names[0])
    return F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in names]), F.xxhash64(*names))


def heavy_keys(df: DataFrame, key: str | Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """The values of ``key`` that may hold ``share`` of the non-null rows: one column ``key``, at most 2 / share rows.

    Every value with at least ``share`` is among them, as the sketch's error stays below half of ``share``; an empty
    table gives none, nulls are no value. ``share`` must be 0.001 or more, which keeps the result small enough to broadcast.
    Of a key of several columns the hashes of its values come out, as the column TAG. Sketches are combined in two steps, so the
    last task gets GROUPS of them and not one from each task.
    """
    if not 0.001 <= share <= 1:
        raise ValueError("share must lie between 0.001 and 1")
    most, name = int(2 / share), _names(key)[0] if len(_names(key)) == 1 else TAG
    by_group = (
        df.select(_mark(key).alias("k"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(k, {SKETCH_COUNTERS})").alias("s"), F.count("k").alias("n"))
    )
    found = by_group.groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {SKETCH_COUNTERS}), {most})").alias("top"), F.sum("n").alias("n"))
    return (
        found.select("n", F.explode("top").alias("t"))
        .where(F.col("t.item").isNotNull() & (F.col("t.count") >= share / 2 * F.col("n")))
        .select(F.col("t.item").alias(name))
    )


def split_heavy(df: DataFrame, key: str | Sequence[str], share: float = HEAVY_SHARE) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, all other rows). The second part holds the rows whose key is null."""
    names = _names(key)
    # cut: at most 2 / share rows, which both parts read; else each would sketch all rows
    found = F.broadcast(cut(heavy_keys(df, key, share)))
    if len(names) == 1:
        return df.join(found, names, "left_semi"), df.join(found, names, "left_anti")
    tagged = df.withColumn(TAG, _mark(key))
    return tagged.join(found, TAG, "left_semi").drop(TAG), tagged.join(found, TAG, "left_anti").drop(TAG)


def key_counts(df: DataFrame, key: str | Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """(key, n_rows) for every key of one or several columns, null included as a key of its own.

    Heavy keys: counted per task beside the broadcast, so only one small row per task and key is shuffled.
    """
    names = _names(key)
    heavy, rest = split_heavy(df.select(*names), key, share)
    return heavy.groupBy(*names).agg(F.count("*").alias("n_rows")).unionByName(rest.groupBy(*names).agg(F.count("*").alias("n_rows")))


def key_profile(
    df: DataFrame, key: str | Sequence[str], distinct: Sequence[str] = (), measures: Sequence[Column] = (), share: float = HEAVY_SHARE
) -> DataFrame:
    """(key, n_rows, n_<column> for each of ``distinct``, the aliased decomposable ``measures``) for every key of one or several columns.

    Exact distinct counts can't be combined on the map side by key alone. For heavy keys the (key, value) pairs are
    spread over all tasks by both columns and counted per task; for the other keys Spark's own two-phase plan serves.
    Null is a key of its own and no value. ``measures`` must be min, max, count or sum expressions.
    """
    names = _names(key)
    if set(names) & set(distinct):
        raise ValueError("a key can't be counted within itself")
    heavy, rest = split_heavy(df, key, share)
    plain = [F.count("*").alias("n_rows"), *measures]
    counts = [F.count_distinct(F.col(c)).alias(f"n_{c}") for c in distinct]
    light = rest.groupBy(*names).agg(*plain, *counts)
    parts = [heavy.groupBy(*names).agg(*plain)]
    for c in distinct:
        pairs = heavy.select(*names, c).where(F.col(c).isNotNull()).distinct()
        parts.append(pairs.groupBy(*names).agg(F.count("*").alias(f"n_{c}")))
    joined = reduce(lambda a, b: a.join(b, names, "left"), parts)
    if distinct:
        joined = joined.fillna(0, subset=[f"n_{c}" for c in distinct])
    return joined.select(light.columns).unionByName(light)


def skew_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 32, share: float = HEAVY_SHARE
) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, where a few key values may hold most rows of ``left``.

    Rows of heavy values are spread over ``salts`` partitions, and the rows of ``right`` with these values (alone) are
    repeated for each salt; the other rows meet in an ordinary join. ``how`` is inner, left, left_semi or left_anti.
    Null keys match nothing. Other columns of the same name in both tables aren't allowed.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how} isn't supported")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    tag, salt = TAG, "__kl_salt"
    # a hash also of a single key: concat_ws would skip nulls and mix up ("a", null) with (null, "a")
    mark = F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), F.xxhash64(*keys))
    a, b = left.withColumn(tag, mark), right.withColumn(tag, mark)
    hot = F.broadcast(cut(heavy_keys(a, tag, share)))
    on = [*keys, tag, salt]
    rows = F.monotonically_increasing_id() % F.lit(salts)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    heavy = a.join(hot, tag, "left_semi").withColumn(salt, rows).join(b.join(hot, tag, "left_semi").withColumn(salt, each), on, how)
    light = a.join(hot, tag, "left_anti").join(b.join(hot, tag, "left_anti"), [*keys, tag], how)
    return heavy.drop(tag, salt).unionByName(light.drop(tag))


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", most: int = LOOKUP_ROWS) -> DataFrame:
    """``left`` joined to a table that is mostly short: broadcast if it has at most ``most`` rows, by count; else skew_join.

    ``right`` is read for the count, so it should be a kept table.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), list(keys), how)
    return skew_join(left, right, keys, how)
