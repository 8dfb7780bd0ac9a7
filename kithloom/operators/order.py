"""Global numbering, ranks, running totals and top-k that no single task has to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from kithloom.session import cut, keep

#: A top-k of at most so many rows is merged by one task; a larger one is numbered.
TOP_IN_ONE_TASK = 100_000


def numbered(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """df with ``name`` = 1, 2, ... in the order of the columns ``order``, which must make rows distinct.

    Rows are range-partitioned, sorted and numbered per partition; the partitions' sizes (one row each) give the offsets.
    """
    local = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    kept = keep(local, "numbered")
    counts = kept.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__pid", F.coalesce(before, F.lit(0)).alias("__before"))
    return kept.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__pid", "__at", "__before")


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows in the order of these columns."""
    if k <= TOP_IN_ONE_TASK:
        return df.orderBy(*order).limit(k)
    return numbered(df, order, "__idx").where(F.col("__idx") <= k).drop("__idx")


def nth_smallest(df: DataFrame, column: str, n: int, most: int, buckets: int = 10_000) -> int:
    """The ``n``-th smallest of the distinct whole numbers 1..most in ``column``; counted by buckets, ever narrower, so rows stay where they are."""
    low, width = 1, most
    while width > buckets:
        step = -(-width // buckets)
        inside = df.where((F.col(column) >= low) & (F.col(column) < low + width))
        for at, k in sorted(tuple(r) for r in inside.groupBy(F.floor((F.col(column) - low) / step).alias("b")).count().collect()):
            if n <= k:
                low, width = low + at * step, step
                break
            n -= k
        else:
            raise ValueError("there are fewer rows")
    rest = df.where((F.col(column) >= low) & (F.col(column) < low + width)).select(column)
    return sorted(r[0] for r in rest.collect())[n - 1]


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with ``name`` = 1, 2, ... within each combination of the non-null columns ``group``, in the order of the columns ``order``, which must make its rows distinct.

    All rows are numbered together, so few groups of many rows aren't few tasks; a group's first number is taken off.
    """
    placed = numbered(df, [*group, *order], "__idx")
    first = placed.groupBy(*group).agg(F.min("__idx").alias("__first"))
    return placed.join(first, list(group)).withColumn(name, (F.col("__idx") - F.col("__first") + 1).cast("int")).drop("__idx", "__first")


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str = "hi", group: Sequence[str] = ()) -> DataFrame:
    """df with ``name``, the sum of ``value`` up to and including the row in the order of the columns ``order``, for each ``group`` if any.

    Rows are range-partitioned by group and order and added up per partition; what earlier partitions hold of a group is added.
    """
    kept = cut(df.repartitionByRange(*group, *order).withColumn("__pid", F.spark_partition_id()))
    parts = kept.groupBy("__pid", *group).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("__pid", *group, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("__inside", inside).join(carried, ["__pid", *group]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__pid", "__inside", "__before")
