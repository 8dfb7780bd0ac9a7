"""Items that appear together: exact pair counts over records of any size, with association scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kithloom.operators.skew import lookup_join
from kithloom.session import cut, keep

#: Items of one record that a task pairs with each other; larger records are cut into chunks of about this size.
CHUNK = 256


def _exact_product(a: Column, b: Column) -> Column:
    return a.cast("decimal(18,0)") * b.cast("decimal(18,0)")


def item_pairs(rows: DataFrame, record: Sequence[str], item: str, min_count: int = 1, min_lift: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items by the records that hold both: (item_a, item_b, n_a, n_b, n_ab, n_records, lift), item_a < item_b.

    ``record`` names the columns that together identify a record, ``item`` the column of its items. Rows with a null in
    any of them count for nothing, repeated items of a record count once, other columns are ignored, an empty table
    gives no pairs. n_records counts records with an item; lift = n_ab * n_records / (n_a * n_b). Out come all pairs with
    n_ab >= ``min_count`` and lift >= ``min_lift`` (a whole number, compared exactly).

    Before pairs are formed, items that can't be part of such a pair are left out: n_ab is at most the smaller of n_a
    and n_b, so both must reach min_count, and neither may exceed n_records / min_lift. Records with more than ``chunk``
    remaining items are cut into chunks by the items' hash; every pair of chunks is a task's worth of its own, so no
    group holds more than two chunks. Pairs of all groups are then counted together.
    """
    if min_count < 1 or not 0 <= min_lift <= 9999 or chunk < 2:
        raise ValueError("min_count must be 1 or more, min_lift 0 to 9999, chunk 2 or more")
    keys = [f"__r{i}" for i in range(len(record))]
    held = rows.select(*(F.col(c).alias(k) for c, k in zip(record, keys)), F.col(item).alias("__x")).dropna().distinct()
    held = keep(held, "items")
    total = held.groupBy(*keys).agg(F.lit(1).alias("one")).agg(F.count("*").alias("n")).scalar()
    useful = held.groupBy("__x").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_count)
    if min_lift:
        useful = useful.where(F.col("__n") * min_lift <= total)
    # an item may be in most records, a record may hold most rows: both joins are by broadcast where that is small, else with heavy keys spread
    kept = lookup_join(held, cut(useful), ["__x"])
    large = cut(kept.groupBy(*keys).agg(F.count("*").alias("__m")).where(F.col("__m") > chunk))
    chunks = F.coalesce(F.ceil(F.col("__m") / chunk), F.lit(1))
    placed = (
        lookup_join(kept, large, keys, "left")
        .withColumn("__k", chunks)
        .withColumn("__c", F.pmod(F.xxhash64("__x"), F.col("__k")))
        .select(*keys, F.struct("__x", "__n").alias("__v"), "__c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)).alias("__o"))
        .withColumn("__i", F.least("__c", "__o"))
        .withColumn("__j", F.greatest("__c", "__o"))
    )
    groups = placed.groupBy(*keys, "__i", "__j").agg(
        F.sort_array(F.collect_list(F.when(F.col("__c") == F.col("__i"), F.col("__v")))).alias("left"),
        F.collect_list(F.when((F.col("__c") == F.col("__j")) & (F.col("__i") < F.col("__j")), F.col("__v"))).alias("right"),
    )

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    inside = F.transform("left", lambda x, i: F.transform(F.slice("left", i + 2, F.size("left")), lambda y: pair(x, y)))
    across = F.transform("left", lambda x: F.transform("right", lambda y: pair(x, y)))
    pairs = groups.select(F.explode(F.flatten(F.when(F.col("__i") == F.col("__j"), inside).otherwise(across))).alias("p"))
    counted = (
        pairs.groupBy(F.col("p.a.__x").alias("item_a"), F.col("p.b.__x").alias("item_b"), F.col("p.a.__n").alias("n_a"), F.col("p.b.__n").alias("n_b"))
        .agg(F.count("*").alias("n_ab"))
        .where(F.col("n_ab") >= min_count)
        .withColumn("n_records", total)
    )
    if min_lift:
        floor = _exact_product(F.col("n_a"), F.col("n_b")) * F.lit(min_lift).cast("decimal(4,0)")
        counted = counted.where(_exact_product(F.col("n_ab"), F.col("n_records")) >= floor)
    double = {c: F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n_records")}
    return counted.withColumn("lift", double["n_ab"] / double["n_a"] * double["n_records"] / double["n_b"])
