"""How many items every two sets share, where a few items are in very many sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kithloom.operators.order import numbered
from kithloom.session import cut

#: An item of more sets than this isn't paired set by set.
HOT = 64
#: Sets of a block when such items are counted; two blocks are paired at a time.
BLOCK = 256


def set_words(members: DataFrame, common: DataFrame) -> DataFrame:
    """(g, w, bits): the items of ``common`` (x, d: in how many sets) as bits of 64-bit words of each set, the commonest first; from distinct (g, x)."""
    places = numbered(common.select("x", (-F.col("d")).alias("d")), ["d", "x"], "at").select("x", F.col("at").cast("long"))
    return (
        members.join(places, "x")
        .select("g", F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bits"))
        .groupBy("g", "w")
        .agg(F.bit_or("bits").alias("bits"))
    )


def shared_counts(members: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b, n_shared) of every pair of sets with a common item, a < b, all exact; from distinct (g, x).

    Items of at most ``hot`` sets give their pairs of sets one by one. The others are numbered, the commonest first, and are bits
    of 64-bit words of each set: two sets share as many of them as their words have common bits, so 64 such items cost a pair of
    sets one row. Sets are paired block by block, so no group holds more than two blocks.
    """
    degree = cut(members.groupBy("x").agg(F.count("*").alias("d")).where("d > 1"))
    listed = members.join(degree.where(F.col("d") <= hot), "x").groupBy("x").agg(F.sort_array(F.collect_list("g")).alias("s"))
    each = F.transform("s", lambda p, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda q: F.struct(p.alias("a"), q.alias("b"))))
    cold = listed.select(F.explode(F.flatten(each)).alias("e")).select("e.a", "e.b").groupBy("a", "b").agg(F.count("*").alias("k"))
    common = degree.where(F.col("d") > hot)
    if common.isEmpty():
        return cold.withColumnRenamed("k", "n_shared")

    words = set_words(members, common.select("x", "d"))
    words = cut(words)
    blocks = words.groupBy("w").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = words.join(blocks, "w").withColumn("c", F.pmod(F.xxhash64("g"), "blocks"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = placed.withColumn("o", F.explode(F.sequence("c", F.col("blocks") - 1))).select("w", F.col("c").alias("i"), F.col("o").alias("j"), "g", "bits")
    right = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), "c"))).select(
        "w", F.col("o").alias("i"), F.col("c").alias("j"), F.col("g").alias("g2"), F.col("bits").alias("bits2")
    )
    both = F.bit_count(F.col("bits").bitwiseAND(F.col("bits2"))).cast("long")
    met = left.repartition(parts, "w", "i", "j").join(right.repartition(parts, "w", "i", "j"), ["w", "i", "j"]).where("(i < j OR g < g2) AND bits & bits2 <> 0")
    warm = met.select(F.least("g", "g2").alias("a"), F.greatest("g", "g2").alias("b"), both.alias("k"))
    return cold.unionByName(warm).groupBy("a", "b").agg(F.sum("k").alias("n_shared"))
