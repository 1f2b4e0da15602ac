"""Mixing sources to target weights with nested hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD, stored

BITS, LEVELS = 12, 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(key: Column, text: Column) -> Column:
    """A document's place in its source's fixed order: 60 bits of a digest of its id and text."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The rank of a source comes from range partitions and their row counts, so no task holds all sources; the level at
    which the capped sources release their excess is found from two sums a round.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = stored(
        per.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    nth = (F.col("n") + place - 1) % len(weights)
    ranked = stored(
        cut.join(offset, "part").select(
            "source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (nth + 1).cast("int")).alias("weight")),
        "sources")
    cap = F.col("source_size") * most
    level, full = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > cap
        total, released, open_weight, n_full = ranked.agg(
            F.sum("source_size"), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))),
            F.count(F.when(above, 1))).first()
        if not total or n_full == full or not open_weight:
            break
        full, level = n_full, (total - released) / open_weight
    share = F.lit(level) * F.col("weight")
    return ranked.select("source", "source_size", F.when(share > cap, cap.cast("double")).otherwise(share).alias("target"))


def cuts(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target, each, cut): a document is taken ``each`` times, and once more if its place is at most ``cut``."""
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stored(
        source_targets(sized, weights, most).withColumn("each", each)
        .withColumn("rest", F.col("target") - F.col("each") * F.col("source_size")), "targets")
    edge = targets.select("source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    for n in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - n)
        bars = sized.alias("d").join(
            edge.alias("e"), F.expr(f"d.source <=> e.source AND shiftright(d.place, {shift + BITS}) = e.bucket"))
        bars = bars.groupBy(F.col("d.source").alias("source"), F.expr(f"shiftright(d.place, {shift})").alias("bucket")).agg(
            F.sum("d.size").alias("size"), F.first("e.rest").alias("rest"), F.first("e.before").alias("before"))
        upto = Window.partitionBy("source").orderBy("bucket")
        bars = bars.withColumn("upto", F.col("before") + F.sum("size").over(upto))
        edge = bars.filter("upto > rest").groupBy("source").agg(
            F.min(F.struct("bucket", "upto", "size", "rest")).alias("m")).select(
            "source", "m.rest", "m.bucket", (F.col("m.upto") - F.col("m.size")).alias("before"), "m.upto")
    nearer = F.col("before") + F.col("upto") <= 2 * F.col("rest")
    edge = edge.select("source", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("cut"))
    # a stored table has a known size, so that a small one is sent to the documents and not they to it
    return stored(targets.alias("t").join(edge.alias("c"), F.expr("t.source <=> c.source"), "left").select(
        "t.source", "source_size", "target", "each", F.when(F.col("each") < most, F.col("cut")).alias("cut")), "cuts")


def _copies(place: Column) -> Column:
    return (F.col("p.each") + F.when(place <= F.col("p.cut"), 1).otherwise(0)).cast("int")


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return stored(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
                    place_of(F.col(key), F.col(text)).alias("place")), "sizes")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, key: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """How often each document enters the mix.

    Returns ``key``, ``source``, ``place``, ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to ``most``), a row per
    input row.  A source gives each document ``floor(target / source_size)`` times, and once more those whose place in a
    fixed hash order lies below a threshold.  The threshold comes from word sums by source and hash bucket: buckets wholly
    under the remaining budget are in, and only the bucket at the boundary is split again, down to one hash value, which is
    in if that brings the sum nearer to the budget.  No step sorts documents.

    Edge cases: null and empty texts have size 0 and take nothing from a budget; null is a source of its own, the last;
    rows that repeat an id (null too) have places of their own unless their texts are equal, then they go in or out together; an empty table gives an empty result; columns other
    than the three named are not looked at.
    """
    sized = sizes(docs, key, text, source)
    plan = cuts(sized, weights, most)
    return sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select(
        "d.key", "d.source", "place", "size", "source_size", "target", _copies(F.col("d.place")).alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, key: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """The documents of the mix with their own columns, every row as often as ``mix`` takes it.

    The texts are not shuffled: a row's copies follow from its own place and its source's threshold.
    """
    plan = cuts(sizes(docs, key, text, source), weights, most)
    rows = docs.select(F.struct("*").alias("row"))
    taken = rows.join(plan.alias("p"), F.expr(f"row.`{source}` <=> p.source"))
    copies = F.array_repeat(F.lit(0), _copies(place_of(F.col(f"row.`{key}`"), F.col(f"row.`{text}`"))))
    return taken.select("row", F.explode(copies)).select("row.*")
