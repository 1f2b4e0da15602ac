"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.readers import stored

#: ASCII white space; words are what lies between.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Have Python workers get their rows in batches that are small in bytes too, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return what a Python worker has freed to the system; without this a worker that is used again keeps its largest size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: larger arrays are mapped by themselves and go when they are freed
        libc.malloc_trim(0)


def lean(batches: Iterator) -> Iterator:
    """The batches of a Python worker, which starts and ends without memory that earlier work has left."""
    give_back()
    yield from batches
    give_back()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it refers to it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: No piece of a hot key has more than one in so many of all rows, and no more keys than that are hot.
PIECES = 4096


def hot_join(rows: DataFrame, counts: DataFrame, keys: list[str], by: list[str], how: str = "inner", hot_of: DataFrame | None = None) -> DataFrame:
    """Join of ``rows`` with ``counts``, a stored table with a row a key and its number of rows in ``n``.

    A key that has more than one in ``PIECES`` of all rows is dealt out by a hash of the columns ``by``, and its row of
    ``counts`` is repeated for every piece.  There are fewer than ``PIECES`` such keys whatever the data, and only their list
    is sent to all tasks.  ``hot_of`` is the table to find them in, if ``counts`` is a part of one without ``n``.
    """
    whole = counts if hot_of is None else hot_of
    total = whole.agg(F.sum("n")).first()[0] or 1
    hot = whole.filter(F.col("n") * PIECES > total).select(*keys, F.ceil(F.col("n") * PIECES / total).cast("int").alias("_pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_pieces")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_piece", piece).drop("_pieces")
    every = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    spread = counts.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.explode(every)).drop("_pieces")
    return dealt.join(spread, [*keys, "_piece"], how).drop("_piece")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that links reach, for every node of ``edges``.

    Alternating large-star and small-star rounds.  Each round is two group-bys; its edges go to shared storage, so a lost
    executor costs at most one round.  A star's centre is found by ``min``, never by collecting its neighbours.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # every neighbour above a node points to the least node next to it
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "edges")
        # every neighbour below a node, and the node, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = seen
