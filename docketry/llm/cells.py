"""Comparison of the rows that share a bucket: large buckets are dealt into cells, sorted cells are streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import components, lean

#: Rows of a bucket that are compared with each other in one cell.
BUCKET = 128


def cells(leaves: DataFrame, most: int = BUCKET) -> DataFrame:
    """(idx, run, cell, side, cross) from (idx, run, leaf, n): a leaf as it is, or the pairs of parts of one that is large.

    A large leaf is dealt into parts by a hash; two parts meet in one cell, where only pairs across them are compared.
    """
    parts = F.ceil(F.col("n") / most).cast("int")
    mine = F.pmod(F.xxhash64("idx", "leaf"), parts).cast("int")
    split = leaves.withColumn("parts", parts).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    cell = F.when(F.col("parts") == 1, F.col("leaf")).otherwise(F.xxhash64("leaf", lo, hi))
    return split.select("idx", "run", cell.alias("cell"), F.col("mine").alias("side"), (F.col("mine") != F.col("other")).alias("cross"))


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``cell`` as tables that hold every cell whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
        if cut or (held and held[-1].column("cell")[-1].as_py() != cell[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def neighbours(cell: np.ndarray, side: np.ndarray, cross: np.ndarray, step: int = 65536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the rows to compare: all rows of a cell against the row k places on, for one k after another."""
    where, k = np.arange(len(cell)), 0
    while True:
        k += 1
        where = where[where + k < len(cell)]
        where = where[cell[where] == cell[where + k]]
        if not len(where):
            return
        for i in np.array_split(where, len(where) // step + 1):
            j = i + k
            ok = ~cross[i] | (side[i] != side[j])
            yield i[ok], j[ok]


def in_cells(members: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on tables of whole cells; cells are spread by hash and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(lean(batches)):
            yield from work(table).to_batches()

    return members.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, schema)


LINKED = "idx long, root long, others long"


def linked(idx: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """(idx, root, others) for the rows that the links (i, j) touch.

    ``others`` is the number of documents a row links to (sizes of the classes it links to), ``root`` the least idx that
    these links reach; so a group of n rows gives n rows, not its n * n / 2 links.
    """
    others = np.bincount(i, size[j], len(idx)) + np.bincount(j, size[i], len(idx))
    root = idx.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    at = np.flatnonzero(others)
    return pa.table({"idx": pa.array(idx[at], pa.int64()), "root": pa.array(root[at], pa.int64()), "others": pa.array(others[at].astype(np.int64))})


def resolved(links: DataFrame, members: DataFrame, classes: DataFrame, every: DataFrame) -> DataFrame:
    """(key, class_id, n_links) of all keys in ``every`` from the links of classes.

    ``links``: idx, root, others.  ``members``: key, idx.  ``classes``: idx, first (least key), size (keys).
    """
    first = classes.select("idx", "first")
    total = links.groupBy("idx").agg(F.sum("others").alias("others"))
    edges = links.filter("idx <> root").select("idx", "root").distinct()
    edges = edges.join(first, "idx").select("root", F.col("first").alias("u")).join(
        first.select(F.col("idx").alias("root"), F.col("first").alias("v")), "root")
    root = components(edges, "u", "v")
    placed = classes.join(total, "idx", "left").join(root, F.col("first") == F.col("node"), "left").select(
        "idx", F.coalesce("root", "first").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    placed = members.join(placed, "idx").groupBy("key").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
    return every.select("key").filter("key IS NOT NULL").distinct().join(placed, "key", "left").select(
        "key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def matrix(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """Equally long binaries as the rows of a matrix."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(len(table), -1)
