"""Jaccard self-join of shingle sets by chosen paths: split on sampled tokens, compare small buckets, repeat."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.cells import BUCKET, LINKED, cells, column, in_cells, linked, matrix, neighbours, resolved
from docketry.llm.common import hot_join, lean, stored
from docketry.llm.hashing import Powers, chunks, mixed, shingle_sets

SIZE = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that the runs must meet, and how often a run may split.
TARGET = 0.99999
DEPTH = 3
#: One-byte minhash lanes for a first estimate; five standard errors below the threshold are let through.
LANES = 128


def runs_needed(threshold: float = THRESHOLD, depth: int = DEPTH, target: float = TARGET) -> int:
    """A pair at the threshold takes the same way through ``depth`` splits of one run with probability threshold ** depth."""
    return math.ceil(math.log(1 - target) / math.log(1 - threshold ** depth))


def summaries(text: Column, size: int, n_tokens: int) -> Column:
    """struct of ``n`` (shingles), ``h1`` and ``h2`` (hash of the set), ``tokens`` (minhashes to split on) and ``lanes`` for each text."""
    n_all = max(LANES, n_tokens)

    @F.pandas_udf("n int, h1 long, h2 long, tokens array<int>, lanes binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(11)
        scale = rng.integers(0, 1 << 32, n_all, dtype=np.uint32) | np.uint32(1)
        shift = rng.integers(0, 1 << 32, n_all, dtype=np.uint32)
        powers = Powers()
        for s in lean(batches):
            n, h1, h2, tokens, lanes = [], [], [], [], []
            for _, part in chunks(s.fillna("").tolist(), 1 << 18):
                sets = shingle_sets(part, size, powers)
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                every = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
                at = (np.cumsum(sizes) - sizes)[full]
                sums = np.zeros((2, len(sets)), np.uint64)
                least = np.zeros((len(sets), n_all), np.uint32)
                if len(full):
                    sums[0, full] = np.add.reduceat(mixed(every, 3), at)
                    sums[1, full] = np.add.reduceat(mixed(every, 4), at)
                    low = (every >> np.uint64(32)).astype(np.uint32)
                    for j in range(n_all):
                        least[full, j] = np.minimum.reduceat(low * scale[j] + shift[j], at)
                n += sizes.tolist()
                h1 += sums[0].astype(np.int64).tolist()
                h2 += sums[1].astype(np.int64).tolist()
                tokens += list(least[:, :n_tokens].astype(np.int32))
                lanes += [x.tobytes() for x in (least[:, :LANES] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)]
            yield pd.DataFrame({"n": n, "h1": h1, "h2": h2, "tokens": tokens, "lanes": lanes})

    return udf(text)


def buckets(sets: DataFrame, runs: int, depth: int = DEPTH, most: int = BUCKET) -> DataFrame:
    """(idx, run, leaf, n): the bucket of two or more sets in which each run ends for a set, if any.

    A bucket of at most ``most`` sets is a leaf; a larger one is split on the next sampled token, until ``depth``.  The rows of
    a very large bucket are dealt over many tasks on the way.
    """
    keys, key = [], F.col("run").cast("long")
    for d in range(depth):
        key = F.xxhash64(key, F.get("tokens", F.col("run") * depth + d))
        keys.append(key.alias(f"k{d}"))
    rows = sets.select("idx", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("idx", "run", *keys)
    found = None
    for d in range(depth):
        sizes = stored(rows.groupBy(f"k{d}").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes-{d}")
        level = stored(hot_join(rows, sizes, [f"k{d}"], ["idx", "run"]), f"split-{d}")
        leaf = level if d == depth - 1 else level.filter(F.col("n") <= most)
        leaf = leaf.select("idx", "run", F.col(f"k{d}").alias("leaf"), "n")
        found = leaf if found is None else found.unionByName(leaf)
        rows = level.filter(F.col("n") > most).drop("n", f"k{d}")
    return found


MEMBER = "idx long, run int, cell long, side int, cross boolean, ways binary"


def likely(members: DataFrame, threshold: float) -> DataFrame:
    """The rows (idx, run, cell, side, cross, ways) whose lanes agree enough with those of another row of their cell, one that no
    earlier run brought together with it.

    ``members`` has lanes besides; ``ways`` holds a set's bucket of each run.
    """
    least = math.floor(LANES * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / LANES)))

    def work(table: pa.Table) -> pa.Table:
        cell, run = column(table, "cell"), column(table, "run")
        lanes, ways = matrix(table, "lanes", np.uint8), matrix(table, "ways", np.int32)
        near = np.zeros(len(cell), bool)
        for i, j in neighbours(cell, column(table, "side"), column(table, "cross")):
            ok = (lanes[i] == lanes[j]).sum(1) >= least
            i, j = i[ok], j[ok]
            ok = first_way(ways, i, j) == run[i]
            near[i[ok]] = near[j[ok]] = True
        return table.drop_columns(["lanes"]).filter(pa.array(near))

    return in_cells(members.select("idx", "run", "cell", "side", "cross", "ways", "lanes"), work, MEMBER)


def first_way(ways: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first run that brings rows i and j together."""
    return ((ways[i] == ways[j]) & (ways[i] != 0)).argmax(1)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a cell, from the incidence of the tokens that two or more of them hold."""
    n = len(sets)
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    keep = np.bincount(where) > 1
    place = np.cumsum(keep) - 1
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    ok = keep[where]
    row, column_ = row[ok], place[where[ok]]
    out, width = np.zeros((n, n)), max(1, min(1 << 14, int(keep.sum())))
    order = np.argsort(column_, kind="stable")
    row, column_ = row[order], column_[order]
    for at in range(0, int(keep.sum()), width):
        a, z = np.searchsorted(column_, (at, at + width))
        part = np.zeros((n, width), np.float32)
        part[row[a:z], column_[a:z] - at] = 1
        out += part @ part.T
    return out


def verified(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """(idx, root, others) of the links at the threshold or above, by the whole shingle sets of the texts in a cell."""

    def work(table: pa.Table) -> pa.Table:
        powers, texts, sets = Powers(), table.column("text").to_pylist(), []
        for _, part in chunks(texts):
            sets += shingle_sets(part, size, powers)
        cell, idx, run, many = (column(table, n) for n in ("cell", "idx", "run", "size"))
        side, cross, ways = column(table, "side"), column(table, "cross"), matrix(table, "ways", np.int32)
        own = np.array([[mixed(x, k).sum(dtype=np.uint64) for k in (3, 4)] for x in sets], np.uint64).astype(np.int64)
        # the texts of a key that has several, and repeated rows, are told apart by the hash of the set
        good = np.flatnonzero((own[:, 0] == column(table, "h1")) & (own[:, 1] == column(table, "h2")))
        _, once = np.unique(np.stack([cell[good], idx[good]]), axis=1, return_index=True)
        good = np.sort(good[once])
        left, right = [], []
        for at in np.split(good, np.flatnonzero(np.diff(cell[good])) + 1):
            if len(at) < 2:
                continue
            mine = [sets[k] for k in at]
            both = shared_counts(mine)
            n = np.array([len(x) for x in mine])
            i, j = np.nonzero(np.triu(both / (n[:, None] + n[None] - both) >= threshold, 1))
            i, j = at[i], at[j]
            ok = (~cross[i] | (side[i] != side[j])) & (first_way(ways, i, j) == run[i])
            left.append(i[ok])
            right.append(j[ok])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return linked(idx, many, cat(left), cat(right))

    return in_cells(rows, work, LINKED)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
         target: float = TARGET) -> DataFrame:
    """(key, class_id, n_links): for each key the least key that links reach, and how many other documents it links to directly.

    Two documents link if the Jaccard similarity of their sets of ``size``-word shingles (words between ASCII white space,
    case kept) is ``threshold`` or more.  Equal sets are joined once as a class and counted with their number.  Runs of
    random splits bring a pair at the threshold together with probability ``target``.  In a cell, rows with a likely
    partner by their sketches are kept; their whole sets then decide.  A bucket that stays large is compared in full, part
    against part.  What leaves a cell is a row a set, with its links counted, however many links there are.

    Edge cases: a text of fewer words than ``size`` has one shingle of all of them; null and empty texts have none and link
    with nothing; rows without a key are left out; rows that repeat a key count once; an empty table gives no rows; columns
    other than the two named are not looked at.
    """
    runs = runs_needed(threshold, DEPTH, target)
    seen = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), summaries(F.col(text), size, runs * DEPTH).alias("s"))
    seen = stored(seen.select("key", "s.*"), "sets").filter("n > 0")
    classes = seen.groupBy("h1", "h2").agg(
        F.min("key").alias("first"), F.count_distinct("key").alias("size")).withColumn("idx", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    members = seen.select("key", "h1", "h2").join(classes.select("h1", "h2", "idx"), ["h1", "h2"]).select("key", "idx").distinct()
    one = seen.join(classes.select("h1", "h2", "idx", "first"), ["h1", "h2"]).filter("key = first")
    one = one.groupBy("idx").agg(F.first("tokens").alias("tokens"), F.first("lanes").alias("lanes"))
    sets = stored(one, "representatives")

    leaves = stored(buckets(sets, runs), "leaves")
    short = F.hash("leaf")
    short = F.when(short == 0, 1).otherwise(short)
    ways = leaves.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("run", short.alias("way")))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.right(
        F.concat(F.lit("0000000"), F.hex(F.coalesce(F.col("m")[r], F.lit(0)))), F.lit(8)))
    ways = ways.select("idx", F.unhex(F.array_join(digits, "")).alias("ways"))
    known = sets.select("idx", "lanes").join(ways, "idx")
    compared = cells(leaves).select("idx", "run", "cell", "side", "cross").join(known, "idx")
    near = stored(likely(compared, threshold), "likely")

    named = near.join(classes.select("idx", "h1", "h2", "first", "size"), "idx")
    whole = docs.select(F.col(key).alias("first"), F.col(text).alias("text")).filter("text IS NOT NULL")
    found = stored(verified(whole.join(named, "first").drop("first"), size, threshold), "links")
    return resolved(found, members, classes, docs.select(F.col(key).alias("key"))).withColumnRenamed("key", key)
