"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.cells import LINKED, cells, column, in_cells, linked, matrix, neighbours, resolved
from docketry.llm.common import hot_join, lean, stored

THRESHOLD = 0.93
#: Hashes a table and buckets probed a table; the number of tables follows from dimension and threshold.
HASHES, PROBES = 2, 4
NEXT = 3
#: Share of the pairs at the threshold that the tables must bring together, and pairs by which that is estimated.
TARGET = 0.99998
TRIALS = 4000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@lru_cache
def tables_needed(d: int, threshold: float, target: float = TARGET) -> int:
    """Tables that bring a pair of ``d`` dimensions at the threshold together with probability ``target``.

    How often one table does is measured on random pairs with just that cosine, always the same ones.
    """
    if d < 2 or threshold >= 1:
        return 1
    rng = np.random.default_rng(17)
    a, b = rng.standard_normal((2, TRIALS, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    low = max(threshold, -1.0)
    x, y = probes(a, 1)[:, 0], probes(low * a + np.sqrt(1 - low * low) * b, 1)[:, 0]
    met = (x[:, :, None] == y[:, None, :]).any((1, 2)).mean()
    return max(1, math.ceil(math.log(1 - target) / math.log(max(1 - met, 1e-9)))) if met else 1 << 10


def probes(x: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables, PROBES) bucket numbers: the nearest vertices of the cross-polytope, and the likeliest other choices.

    Each hash rotates by three rounds of random signs and a Hadamard transform; its choices are the coordinates of the
    largest magnitude with their signs, and a probe's cost is what it gives up in magnitude.
    """
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    rng = np.random.default_rng(5)
    ways = np.array(list(product(range(NEXT), repeat=HASHES)))
    out = np.empty((n, tables, PROBES), np.int64)
    for t in range(tables):
        cost, code = np.zeros((n, len(ways))), np.zeros((n, len(ways)), np.int64)
        for k in range(HASHES):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            y = np.concatenate([y, -y], 1)
            top = np.argsort(-y, 1, kind="stable")[:, :NEXT]
            high = np.take_along_axis(y, top, 1)
            cost += (high[:, :1] - high)[:, ways[:, k]]
            code = code * (2 * size) + top[:, ways[:, k]]
        best = np.argsort(cost, 1, kind="stable")[:, :PROBES]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def hashed(vector: Column, threshold: float) -> Column:
    """struct of ``raw`` (doubles) and ``codes`` (probes of all tables) of each vector."""

    @F.pandas_udf("raw binary, codes array<int>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in lean(batches):
            raw, codes = [b""] * len(s), [None] * len(s)
            by_length: dict[int, list[int]] = {}
            rows = [np.asarray(v, np.float64) for v in s]
            for i, v in enumerate(rows):
                by_length.setdefault(len(v), []).append(i)
            for at in by_length.values():
                for part in np.array_split(np.array(at), len(at) // 4096 + 1):
                    x = np.stack([rows[i] for i in part])
                    scale = np.abs(x).max(1, keepdims=True)
                    unit = x / scale
                    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                    for i, c in zip(part, probes(unit, tables_needed(x.shape[1], threshold)).reshape(len(x), -1).astype(np.int32)):
                        raw[i], codes[i] = rows[i].tobytes(), c
            yield pd.DataFrame({"raw": raw, "codes": codes})

    return udf(vector)


def close(members: DataFrame, threshold: float) -> DataFrame:
    """(idx, root, others) of the links with a cosine at the threshold or above, each counted at its first shared probe."""

    def work(table: pa.Table) -> pa.Table:
        cell, idx, run, many = (column(table, n) for n in ("cell", "idx", "run", "size"))
        side, cross = column(table, "side"), column(table, "cross")
        length = np.array([len(x) for x in table.column("raw").to_pylist()])
        left, right = [], []
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            own = table.take(at)
            x, ways = matrix(own, "raw", np.float64), matrix(own, "ways", np.int32).reshape(len(at), -1, PROBES)
            x = x / np.abs(x).max(1, keepdims=True)
            norm = np.sqrt((x * x).sum(1))
            for i, j in neighbours(cell[at], side[at], cross[at], 16384):
                ok = (x[i] * x[j]).sum(1) / (norm[i] * norm[j]) >= threshold
                i, j = i[ok], j[ok]
                flip = idx[at[i]] > idx[at[j]]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                # of the probes of the lower one, in order, the first that the other has in the same table too
                first = (ways[i][:, :, :, None] == ways[j][:, :, None, :]).any(3).reshape(len(i), ways.shape[1] * PROBES).argmax(1)
                ok = first == run[at[i]]
                left.append(at[i[ok]])
                right.append(at[j[ok]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return linked(idx, many, cat(left), cat(right))

    return in_cells(members, work, LINKED)


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept): vectors of equal label linked by a cosine of ``threshold`` or more.

    Every vector enters the buckets of its probes in each table; vectors that share one are compared in double precision.
    Equal vectors are compared once and counted with their number.  A bucket that is large is compared in full, part
    against part.

    Edge cases: null labels, null or zero vectors and ones with null or non-finite components link with nothing and are
    their own component; vectors of different length never link; rows that repeat a key and vector count once, rows
    without a key are left out; an empty table gives no rows; other columns are not looked at.
    """
    v = F.col("v")
    able = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(
        F.col("key").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0))
    able = able.select("key", "label", hashed(v, threshold).alias("h")).select("key", "label", "h.*")
    able = stored(able.withColumn("h1", F.xxhash64("raw")).withColumn("h2", F.xxhash64(F.lit(1), "raw")), "vectors")
    same = ["label", "h1", "h2"]
    classes = stored(
        able.groupBy(*same).agg(F.min("key").alias("first"), F.count_distinct("key").alias("size"))
        .withColumn("idx", F.monotonically_increasing_id()), "vector-classes")
    members = able.join(classes, same)
    one = stored(
        members.filter("key = first").groupBy("idx").agg(*[F.first(c).alias(c) for c in ("label", "raw", "codes")]), "distinct-vectors")

    place = one.select("idx", "label", F.octet_length("raw").alias("size"), F.posexplode("codes").alias("pos", "code"))
    run = F.floor(F.col("pos") / PROBES).cast("int")
    place = place.select("idx", (F.col("pos")).alias("pos"), run.alias("table"), F.xxhash64("label", "size", run, "code").alias("leaf"))
    sizes = stored(place.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    leaves = hot_join(place, sizes, ["leaf"], ["idx", "pos"]).select("idx", F.col("pos").alias("run"), "leaf", "n")
    ways = F.unhex(F.array_join(F.transform("codes", lambda c: F.right(F.concat(F.lit("0000000"), F.hex(c)), F.lit(8))), ""))
    known = one.select("idx", "raw", ways.alias("ways"))
    compared = cells(leaves).join(known, "idx").join(classes.select("idx", "size"), "idx")
    found = stored(close(compared, threshold), "vector-links")
    out = resolved(found, members.select("key", "idx").distinct(), classes, vectors.select(F.col(key).alias("key")))
    return out.select(
        F.col("key").alias(key), "n_links", F.col("class_id").alias("component_id"), (F.col("key") == F.col("class_id")).alias("kept"))
