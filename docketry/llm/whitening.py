"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import stored

COMPONENTS = 16
#: Vectors iterated besides the components wanted, and the degree of the filter.
GUARD = 8
DEGREE = 10
#: A residual is accepted below this share of the largest eigenvalue; rounds after which it must be.
TOLERANCE = 3e-14
ROUNDS = 100
#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, far from any embedding, count as not finite, so that whole numbers stay exact.
LARGEST = float(1 << 40)
ROWS = 4096


def scaled(vector: Column) -> Column:
    """Entries as whole numbers; null for a vector that is null, empty, or has a null or non-finite entry."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False))) & (F.size(vector) > 0)
    return F.when(good, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def summed(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``part`` of blocks of vectors (as rows of a matrix of whole numbers) over all of ``rows``.

    Every task adds up its own blocks to one matrix, and a group-by adds those of the tasks; one matrix comes to the driver.
    """
    i, j = (x.ravel() for x in np.indices(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = batch.slice(at, ROWS)
                total += part(block.column(0).flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for r in rows.select("x").mapInArrow(run, f"i long, j long, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``wanted`` largest eigenvalues, falling, of a symmetric positive operator of size ``d``.

    ``times`` applies the operator to the columns of a matrix, one pass over the data.  Every round takes the Rayleigh-Ritz
    values and vectors of the subspace, stops if the residuals of all wanted pairs certify them, and otherwise damps the
    spectrum from 0 to the smallest value of the subspace by a scaled Chebyshev polynomial, a pass a degree, before the next QR.
    """
    size = min(d, wanted + GUARD)
    q, _ = np.linalg.qr(np.random.default_rng(13).standard_normal((d, size)))
    least, waited = np.inf, 0
    for _ in range(ROUNDS):
        image = times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        off = float(np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        top = float(values[0])
        if top <= 0 or size == d or off <= TOLERANCE * top:
            break
        # rounding keeps the residual from falling further
        waited = waited + 1 if off > least / 2 else 0
        least = min(least, off)
        if waited == 3 and least <= 1e3 * TOLERANCE * top:
            break
        edge = max(float(values[-1]), 1e-12 * top)
        half = edge / 2
        sigma = first = half / (top - half)
        before, now = q, (image - half * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            after = 1.0 / (2.0 / first - sigma)
            before, now = now, (times(now) - half * now) * (2.0 * after / half) - sigma * after * before
            sigma = after
        q, _ = np.linalg.qr(now)
    else:
        raise RuntimeError(f"eigenvectors did not settle in {ROUNDS} rounds")
    vectors = q[:, :wanted]
    return values[:wanted], vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """The fit: n distinct vectors, their sums by dimension, unit eigenvectors (columns) and eigenvalues, largest first."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        """Share of each component in the variance."""
        return self.values / self.trace if self.trace else self.values

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off exactly, then the rest of less than one."""
        whole, rest = self.sums // self.n, self.sums % self.n
        return (x - whole) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2 in whole numbers; None where it exceeds a long."""
        whole, rest = self.sums // self.n, self.sums % self.n
        off = x - whole
        far = int(np.abs(off).max(initial=0)) + 1
        if (self.n * far) ** 2 * max(1, x.shape[1]) < 1 << 63:
            y = off * self.n - rest
            return (y * y).sum(1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest.tolist())) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening fitted to the distinct vectors ``x`` of ``rows`` (arrays of whole numbers of one length); None without rows."""
    every = stored(rows.select("x").distinct(), "distinct-vectors")
    first = every.first()
    if first is None:
        return None
    d = len(first["x"])
    counted = summed(every, (d, 2), lambda x: np.stack([x.sum(0), np.full(d, len(x))], 1), "long")
    out = Whitening(int(counted[0, 1]), counted[:, 0], np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = out.centred(x)
            return z.T @ (z @ q)

        return summed(every, q.shape, part) / out.n

    out.trace = float(summed(every, (1, 1), lambda x: (out.centred(x) ** 2).sum().reshape(1, 1))[0, 0]) / out.n
    if out.trace > 0:
        values, vectors = eigenpairs(times, d, min(components, d))
        there = values > d * np.finfo(float).eps * values[0]
        out.values, out.vectors = values[there], vectors[:, there]
        scale = out.vectors / np.sqrt(out.values)

        def spread(x: np.ndarray) -> np.ndarray:
            w = out.centred(x) @ scale
            return w.T @ w

        k = len(out.values)
        out.identity_error = float(np.abs(summed(every, (k, k), spread) / out.n - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """((key, deviation, whitened), fit): every vector on the leading components of the covariance, each scaled to variance one.

    Entries become whole numbers first (``scaled``); the fit covers each distinct vector once.  Sums and products with the
    centred vectors are passes over a stored table in which every task adds up its own rows, so neither a vector list nor a
    matrix larger than dimensions x components leaves the tasks.

    Edge cases: vectors that are null, empty or hold null or non-finite entries are left out, and so are those whose length
    is not the most frequent one (of several the largest); rows that repeat a key or vector, and those without a key, are
    whitened each by itself; directions without variance give no component, so vectors that are all equal get empty arrays;
    a deviation beyond a long is null; of equal eigenvalues any basis is taken; an empty table gives no rows and no fit;
    other columns are not looked at.
    """
    rows = vectors.select(F.col(key).alias("key"), scaled(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is not None:
        rows = rows.filter(F.size("x") == lengths["d"])
    made = fit(rows, components) if lengths is not None else None

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scale = made.vectors / np.sqrt(made.values)
        for s in batches:
            x = np.stack(s.to_list()) if len(s) else np.zeros((0, len(scale)), np.int64)
            yield pd.DataFrame({"deviation": pd.array(made.deviations(x), "Int64"), "whitened": list(made.centred(x) @ scale)})

    if made is None:
        return rows.select(F.col("key").alias(key), F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    return rows.withColumn("_p", project("x")).select(F.col("key").alias(key), "_p.deviation", "_p.whitened"), made
