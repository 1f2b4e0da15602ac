"""Packing documents into sequences by length patterns: non-negative least squares on the histogram, rounding, residuals."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import lean, stored
from docketry.llm.subwords import BytePairs, blocks

CAPACITY = 2048
#: The id that closes every document.
END = 0
#: Rounds in which columns enter the least-squares problem, and gradient steps in each.
ROUNDS, STEPS = 24, 120

#: A pattern: (length, how often) runs of documents in one sequence.
Runs = tuple[tuple[int, int], ...]


# --- the plan: everything here depends on the histogram of lengths alone ---------------------------------


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, falling and 0 where a pattern has fewer documents, that fill a sequence exactly."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    out = []
    for a in lengths[::-1].tolist():
        rest = capacity - a
        if 2 * a < rest:
            break
        b = np.arange(-(-rest // 2), min(a, rest) + 1)
        b = b[there[b] & there[rest - b]]
        out.append(np.stack([np.full(len(b), a), b, rest - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def repeats(histogram: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often each pattern should be used so that together they use up the histogram.

    A length's residual weighs as much as its tokens.  Columns enter an active set by their gradient, the best pattern of
    every longest length in a round; inside the set, accelerated projected gradient steps; columns at zero leave.
    """
    weight = np.arange(len(histogram), dtype=float) / (len(histogram) - 1)
    weight[0] = 0.0
    top = np.flatnonzero(np.diff(ways[:, 0], prepend=-1))
    active, x = np.zeros(0, np.int64), np.zeros(0)
    residual = histogram.astype(float)
    for _ in range(ROUNDS):
        gain = (weight * residual)[ways].sum(1)
        gain[active] = -1.0
        best = np.maximum.reduceat(gain, top)
        first = np.flatnonzero(gain == np.repeat(best, np.diff(top, append=len(ways))))
        first = first[np.unique(ways[first, 0], return_index=True)[1]]
        first = first[gain[first] > 0]
        if not len(first):
            break
        active, x = np.concatenate([active, first]), np.concatenate([x, np.zeros(len(first))])
        own = ways[active]
        used = np.bincount(own.ravel(), np.repeat((own > 0).sum(1), 3) * (own.ravel() > 0), len(histogram))
        step = 1.0 / max(1.0, float((np.sqrt(weight) * used).max()))
        look, speed = x.copy(), 1.0
        for _ in range(STEPS):
            residual = histogram - np.bincount(own.ravel(), np.repeat(look, 3), len(histogram))
            after = np.maximum(0.0, look + step * (weight * residual)[own].sum(1))
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            look, x, speed = after + (speed - 1) / faster * (after - x), after, faster
        keep = x > 1e-9
        active, x = active[keep], x[keep]
        residual = histogram - np.bincount(ways[active].ravel(), np.repeat(x, 3), len(histogram))
        residual[0] = 0.0
    out = np.zeros(len(ways))
    out[active] = x
    return out


def rounded(histogram: np.ndarray, ways: np.ndarray, wanted: np.ndarray) -> tuple[list[tuple[Runs, int]], np.ndarray]:
    """Whole numbers of repeats, largest first, none beyond what the histogram still has; and what is left of it."""
    left, out = histogram.copy(), []
    for k in np.argsort(-wanted, kind="stable")[: int((wanted >= 0.5).sum())].tolist():
        runs = tuple((int(a), int(n)) for a, n in zip(*np.unique(ways[k][ways[k] > 0], return_counts=True)))[::-1]
        n = min(int(wanted[k] + 0.5), *(int(left[a]) // m for a, m in runs))
        if n:
            out.append((runs, n))
            for a, m in runs:
                left[a] -= n * m
    return out, left


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[Runs, int]]:
    """Best-fit decreasing on counts: equal sequences are filled together, so the work depends on the lengths, not on their numbers."""
    room: dict[int, list[tuple[Runs, int]]] = {}
    spaces: list[int] = []
    done: list[tuple[Runs, int]] = []

    def put(space: int, runs: Runs, n: int) -> None:
        if not n:
            return
        if space == 0:
            done.append((runs, n))
            return
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((runs, n))

    for a in range(capacity, 0, -1):
        need = int(histogram[a])
        while need:
            at = bisect_left(spaces, a)
            if at == len(spaces):
                each = capacity // a
                put(capacity - each * a, ((a, each),), need // each)
                if need % each:
                    put(capacity - need % each * a, ((a, need % each),), 1)
                break
            space = spaces[at]
            runs, n = room[space].pop()
            if not room[space]:
                del room[space], spaces[at]
            each = space // a
            full = min(n, need // each)
            put(space - each * a, (*runs, (a, each)), full)
            need, n = need - full * each, n - full
            if n and need:  # fewer than fill one more
                put(space - need * a, (*runs, (a, need)), 1)
                need, n = 0, n - 1
            put(space, runs, n)
    return done + [g for groups in room.values() for g in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[Runs, int]]:
    """Patterns of lengths and how many sequences to make of each; they hold exactly the documents of the histogram."""
    ways = patterns(np.flatnonzero(histogram), capacity)
    made, left = rounded(histogram, ways, repeats(histogram, ways)) if len(ways) else ([], histogram)
    return made + best_fit(left, capacity)


class Slots:
    """Where the k-th piece of a length goes.  Its size depends on the capacity alone, not on the number of documents."""

    def __init__(self, made: list[tuple[Runs, int]], capacity: int):
        taken, rows, first = [0] * (capacity + 1), [], 0
        for runs, n in made:
            at = 0
            for a, m in runs:
                rows.append((a, taken[a], m, first, at))
                taken[a] += n * m
                at += a * m
            first += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.rank, self.many, self.first, self.at = table.T
        self.sequences = first
        self.key = (self.length << 44) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number within the length."""
        k = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        on = rank - self.rank[k]
        return self.first[k] + on // self.many[k], self.at[k] + on % self.many[k] * length


# --- Spark ------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids): the ids of each text and ``END``, cut into pieces where there are more than ``capacity``.

    All pieces but the first are ``capacity`` long.  ``ids`` are little-endian unsigned 32-bit integers.
    """
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BytePairs(path, plain=False)
        for batch in lean(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for at, part in blocks(texts):
                row, piece, start, length, ids = [], [], [], [], []
                for i, t in enumerate(part, at):
                    all_ids = np.append(model.encode(t), END).astype("<u4")
                    first = (len(all_ids) - 1) % capacity + 1
                    for k, a in enumerate([0, *range(first, len(all_ids), capacity)]):
                        own = all_ids[a:first if k == 0 else a + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(own))
                        ids.append(own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["key", "piece", "start", "length", "ids"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids binary")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         carry: Sequence[Column | str] = ("ids",)) -> DataFrame:
    """(key, piece, start, length, ..., sequence_id, offset): every document's token ids, in pieces, each with its place in a sequence.

    ``path`` is a vocabulary file of the tokenizers library that every executor has; ``carry`` are the columns to keep of a
    piece's ``ids``.  A sequence holds at most ``capacity`` ids, gapless from 0; its text is that of its pieces by offset.

    Pieces are counted by length, at most ``capacity`` numbers, which alone go to the driver.  There patterns of up to three
    lengths that fill a sequence are enumerated, their repeats fitted to the histogram by non-negative least squares and
    rounded, and the residual is packed best fit first, on counts.  A piece finds its place by its number among those of its
    length: the partitions' counts are added up, so no length meets in one task, even if a third of all pieces have it.

    Edge cases: null and empty texts have one id, ``END``; rows that repeat a key, also null, are documents of their own; an
    empty table gives no rows; other columns are not looked at.  A special token's string in a text becomes that token, as
    the library does by default.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    cut = pieces(docs, path, key, text, capacity).select("key", "piece", "start", "length", *carry)
    kept = [c for c in cut.columns if c not in ("key", "piece", "start", "length")]
    # the place holds the number of the partition that wrote the row in its upper bits
    cut = stored(cut.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    cut = cut.withColumn("_part", F.shiftright("_place", 33))
    counts = cut.groupBy("length", "_part").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    slots = Slots(plan(histogram, capacity), capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "offset"), slots.find(length.to_numpy(), rank.to_numpy()))))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_place")) - 1
    ranked = cut.withColumn("_rank", rank.cast("long")).join(before, ["length", "_part"])
    return ranked.withColumn("_to", place("length", F.col("_before") + F.col("_rank"))).select(
        F.col("key").alias(key), "piece", "start", "length", *kept, "_to.sequence_id", "_to.offset")
