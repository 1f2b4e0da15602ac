"""Alignment of two tokenizers over the same texts by pointer jumping, and how often their tokens are linked in the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import lean, stored
from docketry.llm.subwords import BLOCK, BytePairs, Flat, Pieces, blocks, parts

#: Id pairs whose counts every worker gets, the most frequent ones; all others meet their counts in a join.
HEAVY = 1 << 20
#: Links of a group that are listed one by one; of a larger group each distinct pair is listed once, with its number.
PLAIN = 256
#: Pair counts a task holds before it passes them on.
HELD = 1 << 20


# --- groups of one block of texts, in numpy ---------------------------------------------------------------


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each A token, group of each B token, number of groups) from the places where tokens end.

    Every token points to the token that overlaps it and reaches farthest right (the A token, if both reach as far).  A
    token that nothing overreaches points to itself: it is the last of its component.  Doubling the pointers leads every
    token there, in as many steps as the logarithm of the longest chain.
    """
    n = len(end_a)
    over_a = np.searchsorted(end_b, end_a)  # the B token that holds an A token's last byte
    to = np.concatenate([np.where(end_b[over_a] > end_a, n + over_a, np.arange(n)), np.searchsorted(end_a, end_b)])
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    last = np.zeros(n, bool)
    last[to] = True
    number = np.cumsum(last) - 1
    label = number[to]
    return label[:n], label[n:], int(last.sum())


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, how often) of the linked id pairs of all groups; a code is a * width + b.

    ``a`` and ``b`` are ids in order of groups, of which each holds ``n_a`` and ``n_b``.
    """
    start_a, start_b, many = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    small = np.flatnonzero(many <= PLAIN)
    count = many[small]
    group = np.repeat(small, count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    code = a[start_a[group] + k // n_b[group]] * width + b[start_b[group] + k % n_b[group]]
    out = [(group, code, np.ones(len(code), np.int64))]
    for g in np.flatnonzero(many > PLAIN).tolist():
        x, p = np.unique(a[start_a[g]:start_a[g] + n_a[g]], return_counts=True)
        y, q = np.unique(b[start_b[g]:start_b[g] + n_b[g]], return_counts=True)
        code = (x[:, None] * width + y).ravel()
        out.append((np.full(len(code), g), code, (p[:, None] * q).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out))


def summed(code: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, and the sums of their numbers."""
    order = np.argsort(code, kind="stable")
    code, many = code[order], many[order]
    first = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(many, first) if len(first) else many


def told(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Ids of each group as decimal numbers with commas between."""
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, pa.array(ids).cast(pa.string())), ",")


class Aligner:
    """Both vocabularies in one worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = BytePairs(a_path, plain=True), Pieces(b_path)
        self.flat_a, self.flat_b = Flat(self.a.bytes), Flat(self.b.bytes)
        self.width = len(self.flat_b.size)
        self.kind = "<u4" if len(self.flat_a.size) * self.width < 1 << 32 else "<u8"

    def rows(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, codes, times) of each text.

        Parts begin new groups, so a long text is aligned part by part.
        """
        cut = [parts(t) for t in texts]
        done = iter([])
        queue = blocks([p for own in cut for p in own], BLOCK, lambda p: len(p or ""))
        for own in cut:
            rows = []
            while len(rows) < len(own):
                row = next(done, None)
                if row is None:
                    done = self.align(next(queue)[1])
                else:
                    rows.append(row)
            yield self.whole(rows)

    def whole(self, rows: list[tuple]) -> tuple:
        """One row from those of a text's parts; a text of which a part has no tokens has none."""
        if len(rows) == 1:
            return rows[0]
        if not all(r[0] for r in rows):
            return 0, 0, 0, 0, "", b"", b""
        code = np.concatenate([np.frombuffer(r[5], self.kind) for r in rows]).astype(np.int64)
        code, times = summed(code, np.concatenate([np.frombuffer(r[6], "<u4") for r in rows]).astype(np.int64))
        return (*(sum(r[k] for r in rows) for k in range(4)), ";".join([r[4] for r in rows]),
                code.astype(self.kind).tobytes(), times.astype("<u4").tobytes())

    def align(self, some: list[str | None]) -> Iterator[tuple]:
        """The same for texts or parts of texts."""
        texts = ["" if t is None else " " + t for t in some]
        own = [self.a.encode(t) for t in texts]
        other = iter(self.b.encode([t for t in some if t is not None]))
        other = [np.array([] if t is None else next(other), np.int64) for t in some]
        none = np.zeros(0, np.int64)
        ids = [np.concatenate([none, *x]).astype(np.int64) for x in (own, other)]
        ends = [np.cumsum([0, *map(len, x)]) for x in (own, other)]  # where each text's tokens begin
        encoded = [t.encode() for t in texts]
        raw, length = [np.frombuffer(b"".join(encoded), np.uint8)], np.array([len(t) for t in encoded])
        for flat_bytes, own in zip((self.flat_a, self.flat_b), ids):
            raw.append(flat_bytes.joined(own)[0])
        same = self.same(raw, length, ids, ends)
        keep = [np.repeat(same, np.diff(e)) for e in ends]
        a, b = ids[0][keep[0]], ids[1][keep[1]]
        n_a, n_b = (np.where(same, np.diff(e), 0) for e in ends)
        end_a, end_b = np.cumsum(self.flat_a.size[a]), np.cumsum(self.flat_b.size[b])
        if len(a):
            of_a, of_b, n_groups = groups(end_a, end_b)
        else:
            of_a, of_b, n_groups = a, b, 0
        per_a, per_b = np.bincount(of_a, minlength=n_groups), np.bincount(of_b, minlength=n_groups)
        doc = np.repeat(np.arange(len(texts)), n_a)[np.cumsum(per_a) - 1] if n_groups else a
        in_doc = np.bincount(doc, minlength=len(texts))
        group, code, times = links(a, b, per_a, per_b, self.width)
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc, per_a * per_b)
        both = pc.binary_join_element_wise(told(a, per_a), told(b, per_b), "|")
        spans = np.concatenate([[0], np.cumsum(in_doc)]).astype(np.int64)
        text = pc.binary_join(pa.LargeListArray.from_arrays(spans, both), ";").to_pylist()
        # one number a (text, code), so that all texts are summed in one sort
        most = len(self.flat_a.size) * self.width
        code, times = summed(doc[group] * most + code, times)
        cut = np.searchsorted(code, np.arange(len(texts) + 1) * most)
        for i, (p, q, r, s) in enumerate(zip(n_a.tolist(), n_b.tolist(), in_doc.tolist(), n_links.tolist())):
            own = slice(cut[i], cut[i + 1])
            yield p, q, r, s, text[i] or "", (code[own] - i * most).astype(self.kind).tobytes(), times[own].astype("<u4").tobytes()

    def same(self, raw: list[np.ndarray], length: np.ndarray, ids: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
        """By text: whether the bytes of its tokens, of either vocabulary, are those of the text with a blank before it."""
        start, ok = np.cumsum(length) - length, length > 0
        for flat, own, at, mine in zip((self.flat_a, self.flat_b), ids, ends, raw[1:]):
            sums = np.concatenate([[0], np.cumsum(flat.size[own])])
            begin, size = sums[at[:-1]], np.diff(sums[at])
            ok &= size == length
            if len(mine) == len(raw[0]) and ok.all() and (mine == raw[0]).all():
                continue
            for i in np.flatnonzero(ok).tolist():
                ok[i] = np.array_equal(mine[begin[i]:begin[i] + size[i]], raw[0][start[i]:start[i] + length[i]])
        return ok


# --- Spark ------------------------------------------------------------------------------------------------

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, times binary"


def aligned(text: Column, a_path: str, b_path: str) -> Column:
    """struct of ALIGNED: a text's token and group counts, its groups, and its linked id pairs with their numbers."""
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    @F.pandas_udf(ALIGNED)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = Aligner(a_path, b_path)
        for s in lean(batches):
            yield pd.DataFrame(list(both.rows([t or "" for t in s])), columns=names)

    return udf(text)


def pair_counts(held: DataFrame, kind: str) -> DataFrame:
    """(code, n): in how many rows each id pair is linked; summed up in every task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for part in (x for batch in lean(batches) for x in batch.column(0).to_pylist()):
            waiting.append(np.frombuffer(part, kind).astype(np.int64))
            size += len(waiting[-1])
            if size >= HELD:
                code, n = summed(np.concatenate([code, *waiting]), np.concatenate([n, np.ones(size, np.int64)]))
                waiting, size = [], 0
                if len(code) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                    code, n = code[:0], n[:0]
        code, n = summed(np.concatenate([code, *waiting]), np.concatenate([n, np.ones(size, np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return held.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", heavy: int = HEAVY,
          carry: Sequence[Column | str] = ("groups",)) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, ..., n_best, count_sum) of every row: two tokenizers aligned over its text.

    A is a byte-level vocabulary (tokenizers library), B a piece model (sentencepiece); A gets the text with the blank before
    it that B adds.  Where tokens of both end at the same byte a group ends; all A and B tokens of a group are linked.
    ``groups`` tells a text's groups as ``a1,a2|b1;a3|b2,b3``; ``carry`` are the columns to keep of it.

    An id pair's count is the number of rows that hold it linked.  ``n_best`` are the links whose count is the highest of
    their A id in the corpus, ``count_sum`` the sum of the counts over all links.  Rows keep their pairs; the counts of at
    most ``heavy`` pairs, the most frequent, are sent to every worker (a fixed bound), so a frequent pair is met in place;
    rarer pairs meet their counts in a join by pair.  The best count by A id is at most one number an id.

    Edge cases: a text that is null, empty, or not what its tokens' bytes join to (U+2581 in it, say) has no tokens, zeros
    and empty groups; special tokens' strings are plain text; rows that repeat a key, also null, are rows of their own and
    each counts; an empty table gives no rows; other columns are not looked at; a very long text is encoded in parts.
    """
    a_size, b_size = len(BytePairs(a_path, plain=True).bytes), len(Pieces(b_path).bytes)
    kind = "<u4" if a_size * b_size < 1 << 32 else "<u8"
    rows = docs.select(F.col(key).alias("key"), aligned(F.col(text), a_path, b_path).alias("_a")).select("key", "_a.*")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    rows = rows.select("key", *numbers, *carry, "codes", "times")
    kept = [c for c in rows.columns if c not in {"key", *numbers, "codes", "times"}]
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows, kind), "pair-counts")
    best = counts.groupBy(F.expr(f"code div {b_size}").cast("int").alias("a")).agg(F.max("n").alias("most"))
    highest = np.zeros(a_size, np.int64)
    for r in best.collect():  # at most one row an id of the vocabulary
        highest[r["a"]] = r["most"]

    # counts by order of magnitude tell from which count on there are no more than ``heavy`` pairs
    bits = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs"))
    least, room = 63, heavy
    for r in sorted(bits.collect(), key=lambda r: -r["bits"]):
        room -= r["pairs"]
        if room < 0:
            break
        least = r["bits"]
    often, rare = F.col("n") >= F.lit(1 << (least - 1)), F.col("n") < F.lit(1 << (least - 1))
    many = counts.filter(often).toArrow().sort_by("code")
    known, number = many.column("code").to_numpy(), many.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((known, number, highest))

    @F.pandas_udf("n_best long, count_sum long, codes array<long>, times array<long>")
    def met(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, number, highest = shared.value
        for codes, times in lean(batches):
            out = []
            for c, t in zip(codes, times):
                c, t = np.frombuffer(c, kind).astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, c), max(0, len(known) - 1))
                hit = known[at] == c if len(known) else np.zeros(len(c), bool)
                n = number[at[hit]] if len(known) else at[hit]
                out.append((int(t[hit][n == highest[c[hit] // b_size]].sum()), int((n * t[hit]).sum()), c[~hit], t[~hit]))
            yield pd.DataFrame(out, columns=["n_best", "count_sum", "codes", "times"])

    rows = rows.select("key", "_row", *numbers, *kept, met("codes", "times").alias("_m"))
    rows = stored(rows.select("key", "_row", *numbers, *kept, "_m.*"), "met")
    tail = rows.select("_row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("_row", F.col("p.codes").alias("code"), "p.times")
    tail = tail.join(counts.filter(rare), "code").withColumn("a", F.expr(f"code div {b_size}").cast("int")).join(best, "a")
    tail = tail.groupBy("_row").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    return rows.join(tail, "_row", "left").select(
        F.col("key").alias(key), *numbers, *kept, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
