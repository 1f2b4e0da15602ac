"""Token-set similarity: everything but one subsequence length is JVM-side.

For token sets A and B with S = A & B, X = A - B, Y = B - A, and n(T) the length of the sorted tokens
joined by blanks, the ratio is 100 when S is not empty and X or Y is; else the best of

    r1 = 100 * (1 - indel(X, Y) / (n(A') + n(B')))     A' = S then X, B' = S then Y, each joined
    r2 = 100 * (1 - (1 + n(X)) / (n(S) + n(A')))       only when S is not empty
    r3 = 100 * (1 - (1 + n(Y)) / (n(S) + n(B')))       only when S is not empty

where indel(x, y) = n(x) + n(y) - 2 * LCS(x, y).  r2, r3 and an upper bound of r1 need only lengths, so
a pair goes to the Arrow function for its LCS only when r1 can still matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import IntegerType

from docketry.functions.patterns import WORD
from docketry.functions.text import once


def token_set(text: Column) -> Column:
    """Distinct sorted lower-case words."""
    words = F.split(F.lower(F.regexp_replace(text, f"[^{WORD}]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def joined_length(tokens: Column) -> Column:
    return F.length(F.array_join(tokens, " "))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-integer row per character of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & positions.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _codes(texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one row, and where each text begins."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS lengths of many pairs at once: bit rows of all pairs advance together, one numpy step a character column.

    The shorter text of a pair is its row of bits, up to 64 of them; pairs of two longer texts go one by one.
    """
    out = np.zeros(len(left), np.int64)
    short = [a if len(a) <= len(b) else b for a, b in zip(left, right)]
    long = [b if len(a) <= len(b) else a for a, b in zip(left, right)]
    bits, size = (np.array([len(t) for t in x], np.int64) for x in (short, long))
    for i in np.flatnonzero(bits > 64).tolist():
        out[i] = _lcs(short[i], long[i])
    at = np.flatnonzero((bits > 0) & (bits <= 64))
    at = at[np.argsort(-size[at], kind="stable")]  # pairs still at work are the first ones
    if not len(at):
        return out
    distinct, which = np.unique(np.array([short[i] for i in at], object), return_inverse=True)
    lengths = np.array([len(t) for t in distinct])
    points, _ = _codes(list(distinct), lengths)
    letters, letter = np.unique(points, return_inverse=True)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # by distinct text and letter: at which places it stands; the last column is for letters that stand nowhere
    masks = np.zeros((len(distinct), len(letters) + 1), np.uint64)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(distinct)), lengths), letter), np.uint64(1) << place.astype(np.uint64))
    points, begin = _codes([long[i] for i in at], size[at])
    column = np.searchsorted(letters, points)
    column[(column == len(letters)) | (letters[np.minimum(column, len(letters) - 1)] != points)] = len(letters)
    full = np.where(bits[at] == 64, ~np.uint64(0), (np.uint64(1) << (bits[at] % 64).astype(np.uint64)) - np.uint64(1))
    row = full.copy()
    for step in range(int(size[at[0]])):
        n = int(np.searchsorted(-size[at], -step))  # texts with more than ``step`` characters
        hit = row[:n] & masks[which[:n], column[begin[:n] + step]]
        row[:n] = ((row[:n] + hit) | (row[:n] - hit)) & full[:n]
    out[at] = bits[at] - np.bitwise_count(row)
    return out


@pandas_udf(IntegerType())
def lcs_length(x: pd.Series, y: pd.Series) -> pd.Series:
    """LCS length per pair; null inputs cost nothing and give null."""
    there = np.flatnonzero((x.notna() & y.notna()).to_numpy())
    out = pd.Series(pd.NA, index=range(len(x)), dtype="Int32")
    out.iloc[there] = lcs_lengths(x.to_numpy()[there].tolist(), y.to_numpy()[there].tolist())
    return out


# not moved or repeated by the optimizer: a filter on the result must not run the function again
_lcs_once = lcs_length.asNondeterministic()


def _pct(distance: Column, total: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) * distance / total


def _parts(a: Column, b: Column) -> Column:
    """What is known of a pair without its LCS, and whether the LCS can improve it."""
    def lengths(p: Column) -> Column:
        return F.struct(
            p["s"].alias("s"), F.size(p["s"]).alias("ks"), joined_length(p["s"]).alias("ns"),
            joined_length(a).alias("na"), joined_length(b).alias("nb"),
        )

    def bounds(p: Column) -> Column:
        ns, na, nb, shared = p["ns"], p["na"], p["nb"], p["ks"] > 0
        subset = shared & ((p["ks"] == F.size(a)) | (p["ks"] == F.size(b)))
        gap = shared.cast("int")
        # lengths of X and Y follow from lengths of A, B and S; A' and B' are as long as A and B
        nx, ny = na - ns - gap, nb - ns - gap
        done = (na == 0) | (nb == 0) | subset
        known = F.when(subset, 100.0).when(
            shared & ~done, F.greatest(_pct(1 + nx, ns + na), _pct(1 + ny, ns + nb))
        ).otherwise(0.0)
        bound = F.when(done, 0.0).otherwise(_pct(F.abs(nx - ny), na + nb))
        return F.struct(
            p["s"].alias("s"), (na + nb).alias("total"), (nx + ny).alias("apart"), known.alias("known"), bound.alias("bound")
        )

    return once(once(F.struct(F.array_intersect(a, b).alias("s")), lengths), bounds)


def _overlaps(joined: list[str], patterns: list[str]) -> np.ndarray:
    """By line and pattern: how many characters both have, each as often as in the poorer one; no LCS is longer."""
    letters = {c: i for i, c in enumerate(sorted(set("".join(patterns))))}
    known = np.array(sorted(map(ord, letters)), np.uint32)
    size = np.array([len(t) for t in joined], np.int64)
    points, _ = _codes(joined, size)
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    here = known[at] == points
    line = np.repeat(np.arange(len(joined)), size)
    counts = np.bincount((line * len(known) + at)[here], minlength=len(joined) * len(known)).reshape(len(joined), len(known))
    out = np.empty((len(joined), len(patterns)), np.int64)
    for n, p in enumerate(patterns):
        out[:, n] = np.minimum(counts, np.bincount([letters[c] for c in p], minlength=len(known))).sum(axis=1)
    return out


def similar_pairs(lines: list[str], patterns: list[list[str]], threshold: float) -> dict[int, list[tuple[int, float]]]:
    """By line number the (pattern, token-set ratio) at or above the threshold, for cleaned lower-case lines.

    Pairs without a shared word go through numpy together: lengths, then common characters, leave few for an LCS.
    """
    whole = [" ".join(words) for words in patterns]
    postings: dict[str, list[int]] = {}
    for n, words in enumerate(patterns):
        for w in words:
            postings.setdefault(w, []).append(n)
    tokens = [sorted(set(line.split(" ")) - {""}) for line in lines]
    joined = [" ".join(t) for t in tokens]
    pairs: list[tuple[int, int, float, int, int, str, str]] = []  # line, pattern, known, apart, total, x, y
    out: dict[int, list[tuple[int, float]]] = {}
    shares = np.zeros((len(lines), len(patterns)), bool)
    for i, b in enumerate(tokens):
        shared: dict[int, set[str]] = {}
        for w in postings.keys() & b if len(b) > len(postings) else b:
            for n in postings.get(w, ()):
                shared.setdefault(n, set()).add(w)
        nb = len(joined[i])
        for n, s in shared.items():
            shares[i, n] = True
            a, na = patterns[n], len(whole[n])
            if len(s) == len(a) or len(s) == len(b):
                if threshold <= 100.0:
                    out.setdefault(i, []).append((n, 100.0))
                continue
            ns = sum(map(len, s)) + len(s) - 1
            nx, ny = na - ns - 1, nb - ns - 1
            known = max(100.0 - 100.0 * (1 + nx) / (ns + na), 100.0 - 100.0 * (1 + ny) / (ns + nb))
            bound = 100.0 - 100.0 * abs(nx - ny) / (na + nb)
            if max(known, bound) < threshold:
                continue
            if bound > known:
                x, y = (" ".join(w for w in t if w not in s) for t in (a, b))
                pairs.append((i, n, known, nx + ny, na + nb, x, y))
            else:
                out.setdefault(i, []).append((n, known))
    na, nb = np.array([len(p) for p in whole], np.int64)[None, :], np.array([len(t) for t in joined], np.int64)[:, None]
    total = np.maximum(na + nb, 1)
    bound = np.where((na > 0) & (nb > 0), 100.0 - 100.0 * np.abs(na - nb) / total, 0.0)
    if threshold <= 0:
        for i, n in zip(*(v.tolist() for v in np.nonzero(~shares & (bound <= 0)))):
            out.setdefault(i, []).append((n, 0.0))
    asked = ~shares & (bound > 0) & (bound >= threshold)
    near = np.flatnonzero(asked.any(axis=1))
    if len(near):
        reach = 100.0 - 100.0 * (na + nb[near] - 2 * _overlaps([joined[i] for i in near], whole)) / total[near]
        for k, n in zip(*(v.tolist() for v in np.nonzero(asked[near] & (reach >= threshold)))):
            i = int(near[k])
            apart = len(whole[n]) + len(joined[i])
            pairs.append((i, n, 0.0, apart, apart, whole[n], joined[i]))
    for (i, n, known, apart, size, _, _), lcs in zip(pairs, lcs_lengths([p[5] for p in pairs], [p[6] for p in pairs]).tolist()):
        ratio = max(known, 100.0 - 100.0 * (apart - 2 * lcs) / size)
        if ratio >= threshold:
            out.setdefault(i, []).append((n, ratio))
    return out


def first_similar(pieces: Column, todo: Column, patterns: list[list[str]], threshold: float) -> Column:
    """[(pattern_ord, piece, similarity)]: per pattern in ``todo`` the first piece at or above the threshold.

    ``pieces``: cleaned lower-case lines in order.  ``patterns``: sorted distinct words of each pattern.  A null piece is like nothing.
    """
    @arrow_udf("array<struct<pattern_ord:int,piece:int,similarity:double>>")
    def firsts(pieces: pa.Array, todo: pa.Array) -> pa.Array:
        size = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        found = similar_pairs(coded.dictionary.to_pylist(), patterns, threshold)
        which = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        some = np.zeros(len(coded.dictionary) + 1, bool)
        some[list(found)] = True
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        hits: dict[int, dict[int, tuple[int, float]]] = {}
        for at in np.flatnonzero(some[which]).tolist():
            first = hits.setdefault(int(row[at]), {})
            for n, ratio in found[int(which[at])]:
                first.setdefault(n, (at - int(begin[row[at]]), ratio))
        counts, ords, places, ratios = np.zeros(len(size), np.int64), [], [], []
        asked = todo.take(pa.array(list(hits), pa.int64())).to_pylist()
        for (r, first), ns in zip(hits.items(), asked):
            kept = sorted(set(first).intersection(ns or ()))
            counts[r] = len(kept)
            ords += kept
            places += [first[n][0] for n in kept]
            ratios += [first[n][1] for n in kept]
        values = pa.StructArray.from_arrays(
            [pa.array(ords, pa.int32()), pa.array(places, pa.int32()), pa.array(ratios, pa.float64())], ["pattern_ord", "piece", "similarity"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    # not moved or repeated by the optimizer
    return firsts.asNondeterministic()(pieces, todo)


def with_similarity(
    df: DataFrame, a: str, b: str, out: str, threshold: float | None = None, always: Column | None = None
) -> DataFrame:
    """Add ``out``, the token-set ratio of token arrays ``a`` and ``b``.

    With a ``threshold``, rows below it are dropped, most of them before any Python runs; rows where
    ``always`` holds stay in any case.
    """
    def keep(c: Column) -> Column:
        return c if always is None else c | always

    floor = 0.0 if threshold is None else threshold
    parts = F.array(_parts(F.col(a), F.col(b)))
    if threshold is not None:
        parts = F.filter(parts, lambda p: keep(F.greatest(p["known"], p["bound"]) >= threshold))
    # a generator's output is computed once; a plain column would be inlined into every later filter
    df = df.select("*", F.explode_outer(parts).alias("_p")).filter("_p IS NOT NULL")
    p = F.col("_p")
    ask = (p["bound"] > p["known"]) & (p["bound"] >= floor)
    x = F.when(ask, F.array_join(F.array_except(a, p["s"]), " "))
    y = F.when(ask, F.array_join(F.array_except(b, p["s"]), " "))
    df = df.withColumn("_lcs", _lcs_once(x, y))
    r1 = F.when(F.col("_lcs").isNotNull(), _pct(p["apart"] - 2 * F.col("_lcs"), p["total"]))
    df = df.withColumn(out, F.greatest(p["known"], r1))
    if threshold is not None:
        df = df.filter(keep(F.col(out) >= threshold))
    return df.drop("_p", "_lcs")
