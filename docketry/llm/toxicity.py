"""Toxicity by weak supervision: lexicon and pattern voters, a label model, and a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import weak
from docketry.llm.common import held_out, lean, stored
from docketry.llm.hashing import Powers, alphanumeric, chunks, shingle_sets, word_hashes

#: The bounds of training: labelled rows (least hash of the key first), and terms of the lexicon.
MAX_ROWS = 20_000
MAX_TERMS = 2_000
#: A term is listed if it occurs in at least so many toxic texts, in clean ones at most by this share of their rate, and if
#: chance would bring forth none like it, with this probability, among all terms looked at.
MIN_TEXTS = 3
MAX_RATIO = 0.05
CHANCE = 0.01
STEM = 4
GROUPS = 8
#: Voters: word groups, stem groups, hits, distinct hits, density, capitals, exclamations, and the annotators' label.
N_VOTERS = 2 * GROUPS + 6
EXTRA = 6


class Model(NamedTuple):
    terms: np.ndarray
    linear: weak.Linear
    labels: weak.LabelModel


class Reader:
    """Terms of texts: hashes of lower-case words, and of the first letters of longer ones."""

    def __init__(self):
        self.powers, self.is_word = Powers(), alphanumeric()

    def terms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, stems, first word of each text)."""
        words, first, stems = word_hashes([t.lower() for t in texts], self.powers, self.is_word, STEM)
        return words >> np.uint64(1), stems >> np.uint64(1) | np.uint64(1 << 63), first


def _hits(reader: Reader, texts: list[str], known: np.ndarray):
    """(text, place in the lexicon, count) of the terms found, and the number of words of each text."""
    words, stems, first = reader.terms(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    found = []
    for terms in (words, stems):
        at = np.searchsorted(known, terms)
        at[at == len(known)] = 0
        ok = np.flatnonzero(known[at] == terms) if len(known) else np.zeros(0, np.int64)
        found.append(row[ok] * max(len(known), 1) + at[ok])
    pair, count = np.unique(np.concatenate(found), return_counts=True)
    return pair // max(len(known), 1), pair % max(len(known), 1), count, np.diff(first)


def votes(texts: list[str], row: np.ndarray, column: np.ndarray, count: np.ndarray, size: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What each voter says of each text: 1 toxic, -1 clean, 0 nothing.  The last column is left for annotators."""
    n = len(texts)
    out = np.zeros((n, N_VOTERS), np.int8)
    stem = known[column] >> np.uint64(63) == 1 if len(known) else np.zeros(0, bool)
    group = (known[column] % np.uint64(GROUPS)).astype(int) + GROUPS * stem if len(known) else np.zeros(0, int)
    out[row, group] = 1
    total, distinct = np.bincount(row, count, n), np.bincount(row, minlength=n)
    at = 2 * GROUPS
    out[:, at] = np.where(total >= 2, 1, np.where(total == 0, -1, 0))
    out[:, at + 1] = np.where(distinct >= 3, 1, np.where(distinct == 0, -1, 0))
    density = total / np.maximum(size, 1)
    out[:, at + 2] = np.where(density >= 0.004, 1, np.where(density == 0, -1, 0))
    out[:, at + 3] = [_capitals(t) > 0.5 for t in texts]
    out[:, at + 4] = [t.count("!") > 3 for t in texts]
    return out


def _capitals(text: str) -> float:
    """Share of capitals among the letters A to Z."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper, lower = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
    return upper / max(1, upper + lower)


def _features(row, column, count, size, said: np.ndarray, width: int):
    """Sparse features: presence of each term, hits, distinct hits, density, and the pattern voters."""
    n = len(size)
    total, distinct = np.bincount(row, count, n), np.bincount(row, minlength=n)
    extra = np.stack([np.log1p(total), np.log1p(distinct), np.minimum(50 * total / np.maximum(size, 1), 2), said[:, -3], said[:, -2], total > 1], 1)
    r, c = np.nonzero(extra)
    return (np.concatenate([row, r]), np.concatenate([column, width + c]), np.concatenate([np.ones(len(row)), extra[r, c]]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    """Lexicon, label model and classifier from labelled rows outside the held-out quarter; None without such rows.

    At most ``MAX_ROWS`` labelled keys are read, of a key that repeats one text.  Terms that are frequent in toxic texts and rare in clean ones form the
    voters' lexicons.  The label model estimates each voter's accuracy, and their correlations, from votes alone (annotators
    vote too); the classifier is trained on its posterior labels.
    """
    able = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter(
        ~held_out(F.col("key")) & F.col("key").isNotNull() & F.col("y").isNotNull())
    able = able.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(MAX_ROWS)
    train = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(able), "key")
    # one text a key, so that the bound holds for keys that repeat; read three times from here on
    train = stored(train.groupBy("key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")

    def list_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for b in lean(batches):
            for at, part in chunks(b["text"].tolist()):
                words, stems, first = reader.terms(part)
                row = np.repeat(np.arange(len(part)), np.diff(first))
                both = np.unique(np.stack([np.concatenate([row, row]).astype(np.uint64), np.concatenate([words, stems])]), axis=1)
                y = b["y"].to_numpy()[at:at + len(part)][both[0].astype(int)]
                low = np.array([x[0] if len(x) else 0 for x in shingle_sets(part, 5, reader.powers)], np.uint64)
                yield pd.DataFrame({
                    "term": both[1].astype(np.int64), "y": y, "sketch": low[both[0].astype(int)].astype(np.int64)})

    # copies of a text say a thing once: texts are told apart by the least hash of their shingles
    met = train.mapInPandas(list_terms, "term long, y int, sketch long").distinct()
    terms = met.groupBy("term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    n_bad, n_good = train.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not n_bad or not n_good:
        return None
    terms = stored(terms.filter(F.col("bad") >= MIN_TEXTS), "terms")
    rate = n_bad / (n_bad + n_good)
    bad, good = F.col("bad"), F.col("good")
    rare = bad * F.log(bad / (bad + good) / rate) + F.when(good > 0, good * F.log(good / (bad + good) / (1 - rate))).otherwise(0.0)
    listed = terms.filter(((good / n_good) / (bad / n_bad) <= MAX_RATIO) & (rare >= float(np.log(max(1, terms.count()) / CHANCE))))
    best = listed.orderBy(F.desc("bad"), "term").limit(MAX_TERMS).toPandas()
    known = np.sort(best["term"].to_numpy().astype(np.int64).astype(np.uint64))

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for b in lean(batches):
            for at, part in chunks(b["text"].tolist()):
                row, column, count, size = _hits(reader, part, known)
                said = votes(part, row, column, count, size, known)
                said[:, -1] = np.where(b["y"].to_numpy()[at:at + len(part)] == 1, 1, -1)
                cut = np.searchsorted(row, np.arange(len(part) + 1))
                yield pd.DataFrame({
                    "key": b["key"].to_numpy()[at:at + len(part)], "size": size, "votes": [x.tobytes() for x in said],
                    "columns": [column[a:z].astype(np.int32).tobytes() for a, z in zip(cut, cut[1:])],
                    "counts": [count[a:z].astype(np.int32).tobytes() for a, z in zip(cut, cut[1:])]})

    # at most MAX_ROWS rows, each with at most MAX_TERMS places and counts, reach the driver
    seen = train.mapInPandas(observe, "key long, size long, votes binary, columns binary, counts binary").toPandas()
    seen = seen.sort_values(["key", "size"], kind="stable")
    said = np.frombuffer(b"".join(seen["votes"]), np.int8).reshape(len(seen), N_VOTERS)
    row = np.repeat(np.arange(len(seen)), [len(x) // 4 for x in seen["columns"]])
    column = np.frombuffer(b"".join(seen["columns"]), np.int32).astype(int)
    count = np.frombuffer(b"".join(seen["counts"]), np.int32).astype(int)
    model, target = weak.fit_labels(said.astype(int), n_bad / (n_bad + n_good))
    features = _features(row, column, count, seen["size"].to_numpy(), said, len(known))
    linear = weak.fit_linear(*features, target, len(known) + EXTRA)
    return Model(known, linear, model)


def score(text: Column, model: Model | None) -> Column:
    """Probability (0 to 1) that a whole text is toxic; null is scored as an empty text, and 0 stands for no model."""

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for s in lean(batches):
            out = np.zeros(len(s))
            if model is not None:
                for at, part in chunks(s.fillna("").tolist()):
                    row, column, count, size = _hits(reader, part, model.terms)
                    said = votes(part, row, column, count, size, model.terms)
                    out[at:at + len(part)] = weak.logistic(
                        model.linear, *_features(row, column, count, size, said, len(model.terms)), len(part))
            yield pd.Series(out)

    return udf(text)
