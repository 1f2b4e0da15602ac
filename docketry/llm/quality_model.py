"""Document quality without labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import weak
from docketry.llm.common import lean, stored
from docketry.llm.hashing import SPACES, Powers, chunks, mixed, word_hashes

#: The bound of the scorer's training sample: texts with the least hashes of each pattern of votes.
MAX_ROWS = 8_000
#: Hashed features: word shapes and pairs of neighbouring shapes.
WIDTH = 2048
PRIOR = 0.85
KEEP = 0.5
# --- fixed values of the labellers: a measure, where it votes for low quality, and where for high -----------
SYMBOLS = "#*$%&|<>{}^~"
LABELLERS = (
    ("repeats", (0.10, np.inf), (-np.inf, 0.02)),
    ("distinct", (-np.inf, 0.15), (0.30, np.inf)),
    ("symbols", (0.02, np.inf), (-np.inf, 0.002)),
    ("marks", (0.10, np.inf), (-np.inf, 0.02)),
    ("bars", (0.10, np.inf), None),
    ("shouts", (0.10, np.inf), None),
    ("capitals", (0.30, np.inf), (0.005, 0.15)),
    ("sentences", (-np.inf, 0.005), (0.02, 0.35)),
    ("words", (-np.inf, 10), (50, np.inf)),
    ("word_length", (12, np.inf), (2.5, 9)),
    ("top_share", (0.20, np.inf), (-np.inf, 0.12)),
)


class Model(NamedTuple):
    labels: weak.LabelModel
    linear: weak.Linear


def observe(texts: list[str], powers: Powers, shapes: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Labellers' votes (1 high, -1 low quality) and hashed shape shares (None without ``shapes``), a row a text."""
    n = len(texts)
    words, first = word_hashes(texts, powers)
    size = np.diff(first)
    row = np.repeat(np.arange(n), size)
    joined = " ".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    space = (points <= 0x20) & SPACES[np.minimum(points, 0x20)]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    space[ends] = True
    edge = np.flatnonzero(np.diff(~space, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    many = np.maximum(size, 1)
    same = np.append(False, words[1:] == words[:-1]) if len(words) else np.zeros(0, bool)
    same[first[:-1][size > 0]] = False
    distinct, top = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            count = np.unique(words[a:b], return_counts=True)[1]
            distinct[i], top[i] = len(count) / (b - a) ** 0.8, count.max() / (b - a)
    chars = np.maximum([len(t) for t in texts], 1)
    upper, lower = (points >= 65) & (points <= 90), (points >= 97) & (points <= 122)
    of_text = lambda x: np.add.reduceat(np.append(x, 0).astype(np.int64), np.append(0, ends[:-1] + 1)) if n else np.zeros(0)
    n_upper, n_lower = of_text(upper), of_text(lower)
    last = points[stop - 1] if len(stop) else points[:0]
    measures = {
        "repeats": np.bincount(row, same, n) / many, "distinct": np.where(size > 20, distinct, 1.0),
        "symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts]) / chars,
        "marks": np.bincount(row, np.isin(last, [ord(c) for c in SYMBOLS]), n) / many,
        "bars": np.array([t.count("|") for t in texts]) / many, "shouts": np.array([t.count("!!") for t in texts]) / many,
        "capitals": n_upper / np.maximum(n_upper + n_lower, 1),
        "sentences": np.where(size > 40, np.bincount(row, np.isin(last, (0x2E, 0x21, 0x3F)), n) / many, 0.1),
        "words": size, "word_length": np.bincount(row, stop - start, n) / many, "top_share": np.where(size > 20, top, 0.1),
    }
    votes = np.zeros((n, len(LABELLERS)), np.int8)
    for j, (name, low, high) in enumerate(LABELLERS):
        x = measures[name]
        votes[:, j] = np.where((x >= low[0]) & (x <= low[1]), -1, np.where((x >= high[0]) & (x <= high[1]), 1, 0) if high else 0)
    if not shapes:
        return votes, None
    kind = lambda p: np.where(p >= 0x80, 3, np.where((p | 32) - 97 < 26, np.where(p & 32, 1, 2), p)).astype(np.uint64)
    if len(words):
        shape = np.minimum(stop - start, 15).astype(np.uint64) | kind(points[start]) << np.uint64(4) | kind(last) << np.uint64(12)
        shape |= same.astype(np.uint64) << np.uint64(20)
        pair = mixed(shape[1:] | shape[:-1] << np.uint64(24), 6)
        near = row[1:] == row[:-1]
        at = np.concatenate([row * WIDTH + (mixed(shape, 7) % np.uint64(WIDTH)).astype(np.int64),
                             row[1:][near] * WIDTH + (pair[near] % np.uint64(WIDTH)).astype(np.int64)])
    else:
        at = np.zeros(0, np.int64)
    shares = np.bincount(at, minlength=n * WIDTH).reshape(n, WIDTH) / many[:, None]
    return votes, np.sqrt(shares).astype(np.float32)


def quotas(distinct: np.ndarray, most: int) -> np.ndarray:
    """How many of each group's members to take: all of the small groups, an equal part of the others, at least one, ``most`` in all.

    More groups than ``most`` give one member each.
    """
    low, high = 1, max(int(distinct.max(initial=1)), 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(distinct, middle).sum() <= most else (low, middle - 1)
    return np.minimum(np.maximum(distinct, 1), low)


def fit(docs: DataFrame, text: str = "text", max_rows: int = MAX_ROWS) -> Model | None:
    """Labeller accuracies from all documents with text, and a scorer from a sample of them; None if there are none.

    No labels are read.  All documents' votes are counted, a row a pattern of votes (at most 3 ** labellers, in practice
    about a hundred), and expectation-maximisation over these counts gives each labeller its accuracy and each pattern its
    posterior.  Repeated and null keys do not matter: every row votes.

    The scorer is trained on about ``max_rows`` distinct texts (more only if there are more patterns), drawn by the hash of
    the text within each pattern: all of a rare one, equally many of the others.  Half of the loss belongs to the patterns
    by their documents, half by their rows in the sample, so that neither the class prior nor a rare kind of text is lost.
    """
    able = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("hash")).filter("text IS NOT NULL")

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for b in lean(batches):
            for at, part in chunks(b["text"].tolist(), 1 << 18):
                votes, _ = observe(part, powers, shapes=False)
                yield pd.DataFrame({"hash": b["hash"].to_numpy()[at:at + len(part)], "votes": [x.tobytes() for x in votes]})

    said = stored(able.mapInPandas(vote, "hash long, votes binary"), "votes")
    seen = said.groupBy("votes").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).toPandas()
    if not len(seen):
        return None
    seen = seen.sort_values("votes", kind="stable").reset_index(drop=True)
    patterns = np.frombuffer(b"".join(seen["votes"]), np.int8).reshape(len(seen), len(LABELLERS)).astype(int)
    counts = seen["n"].to_numpy().astype(float)
    # a text that any labeller puts down starts as likely bad: each sees its own kind of bad text
    labels, target = weak.fit_labels(
        patterns, PRIOR, correlated=False, start=np.where((patterns < 0).any(1), 0.1, 0.95), counts=counts)

    texts = seen["texts"].to_numpy()
    take = quotas(texts, max_rows)
    # hashes are even over the 64 bits, so a pattern's least ones are its quota's share of them
    most = [2**63 - 1 if k >= t else int((k / t) * 2**64) - 2**63 for k, t in zip(take.tolist(), texts.tolist())]
    limits = docs.sparkSession.createDataFrame(
        list(zip(map(bytearray, seen["votes"]), range(len(seen)), most)), "votes binary, pattern int, most long")
    chosen = said.join(limits, "votes").filter("hash <= most").groupBy("hash").agg(F.min("pattern").alias("pattern"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for b in lean(batches):
            for at, part in chunks(b["text"].tolist(), 1 << 18):
                _, shares = observe(part, powers)
                full = [np.flatnonzero(x) for x in shares]
                yield pd.DataFrame({
                    "hash": b["hash"].to_numpy()[at:at + len(part)], "pattern": b["pattern"].to_numpy()[at:at + len(part)],
                    "columns": [f.astype(np.int32).tobytes() for f in full],
                    "shares": [x[f].tobytes() for x, f in zip(shares, full)]})

    # about max_rows distinct texts, each with at most WIDTH features, reach the driver
    drawn = able.join(F.broadcast(chosen), "hash").mapInPandas(look, "hash long, pattern int, columns binary, shares binary")
    drawn = drawn.dropDuplicates(["hash"]).toPandas().sort_values("hash", kind="stable")
    group = drawn["pattern"].to_numpy()
    size = np.bincount(group, minlength=len(seen))
    by_documents = (counts / np.maximum(size, 1))[group]
    share = 0.5 * by_documents / by_documents.sum() + 0.5 / len(drawn)
    row = np.repeat(np.arange(len(drawn)), [len(x) // 4 for x in drawn["columns"]])
    column = np.frombuffer(b"".join(drawn["columns"]), np.int32).astype(int)
    value = np.frombuffer(b"".join(drawn["shares"]), np.float32).astype(float)
    return Model(labels, weak.fit_linear(row, column, value, target[group], WIDTH, steps=200, share=share))


def score(text: Column, model: Model | None) -> Column:
    """Probability (0 to 1) that a whole text is of high quality; 0 for null, for a text without words, and without a model."""

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = Powers()
        for s in lean(batches):
            out = np.zeros(len(s))
            if model is not None:
                for at, part in chunks(s.fillna("").tolist(), 1 << 18):
                    _, shares = observe(part, powers)
                    p = 1 / (1 + np.exp(-np.clip(shares @ model.linear.weights + model.linear.bias, -50, 50)))
                    out[at:at + len(part)] = np.where(shares.any(1), p, 0.0)
            yield pd.Series(out)

    return udf(text)
