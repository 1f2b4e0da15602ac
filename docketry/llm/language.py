"""Language identification by a convolutional network over bytes, trained here on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import held_out, lean

UNKNOWN = "und"
WINDOW = 256
#: The bound of the training sample: documents a language, and windows a document.
PER_LANGUAGE = 300
PER_DOCUMENT = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
STEPS, BATCH, RATE = 500, 96, 0.01
AT_ONCE = 512


class Model(NamedTuple):
    """Byte vectors, one filter bank as wide as the widest filter, its bias, and the softmax layer."""

    names: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _patches(x: np.ndarray, wide: int) -> np.ndarray:
    """(windows, places, wide * EMBED): each place with the bytes that follow it."""
    n, length, e = x.shape
    return np.lib.stride_tricks.as_strided(
        x, (n, length - wide + 1, wide * e), (x.strides[0], x.strides[1], x.strides[2]), writeable=False)


def _pooled(model: Model, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    patches = _patches(model.embed[windows], max(WIDTHS))
    scores = np.matmul(patches.reshape(-1, patches.shape[2]), model.filters).reshape(*patches.shape[:2], -1)
    return scores.max(1), patches, scores


def probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    top = np.maximum(_pooled(model, windows)[0] + model.bias, 0)
    z = top @ model.out + model.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 7) -> Model:
    """Adam on the cross-entropy of single windows, cut to random lengths so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    wide, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(wide * EMBED) < w * EMBED, FILTERS).reshape(-1, FILTERS) for w in WIDTHS], 1)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.3, (wide * EMBED, n_filters)) * mask,
        "bias": np.zeros(n_filters), "out": rng.normal(0, 0.2, (n_filters, len(names))), "out_bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(labels == c) for c in range(len(names))]
    for step in range(1, STEPS + 1):
        picked = np.concatenate([rng.choice(c, BATCH // len(names) + 1) for c in by_class])
        x, y = windows[picked].copy(), labels[picked]
        size = np.where(rng.random(len(x)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(x)))
        x[np.arange(WINDOW)[None] >= size[:, None]] = 0
        model = Model(names, **p)
        top, patches, scores = _pooled(model, x)
        at = scores.argmax(1)
        h = np.maximum(top + p["bias"], 0)
        z = h @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dh = (d @ p["out"].T) * (h > 0)
        seen = patches[np.arange(len(x))[:, None], at]  # (windows, filters, wide * EMBED)
        g = {"out": h.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0), "filters": np.einsum("bfk,bf->kf", seen, dh) * mask}
        back = (dh[:, :, None] * p["filters"].T[None]).reshape(len(x), n_filters, wide, EMBED)
        bytes_at = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(wide)]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], bytes_at.ravel(), back.reshape(-1, EMBED))
        g["embed"][0] = 0
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return Model(names, **p)


def cut(raw: bytes) -> np.ndarray:
    """The whole text as windows of fixed length, the last one filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of the languages that labelled rows outside the held-out quarter name; None if there is none.

    The sample is bounded: ``PER_LANGUAGE`` documents a language, least hash of the text first, and ``PER_DOCUMENT`` windows
    spread over each.  Rows that repeat a text are one.  The number of a language's documents tells below
    which hash to look, with room to spare, so no text but those of the sample is moved.
    """
    able = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        ~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    able = able.select("lang", "text", F.xxhash64("text").alias("h"))
    several = able.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not several:
        return None
    # twelve standard deviations more than wanted, and the estimate's error
    share = {r["lang"]: min(1.0, (PER_LANGUAGE + 12 * PER_LANGUAGE ** 0.5) / 0.9 / r["n"]) for r in several}
    limit = F.lit(None).cast("long")
    for name, x in share.items():
        limit = F.when(F.col("lang") == name, F.lit(min((1 << 63) - 1, int((2 * x - 1) * (1 << 63))))).otherwise(limit)
    near = able.filter(F.col("h") <= limit).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in lean(batches):
            for lang_, h, text_ in zip(b["lang"], b["h"], b["text"]):
                w = cut(text_.encode())
                w = w[np.unique(np.linspace(0, len(w) - 1, PER_DOCUMENT).astype(int))]
                yield pd.DataFrame({"lang": lang_, "h": h, "nth": range(len(w)), "window": [x.tobytes() for x in w]})

    # about twice PER_LANGUAGE * PER_DOCUMENT windows a language reach the driver, which keeps the first documents
    sample = near.mapInPandas(windows, "lang string, h long, nth int, window binary").toPandas().sort_values(["lang", "h", "nth"])
    first = sample.drop_duplicates(["lang", "h"]).groupby("lang").head(PER_LANGUAGE)[["lang", "h"]]
    sample = sample.merge(first, on=["lang", "h"])
    names = sorted(sample["lang"].unique())
    matrix = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return train(matrix, sample["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), names)


def predict(text: Column, model: Model | None) -> Column:
    """struct of ``lang`` and ``score`` (0 to 1): the mean over all windows of the whole text, weighted by their bytes.

    Null texts, texts without a letter, and any text when there is no model are ``und`` with score 0.
    """

    @F.pandas_udf("lang string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in lean(batches):
            texts = [t if isinstance(t, str) and any(map(str.isalpha, t)) else "" for t in s]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            pending: list[tuple[int, np.ndarray, int]] = []
            sums: dict[int, np.ndarray] = {}

            def run():
                if not pending:
                    return
                w = np.concatenate([x for _, x, _ in pending])
                p = np.concatenate([probabilities(model, w[i:i + AT_ONCE]) for i in range(0, len(w), AT_ONCE)])
                at = 0
                for i, x, size in pending:
                    weight = np.full(len(x), WINDOW)
                    weight[-1] = size - WINDOW * (len(x) - 1)
                    sums[i] = weight @ p[at:at + len(x)] / size
                    at += len(x)
                pending.clear()

            held = 0
            for i, t in enumerate(texts):
                if t and model is not None:
                    raw = t.encode()
                    pending.append((i, cut(raw), len(raw)))
                    held += len(raw)
                    if held > AT_ONCE * WINDOW:
                        run()
                        held = 0
            run()
            for i, p in sums.items():
                names[i], scores[i] = model.names[int(p.argmax())], min(1.0, float(p.max()))
            yield pd.DataFrame({"lang": names, "score": scores})

    return udf(text)
