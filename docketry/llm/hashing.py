"""Word hashes and shingle sets of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(0x21, bool)
SPACES[[*range(0x09, 0x0E), 0x20]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as far as the longest text needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


def alphanumeric() -> np.ndarray:
    """By code point: whether it is a letter or a digit."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def word_hashes(texts: list[str], powers: Powers, is_word: np.ndarray | None = None, stem: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and where each text's words begin (one more entry at the end).

    With ``stem``, also hashes of the words' first ``stem`` characters (0 for words no longer than that).

    A word is a run of characters that are not ASCII white space, or of those that ``is_word`` (by code point) marks.  Its
    hash is a difference of prefix sums, so no word is looked at by itself.
    """
    joined = " ".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if is_word is None:
        inside = points > 0x20
        low = ~inside
        inside[low] = ~SPACES[points[low]]
    else:
        inside = is_word[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    inside[ends] = False
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    powers.upto(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    values = (points.astype(np.uint64) + np.uint64(0x1F3)) * np.uint64(0xC2B2AE3D27D4EB4F)
    values ^= values >> np.uint64(29)
    np.cumsum(values * powers.up[:len(points)], out=total[1:])
    hashes = mixed((total[stop] - total[start]) * powers.down[start] + (stop - start).astype(np.uint64))
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    if not stem:
        return hashes, first
    cut = np.minimum(start + stem, stop)
    stems = mixed((total[cut] - total[start]) * powers.down[start], 5)
    return hashes, first, np.where(stop - start > stem, stems, np.uint64(0))


def shingle_sets(texts: list[str], size: int, powers: Powers) -> list[np.ndarray]:
    """The set of ``size``-word shingles of each text as sorted distinct hashes; shorter texts have one shingle of all words."""
    words, first = word_hashes(texts, powers)
    sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        sums += words[k:k + len(sums)] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    sums = mixed(sums, 1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(sums[a:b - size + 1]))
        elif b > a:
            weight = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(b - a)], np.uint64)
            out.append(mixed((words[a:b] * weight).sum(keepdims=True, dtype=np.uint64), 2 + b - a))
        else:
            out.append(words[:0])
    return out


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters with the number of the first; a longer text makes a run of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > size:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]
