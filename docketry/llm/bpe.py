"""Byte-level BPE: pre-tokens from scans over codepoint classes, cached pair merging, and decoding by offsets."""

from __future__ import annotations

import heapq
from base64 import b64decode
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.llm.common import lean

ENCODED = "ids binary, offsets binary"
#: Code points scanned at once; a longer text is scanned alone.
CHUNK = 1 << 19
BLOCK = 256
CACHE_ENTRIES = 100_000
SHORT = 48

# --- codepoint classes, symbols and states of the pre-token automaton -----------------------------------
LETTER, NUMBER, OTHER, SPACE = range(4)
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_JOINED, S_LONE, S_STOP = range(9)
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, IN_JOINED, TWO_LEFT, ONE_LEFT, AT_START = range(8)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xF0000)):  # the planes between and above hold no letters
        every = np.arange(low, high, dtype="<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[low + m.start():low + m.end()] = kind
    table[WHITE_SPACE] = SPACE
    return table


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """For symbol * 8 + state: the next state, and whether a pre-token begins at the symbol.

    A contraction starts at an apostrophe only where a pre-token starts, so it is read through TWO_LEFT and ONE_LEFT; white
    space is split before its last character, which joins what follows if it is a blank.
    """
    to, begins = np.zeros(72, np.uint8), np.ones(72, bool)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_INNER: IN_SPACES}
    for state in range(8):
        for symbol in range(9):
            k = symbol * 8 + state
            if symbol in runs:
                to[k] = runs[symbol]
                begins[k] = state != runs[symbol] and not (state == IN_JOINED and symbol != S_INNER)
            elif symbol in (S_SHORT, S_LONG):
                inside = state in (IN_OTHERS, IN_JOINED)
                to[k] = IN_OTHERS if inside else TWO_LEFT if symbol == S_LONG else ONE_LEFT
                begins[k] = not inside
            else:
                to[k] = IN_JOINED if symbol == S_JOINED else AT_START
    to[S_LETTER * 8 + TWO_LEFT], begins[S_LETTER * 8 + TWO_LEFT] = ONE_LEFT, False
    to[S_LETTER * 8 + ONE_LEFT], begins[S_LETTER * 8 + ONE_LEFT] = AT_START, False
    return to, begins


def symbols(points: np.ndarray, table: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points; ``stops`` are the places of the marks that close each text."""
    kind = table[points]
    kind[stops] = SPACE  # what ends a text doesn't count as following a space
    out = kind.copy()
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:]
    out[space] = S_INNER
    out[last] = S_LONE
    out[last & (points == 0x20)] = S_JOINED
    quote = np.flatnonzero(points[:-1] == 0x27)
    if len(quote):
        a = points[quote + 1]
        b = points[np.minimum(quote + 2, len(points) - 1)]
        pair = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        out[quote[np.isin(a, (0x73, 0x74, 0x6D, 0x64))]] = S_SHORT
        out[quote[pair]] = S_LONG
    out[stops] = S_STOP
    return out


def boundaries(symbol: np.ndarray, to: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin, by a scan of transition functions.

    A symbol is a function from state to state, and composing functions is associative: blocks compose theirs side by side,
    block functions are scanned by doubling, and each block then runs once from the state it starts in.
    """
    n = len(symbol)
    blocks = -(-n // BLOCK)
    step = np.full(blocks * BLOCK, S_STOP, np.uint8)
    step[:n] = symbol
    step = np.ascontiguousarray(step.reshape(blocks, BLOCK).T) * np.uint8(8)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)
    for row in step:
        whole = to.take(row + whole)
    shift = 1
    while shift < blocks:
        # the function of blocks b - 2 * shift + 1 to b: first the earlier half, then the later one
        whole[:, shift:] = np.take_along_axis(whole[:, shift:], whole[:, :-shift].astype(np.intp), 0)
        shift *= 2
    state = np.full(blocks, AT_START, np.uint8)
    state[1:] = whole[AT_START, :-1]
    found = np.empty((BLOCK, blocks), bool)
    for row, into in zip(step, found):
        at = row + state
        begins.take(at, out=into)
        state = to.take(at)
    return np.flatnonzero(found.T.ravel()[:n])


class Decoder:
    """Bytes of every id, side by side."""

    def __init__(self, lines: list[bytes]):
        pairs = [(int(b), b64decode(a)) for a, b in map(bytes.split, filter(None, lines))]
        tokens = [b""] * (max(pairs, default=(-1, b""))[0] + 1)
        for rank, token in pairs:
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def offsets(self, packed: bytes) -> bytes:
        """Byte offset of each token in its text, packed like the ids."""
        size = self.lengths[np.frombuffer(packed, "<u4")]
        return (np.cumsum(size) - size).astype("<u4").tobytes()

    def decode(self, packed: bytes, offsets: bytes) -> bytes:
        """Bytes of the ids, each written at its offset."""
        ids, at = np.frombuffer(packed, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        size = self.lengths[ids]
        total = int(at[-1] + size[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.starts[ids] - at, size) + np.arange(total)].tobytes()


class Encoder(dict):
    """Ranks of byte strings, and a cache from pre-token to its ids, packed as little-endian unsigned 32-bit integers.

    A full cache becomes the old one, from which what is met again moves back; what isn't goes with the next change.
    """

    def __init__(self, lines: list[bytes]):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.ranks = {b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        self.table = class_table()
        self.to, self.begins = transitions()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        if (packed := self.old.get(piece)) is not None:
            self[piece] = packed
            return packed
        raw = piece.encode()
        known = self.ranks.get(raw)
        ids = [known] if known is not None else self.short(raw) if len(raw) <= SHORT else self.merged(raw)
        packed = np.array(ids, "<u4").tobytes()
        if len(raw) <= 256:
            self[piece] = packed
        return packed

    def short(self, raw: bytes) -> list[int]:
        """As ``merged``, by plain search; quicker for a word."""
        get, none = self.ranks.get, 1 << 31
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [get(raw[i:i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def merged(self, raw: bytes) -> list[int]:
        """Ids after merging, again and again, the leftmost pair of the lowest rank; a heap keeps the pairs."""
        ranks, n = self.ranks, len(raw)
        parts: list[bytes | None] = [raw[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = boundaries(symbols(points, self.table, ends), self.to, self.begins)
        cut = np.searchsorted(starts, ends)
        places, out, first = starts.tolist(), [], 0
        for end, stop in zip(ends.tolist(), cut.tolist()):
            at = places[first:stop] + [end]
            out.append(b"".join([self[joined[a:b]] for a, b in zip(at, at[1:])]))
            first = stop + 1
        return out


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def rank_lines(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return f.read().splitlines()


def encode(text: Column, path: str) -> Column:
    """struct of ``ids`` and ``offsets`` (bytes from the text's start), both as little-endian unsigned 32-bit integers.

    ``path`` is a file of ranks that every executor has, one base64 token and rank a line.  Each pre-token is merged by
    itself and no special tokens are known.  Null and empty texts have no ids; texts of any length are encoded whole.
    """

    @F.pandas_udf(ENCODED)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lines = rank_lines(path)
        encoder, decoder = Encoder(lines), Decoder(lines)
        for s in lean(batches):
            ids = [x for part in chunks(s.fillna("").tolist()) for x in encoder.encode(part)]
            yield pd.DataFrame({"ids": ids, "offsets": [decoder.offsets(x) for x in ids]})

    return udf(text)


def decode(ids: Column, offsets: Column, path: str) -> Column:
    """The bytes that packed ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        decoder = Decoder(rank_lines(path))
        for a, b in lean(batches):
            yield pd.Series([None if x is None else decoder.decode(x, y) for x, y in zip(a, b)], dtype=object)

    return udf(ids, offsets)


def recode(text: Column, path: str) -> Column:
    """struct of ``ids`` and ``offsets`` as ``encode`` gives them, and ``decoded``, the bytes that ``decode`` makes of them.

    Both in one worker, so that a round trip holds a batch once.
    """

    @F.pandas_udf(ENCODED + ", decoded binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lines = rank_lines(path)
        encoder, decoder = Encoder(lines), Decoder(lines)
        for s in lean(batches):
            ids = [x for part in chunks(s.fillna("").tolist()) for x in encoder.encode(part)]
            offsets = [decoder.offsets(x) for x in ids]
            yield pd.DataFrame({"ids": ids, "offsets": offsets, "decoded": [decoder.decode(x, y) for x, y in zip(ids, offsets)]})

    return udf(text)
