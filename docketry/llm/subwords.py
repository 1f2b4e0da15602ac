"""Whole texts through the public tokenizer libraries, and texts cut into words where no token reaches over.

A text may be cut at every blank that follows a character other than white space.  No token of either kind of vocabulary
reaches over such a place: a byte-level pre-token holds white space only at its beginning or alone, and no piece holds the
mark of a blank after another character (checked when a model is loaded).  So parts of a text between such places can be
encoded one by one, each with the blank before it, and give the ids of the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np

#: Characters encoded in one go; a longer text goes alone.
BLOCK = 1 << 18
CUT = re.compile(r"(?<=\S) ")
BLANK = "▁"


def blocks(texts: list, most: int = BLOCK, size: Callable = len) -> Iterator[tuple[int, list]]:
    """(place of the first, texts): consecutive texts of together at most ``most`` characters, or one longer text."""
    first, held = 0, 0
    for i, n in enumerate(map(size, texts)):
        if i > first and held + n > most:
            yield first, texts[first:i]
            first, held = i, 0
        held += n + 1
    if first < len(texts):
        yield first, texts[first:]


def parts(text: str | None, most: int | None = None) -> list[str | None]:
    """A text in parts of about ``most`` characters, without the blank that each but the first begins with; [None] for no text."""
    most = most or BLOCK
    if not text:
        return [None]
    if len(text) <= most:
        return [text]
    return [" ".join(words) for _, words in blocks(CUT.split(text), most)]


class BytePairs:
    """A byte-level vocabulary file of the ``tokenizers`` library, encoded by tiktoken, which is six times as fast.

    Both give the same ids if merges are in order of ids, which is checked here; the tests compare them for every code point.
    ``plain`` makes the strings of special tokens inside texts ordinary text, as ``encode_special_tokens`` does there.
    """

    def __init__(self, path: str, plain: bool):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind, vocabulary = file["pre_tokenizer"], file["model"]["vocab"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in file["model"]["merges"]]
        made = [vocabulary["".join(m.split(" "))] for m in merges]
        if file["normalizer"] or (kind["type"], kind["add_prefix_space"], kind["use_regex"]) != ("ByteLevel", False, True) or made != sorted(made):
            raise ValueError(f"{path} is not a plain byte-level vocabulary with merges in order of ids")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = sorted(set(range(256)).difference(printable))
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in entry): i for entry, i in vocabulary.items() if entry not in special}
        self.model = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed: set[str] = set() if plain else set(special)
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes[i] = token

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())


class Pieces:
    """A piece model of the ``sentencepiece`` library, which puts a blank before every text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        over = re.compile(f"[^{BLANK}]{BLANK}")
        if any(over.search(p) for p in pieces) or self.model.encode("a", out_type=str)[0][0] != BLANK:
            raise ValueError("texts can't be encoded in parts: a piece reaches over a blank, or texts get none before them")
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id(BLANK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of parts of texts; one of nothing but the blank before it has that, where the library gives nothing."""
        return [ids if t else [self.blank] for t, ids in zip(texts, self.model.encode(texts, num_threads=1))]


class Flat:
    """The bytes of all ids, side by side."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids one after another, the place at which each ends)."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], end

