"""Words of texts for tokenizers whose tokens never reach over a blank that follows another character.

A text is cut before every blank that follows a character other than white space; each distinct
word is encoded once while a task remembers it, many words in one call of the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

from .common import ragged

SPACED = re.compile(r"\s ")
#: bytes of words encoded at a time, words remembered by a task
JOINED, REMEMBERED = 1 << 11, 120_000


def bytes_of_unicode() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Side:
    """Token bytes, their number, and the id as text before each separator."""

    def load(self, tokens: dict[int, bytes], marks: str) -> None:
        n = max(tokens) + 1
        self.bytes = np.array([tokens.get(i, b"") for i in range(n)] + [None], object)[:-1]
        self.size = np.array([len(t) for t in self.bytes], np.int64)
        self.shown = np.array([[f"{i}{m}" for i in range(n)] for m in marks], object)
        self.line = self.encode(["\n"])[0][-1]


class ByteLevel(Side):
    """A: a tokenizers file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = bytes_of_unicode()
        self.load({i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}, ",|")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as it is."""
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word with its blank."""
        return self.encode([" " + w for w in words])


def words_of(text: str) -> list[str]:
    """Words of a blank and ``text``, each without its first blank: cut before every blank that follows a
    character other than white space."""
    parts = text.split(" ")
    if not text.startswith(" ") and not SPACED.search(text):
        return parts
    out = []
    whole = True  # whether the last word may end here
    for part in parts:
        if whole:
            out.append(part)
        else:
            out[-1] += " " + part
        whole = part != "" and not part[-1].isspace()
    return out


def encode_words(plain: list[str], alone: list[str], side: Side) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in turn and their number a word. ``plain`` words (no line feed, no white space
    at their end) are encoded many at a time, a line each, ``alone`` ones each for itself."""
    groups, held, size = [], [], 0
    for w in plain:
        held.append(w)
        size += len(w)
        if size >= JOINED:
            groups.append("\n ".join(held) + "\n")
            held, size = [], 0
    if held:
        groups.append("\n ".join(held) + "\n")
    found = [np.array(ids, np.int64) for ids in side.words(groups)]
    flat = np.concatenate([np.zeros(0, np.int64), *found])
    line = flat == side.line
    n = np.diff(np.flatnonzero(line), prepend=-1) - 1
    rest = side.words(alone)
    ids = np.concatenate([flat[~line], *[np.array(x, np.int64) for x in rest]])
    return ids, np.concatenate([n, [len(x) for x in rest]]).astype(np.int64)


class Remembered:
    """Numbers of words, kept over the batches of a task until there are more than REMEMBERED."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        #: where each word, in the order of meeting, was added
        self.place = np.zeros(0, np.int64)

    def add(self, plain: list[str], alone: list[str]) -> None:
        """Take the next words: those for one call together, then those for a call each."""
        raise NotImplementedError

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of every word; those not met before are added."""
        if len(self.number) > REMEMBERED:
            self.clear()
        known, put, size = len(self.number), self.number.setdefault, self.number.__len__
        at = np.array([put(w, size()) for w in words], np.int64)
        new = list(islice(self.number, known, None))
        if new:
            is_alone = np.array([not w or "\n" in w or w[-1].isspace() for w in new], bool)
            plain = [w for w, a in zip(new, is_alone.tolist(), strict=True) if not a]
            alone = [w for w, a in zip(new, is_alone.tolist(), strict=True) if a]
            place = np.empty(len(new), np.int64)
            place[~is_alone] = known + np.arange(len(plain))
            place[is_alone] = known + len(plain) + np.arange(len(alone))
            self.place = np.concatenate([self.place, place])
            self.add(plain, alone)
        return self.place[at]


class WordIds(Remembered):
    """Ids of texts by one side, word by word."""

    def __init__(self, side: Side):
        self.side = side
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.ids, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, plain: list[str], alone: list[str]) -> None:
        ids, n = encode_words(plain, alone, self.side)
        self.ids, self.n = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.n, n])

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as it is: its first word has no blank before it and is encoded apart."""
        parts = [words_of(t) for t in texts]
        first = self.side.encode([p[0] for p in parts])
        every = self.numbers([w for p in parts for w in p[1:]])
        ends = np.cumsum([len(p) - 1 for p in parts])
        n = self.n[every]
        flat = self.ids[ragged((np.cumsum(self.n) - self.n)[every], n)]
        cuts = np.concatenate([[0], np.cumsum(n)])[ends]
        return [np.concatenate([np.array(f, np.int32), x]) for f, x in zip(first, np.split(flat, cuts[:-1]), strict=True)]
