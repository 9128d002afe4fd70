"""Vectorised splitting of texts by the pattern of the public byte-level tokenizers.

The pattern (a fixed value of the tokenizers) is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Code points are classed by table (letter, number, white space, other) and the borders of
the matches follow from where classes change, so a whole Arrow batch is split by a few
array operations; tests compare it with the pattern itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .common import SpanHasher, ragged

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_TAILS = {2: (ord("s"), ord("t"), ord("m"), ord("d")), 3: (("r", "e"), ("v", "e"), ("l", "l"))}


def class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = [(LETTER, regex.compile(r"\p{L}+")), (NUMBER, regex.compile(r"\p{N}+")), (SPACE, regex.compile(r"\s+"))]
    for first in range(0, 0x110000, 0x800):
        if first == 0xD800:  # surrogates are no characters
            continue
        points = "".join(map(chr, range(first, first + 0x800)))
        for kind, pattern in kinds:
            for m in pattern.finditer(points):
                out[first + m.start() : first + m.end()] = kind
    return out


@lru_cache
def library_classes() -> np.ndarray:
    """The same by the tokenizers library's own regular expressions, whose Unicode version may differ."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        cut = Split(Regex(pattern), "removed")
        for first in range(0, 0x110000, 0x800):
            if first == 0xD800:  # surrogates are no characters
                continue
            mine = np.ones(0x800, bool)
            for _, (a, z) in cut.pre_tokenize_str("".join(map(chr, range(first, first + 0x800)))):
                mine[a:z] = False
            out[first : first + 0x800][mine] = kind
    return out


class Splitter:
    def __init__(self, classes: np.ndarray | None = None):
        self.classes = class_table() if classes is None else classes

    def split(self, points: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Start (in code points) of every match; ``docs``: starts of the non-empty documents."""
        n = len(points)
        kind = self.classes[points]
        head = np.zeros(n + 1, bool)
        head[docs] = True
        head[n] = True
        edge = head.copy()
        edge[1:n] |= kind[1:] != kind[:-1]
        # a last blank of white space belongs to the run that follows it
        before = np.flatnonzero(edge[1:n] & ~head[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE))
        cut = edge.copy()
        blank = points[before] == 32
        lead, other = before[blank], before[~blank]
        cut[lead + 1] = False
        cut[lead] = True  # " x": the match starts at the blank
        # \s+(?!\S) leaves the last white-space character: it is a match of its own if no blank
        cut[other] = True
        # contractions: an apostrophe that starts a match, then s t m d re ve ll
        quote = np.flatnonzero((points == 39) & edge[:n])
        quote = quote[~self._led(quote, head, points)]
        if len(quote):
            p = np.concatenate([points, np.zeros(2, points.dtype)])
            open1 = ~head[quote + 1]
            open2 = open1 & ~head[np.minimum(quote + 2, n)]
            two = open1 & np.isin(p[quote + 1], _TAILS[2])
            three = np.zeros(len(quote), bool)
            for a, b in _TAILS[3]:
                three |= open2 & (p[quote + 1] == ord(a)) & (p[quote + 2] == ord(b))
            three &= ~two
            for hit, size in ((two, 2), (three, 3)):
                q = quote[hit]
                cut[q] = True
                cut[q + 1] = False
                cut[q + size] = True
        return np.flatnonzero(cut[:n])

    @staticmethod
    def _led(at: np.ndarray, head: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Whether a blank before the position joins its match."""
        return (at > 0) & ~head[at] & (points[np.maximum(at - 1, 0)] == 32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the length of each."""
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct key, number of the distinct key of every place).

    Every place writes itself into a slot by the key's first bits; where the one that stayed has
    another key, the few left are sorted.
    """
    bits = max(10, int(len(key)).bit_length() + 1)
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    table = np.empty(1 << bits, np.int32)
    table[slot] = np.arange(len(key), dtype=np.int32)
    sample = table[slot]
    left = np.flatnonzero(key[sample] != key)
    if len(left):
        order = left[np.argsort(key[left], kind="stable")]
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        sample[order] = order[new][np.cumsum(new) - 1]
    first = np.zeros(len(key), bool)
    first[sample] = True
    return np.flatnonzero(first), (np.cumsum(first) - 1)[sample]


class WordBatch:
    """The distinct matches of a batch of texts, and each text as a list of them."""

    def __init__(self, texts: list[str], splitter: Splitter, hasher: SpanHasher):
        points, lens = code_points(texts)
        first = np.cumsum(lens) - lens
        at = splitter.split(points, first[lens > 0])
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        start = byte[at]
        stop = np.append(start[1:], byte[-1])
        #: bytes of the batch, and spans of its matches
        self.buf = np.frombuffer("".join(texts).encode(), np.uint8)
        self.per_text = np.diff(np.searchsorted(at, np.append(first, len(points))))
        self.bytes_per_text = np.diff(byte[np.append(first, len(points))])
        hasher.load(self.buf)
        key = hasher.spans(start, stop)
        sample, self.word = distinct(key)
        #: keys of the distinct matches, and one span of each
        self.keys, self.start, self.stop = key[sample], start[sample], stop[sample]


class KeySlots:
    """Numbers of 64-bit keys in the order they were added, in a table of slots by first bits; a key
    whose slot is taken goes to the next free one."""

    def __init__(self, most: int):
        self.bits = int(most).bit_length() + 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << 12, np.uint64)
        self.n = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those not added."""
        out = np.full(len(keys), -1, np.int64)
        live, at = np.arange(len(keys)), self._home(keys)
        while len(live):
            held = self.slots[at]
            found = held >= 0
            found[found] = self.keys[held[found]] == keys[live[found]]
            out[live[found]] = held[found]
            on = (held >= 0) & ~found
            live, at = live[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        self.keys = grown(self.keys, self.n)
        self.keys[number] = keys
        at = self._home(keys)
        while len(number):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]  # the last of those that want a slot has it
            on = self.slots[at] != number
            number, at = number[on], (at[on] + 1) & ((1 << self.bits) - 1)


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for n entries at least, twice as many as before when it has to grow."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class WordCache:
    """Token ids of words by hash, kept over the batches of a task up to ``limit`` words."""

    def __init__(self, encode, limit: int = 1 << 20):
        self.encode, self.limit = encode, limit
        self.known = KeySlots(2 * limit)
        self.at, self.n, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0

    def ids_of(self, w: WordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids per text)."""
        if self.known.n > self.limit:
            self.__init__(self.encode, self.limit)
        at = self.known.find(w.keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, n = self.encode(w.buf, w.start[new], w.stop[new])
            at[new] = np.arange(self.known.n, self.known.n + len(new))
            self.known.add(w.keys[new])
            if self.known.n > 2 * self.known.slots.size // 3:  # one batch of more new words than the table is for
                raise ValueError("a batch has too many different words; make it smaller")
            self.at, self.n, self.ids = grown(self.at, self.known.n), grown(self.n, self.known.n), grown(self.ids, self.used + len(ids))
            self.at[at[new]], self.n[at[new]] = self.used + np.cumsum(n) - n, n
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        n = self.n[at][w.word]
        out = self.ids[ragged(self.at[at][w.word], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        word_ends = np.concatenate([[0], np.cumsum(w.per_text)])
        return out, np.diff(ends[word_ends])
