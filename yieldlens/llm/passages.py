"""Removal of repeated passages, measured in words.

A passage is removed when a run of at least ``words`` words that covers it also starts
anywhere else in the input. Every word is replaced by the four bytes of its hash, so that
``words`` words are a string of fixed length, and the suffix sorting of ``suffixdedup`` finds
the repeats of those strings; only starts on a word count. Words are runs without blanks
(Unicode's, as in ``str.split``); each kana or Han character is a word, other scripts without blanks
have one word from blank to blank. ASCII signs at the edges of a word are no part of it, so
a passage is found whatever signs enclose it; blanks and signs between the words do not tell
passages apart, letter case does.

Two windows count as equal when the 32-bit hashes of all their words are: windows that differ
do so by chance in one of 2**32 pairs for every word in which they differ.

Edge cases: a null text counts as empty; texts of fewer words stay as they are; rows that
repeat a text repeat all its passages; what lies between two removed words goes too, what
encloses the passage stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SpanHasher, pieces, raw
from .suffixdedup import distinct_texts, repeat_spans

CODE = 4

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: blanks of two and three bytes
_WIDE = {n: np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in range(128, 1 << 16) if chr(c).isspace() and len(chr(c).encode()) == n)) for n in (2, 3)}


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of all texts (their borders are ``at``), without the signs at their edges."""
    n = len(buf)
    wide = np.append(buf, np.zeros(3, np.uint8)).astype(np.int64)
    blank = _BLANK[buf]
    p = np.flatnonzero(buf == 0xC2)
    p = p[np.isin(wide[p] << 8 | wide[p + 1], _WIDE[2])]
    blank[p] = blank[p + 1] = True
    p = np.flatnonzero((buf >= 0xE1) & (buf <= 0xE3))
    p = p[np.isin(wide[p] << 16 | wide[p + 1] << 8 | wide[p + 2], _WIDE[3])]
    blank[p] = blank[p + 1] = blank[p + 2] = True
    single = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9) & ~blank)
    double = np.flatnonzero((buf == 0xF0) & (wide[1 : n + 1] >= 0xA0))
    edge = np.zeros(n + 1, bool)  # a word may start here even after a word
    for p in (at, single, single + 3, double, double + 4):
        edge[p] = True
    inside = ~blank
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, blank[:-1])[:n]))
    stops = np.flatnonzero(inside & (edge[1:] | np.append(blank[1:], True)[:n])) + 1
    body = np.flatnonzero(~_SIGN[buf])
    if len(body):
        low = np.searchsorted(body, starts)
        high = np.searchsorted(body, stops)
        some = high > low
        starts = np.where(some, body[np.minimum(low, len(body) - 1)], starts)
        stops = np.where(some, body[high - 1] + 1, stops)
    return starts, stops


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the words' codes in place of the text."""
    hasher = SpanHasher()
    for b in pieces(batches, "text", 1 << 19):
        buf, at = raw(b.column("text"))
        hasher.load(buf)
        starts, stops = word_spans(buf, at)
        codes = hasher.spans(starts, stops).astype("<u4")
        cuts = (CODE * np.searchsorted(starts, at)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(codes.tobytes())])
        yield b.set_column(b.schema.get_field_index("text"), "text", column)


def _cut(words: int):
    """Batches of (id, text, spans of the codes) -> id, text without the passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 19):
            buf, at = raw(b.column("text"))
            starts, stops = word_spans(buf, at)
            first = np.searchsorted(starts, at)
            mark = np.zeros(len(buf) + 1, np.int32)
            for doc, spans in enumerate(b.column("spans").to_pylist()):
                if spans:
                    # runs of code starts; those between two words are chance
                    low = -(-np.array([s["lo"] for s in spans]) // CODE)
                    high = (np.array([s["hi"] for s in spans]) - 1) // CODE
                    low, high = low[low <= high], high[low <= high]
                    np.add.at(mark, starts[first[doc] + low], 1)
                    np.add.at(mark, stops[first[doc] + high + words - 1], -1)
            kept = np.cumsum(mark[:-1]) == 0
            cuts = np.append(0, np.cumsum(kept))[at].astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), b.num_rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(buf[kept].tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("id"), text.cast(pa.string())], names=["id", "kept_text"])

    return run


def remove_passages(docs: DataFrame, words: int = 51) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): ``docs`` with a column ``id`` (digest of the text), and one row per distinct
    text with id and kept_text, the text without its repeated passages."""
    rows, texts = distinct_texts(docs)
    spans = repeat_spans(texts, CODE * words, _coded)
    kept = texts.select("id", "text").join(spans, "id", "left").select("id", "text", "spans")
    return rows, kept.mapInArrow(_cut(words), "id binary, kept_text string")
