"""Byte-level BPE encoding and decoding over padded matrices.

The distinct matches of the splitting pattern in a batch are laid out as rows of matrices,
one matrix for each length class. In every round each live row merges its leftmost pair of
minimum rank; ranks are found in an open-addressing hash table of pairs, the merged row is
compacted by one place, and rows without a pair leave. Rows of more than ``LONG`` bytes
take the same merges from a heap, as one round per merge would cost the square of their
length. Texts are then put together from the ids of their matches.

Edge cases: null texts are empty and have no ids; a text that is one very long match is
encoded whole; rows may repeat; other columns are ignored. A vocabulary without a rank for
each of the 256 bytes raises a KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import SpanHasher, mix64, pieces, ragged
from .pretoken import Splitter, WordBatch, WordCache

LONG = 256
#: bytes of text (or ids) that a worker holds as arrays at a time
PIECE = 1 << 20
NONE = np.int32(0x7FFFFFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pairs: bool = True):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        by_rank = [b""] * size
        for t, r in ranks.items():
            by_rank[r] = t
        self.token_len = np.array([len(t) for t in by_rank], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        if pairs:
            self._load_pairs(ranks)

    def _load_pairs(self, ranks: dict[bytes, int]) -> None:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pair = {(a, b): m for a, b, m in zip(left, right, merged, strict=True)}
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(2 * len(key) + 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.vals = np.full(1 << bits, NONE, np.int32)
        slot, todo, self.probes = mix64(key) & self.mask, np.arange(len(key)), 0
        while len(todo):  # linear probing; the first of several that want a slot gets it
            self.probes += 1
            s = slot[todo].astype(np.int64)
            free = self.keys[s] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(s, return_index=True)
            first = np.zeros(len(s), bool)
            first[one] = True
            take = free & first
            self.keys[s[take]], self.vals[s[take]] = key[todo[take]], np.array(merged, np.int32)[todo[take]]
            todo = todo[~take]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none (an id below 0 is padding)."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slot = mix64(key) & self.mask
        out = np.full(key.shape, NONE, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = key[live], slot[live].astype(np.int64)
        for _ in range(self.probes):
            got = self.keys[slot]
            same = got == key
            out[live[same]] = self.vals[slot[same]]
            more = ~same & (got != np.uint64(0xFFFFFFFFFFFFFFFF))
            live, key, slot = live[more], key[more], (slot[more] + 1) & int(self.mask)
            if not len(live):
                break
        return out

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final (ids, lengths) of padded rows (-1): leftmost minimum-rank merges, one a row and round."""
        rows, width = ids.shape
        final = np.full_like(ids, -1)
        where = np.arange(rows)
        rank = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1) if width > 1 else np.zeros((rows, 0), np.int32)
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), int)
            low = rank[np.arange(len(ids)), best] if rank.shape[1] else np.full(len(ids), NONE)
            over = low == NONE
            if over.any():
                final[where[over], : ids.shape[1]] = ids[over]
                live = ~over
                ids, rank, where, best, low = ids[live], rank[live], where[live], best[live], low[live]
            if not len(ids):
                break
            k, width = np.arange(len(ids)), ids.shape[1]
            ids[k, best] = low
            keep = np.ones(ids.shape, bool)
            keep[k, best + 1] = False
            ids = ids[keep].reshape(len(k), width - 1)
            if width == 2:
                rank = np.zeros((len(k), 0), np.int32)
                continue
            keep = np.ones(rank.shape, bool)  # the merged pair's rank goes, its neighbours' are new
            keep[k, best] = False
            rank = rank[keep].reshape(len(k), width - 2)
            has_right = best < width - 2
            r, p = k[has_right], best[has_right]
            rank[r, p] = self.lookup(ids[r, p], ids[r, p + 1])
            has_left = best > 0
            r, p = k[has_left], best[has_left]
            rank[r, p - 1] = self.lookup(ids[r, p - 1], ids[r, p])
        return final, (final >= 0).sum(axis=1)

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one long row, with a heap of (rank, position)."""
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or self.pair.get((ids[i], ids[j])) != r:
                continue
            ids[i], live[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := self.pair.get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := self.pair.get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return [t for t, ok in zip(ids, live, strict=True) if ok]

    def encode_words(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words buf[start:stop] in turn, ids per word)."""
        size = stop - start
        n = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in [(0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32), (32, 64), (64, 128), (128, LONG)]:
            mine = np.flatnonzero((size > lo) & (size <= hi))
            for some in np.array_split(mine, max(1, -(-len(mine) * hi // (1 << 20)))):
                if len(some):
                    at = np.arange(hi)
                    inside = at < size[some, None]
                    ids = np.where(inside, self.byte[buf[np.where(inside, start[some, None] + at, 0)]], np.int32(-1))
                    out, k = self.merge_rows(ids)
                    n[some] = k
                    parts.append((some, out[out >= 0]))
        for w in np.flatnonzero(size > LONG):
            ids = np.array(self.merge_long(self.byte[buf[start[w] : stop[w]]].tolist()), np.int32)
            n[w] = len(ids)
            parts.append((np.array([w]), ids))
        begin = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.int32)
        for some, ids in parts:
            flat[ragged(begin[some], n[some])] = ids
        return flat, n

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in turn, bytes per text)."""
        lens = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return self.token_bytes[ragged(self.token_at[ids], lens)], np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


def _encode(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, splitter, hasher = Vocabulary(read_ranks(ranks_path)), Splitter(), SpanHasher()
        cache = WordCache(vocab.encode_words)
        for b in pieces(batches, "text", PIECE):
            words = WordBatch(b.column("text").to_pylist(), splitter, hasher)
            ids, n = cache.ids_of(words)
            packed = ids.astype("<u4")
            ends = np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int64)
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c != "text"], blob.cast(pa.binary())], names=[*[c for c in b.schema.names if c != "text"], "ids"])

    return run


def _digest(ranks_path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(read_ranks(ranks_path), pairs=False)
        for b in pieces(batches, "ids", PIECE):
            blobs = b.column("ids").to_pylist()
            n = np.array([len(x) // 4 for x in blobs], np.int64)
            text, size = vocab.decode(np.frombuffer(b"".join(blobs), "<u4").astype(np.int64), n)
            data, ends = text.tobytes(), np.concatenate([[0], np.cumsum(size)]).tolist()
            sha = [hashlib.sha256(x).hexdigest() for x in blobs]
            back = [hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(ends, ends[1:], strict=False)]
            rest = ["doc_id", "ids"] if keep_ids else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(n), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=[*rest, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def ranks_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encode_texts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every text."""
    return _texts(docs).mapInArrow(_encode(ranks_path), "doc_id bigint, ids binary")


def token_digests(encoded: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """Decode the ids and return n_tokens and the digests of ids and decoded bytes (and the ids)."""
    return encoded.mapInArrow(_digest(ranks_path, keep_ids), _digest_schema(keep_ids))


def _digest_schema(keep_ids: bool) -> str:
    ids = "ids binary, " if keep_ids else ""
    return f"doc_id bigint, {ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """``token_digests`` of ``encode_texts`` with both steps in one Python worker a task."""
    encode, digest = _encode(ranks_path), _digest(ranks_path, keep_ids)
    return _texts(docs).mapInArrow(lambda batches: digest(encode(batches)), _digest_schema(keep_ids))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), ranks_file())
