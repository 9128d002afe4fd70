"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark item gives the windows of ``words`` consecutive words (an item of fewer
words is one window). Documents and windows are brought to one form, lower-case words
between single blanks, so a window occurs on word borders exactly when its bytes occur.
The search moves many text segments in step: a shift table over hashed byte blocks says
how far each may jump without missing a pattern; where the shift is zero the hash of the
last block selects a bucket of test patterns, and direct comparison confirms. Patterns
are searched by classes of length, as short ones limit the shifts of a class.

The benchmark is not assumed small: items are taken in blocks of at most ``BLOCK_BYTES``
of text that Spark writes to the shared folder; tasks open them by number, and each is searched
in a pass of its own (Arrow batches, no
shuffle), and the passes hand their findings on in the row.

Edge cases: null or empty texts have no words; null item texts and items without words are
ignored; a null item_id counts as an item named by the empty string; repeated items count
once per item_id; repeated documents give a row each; other columns are passed on, and
replaced where they have the name of a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import running_sums
from ..session import table
from .common import pieces, ragged, shared_path, written

BLOCK_BYTES = 8 << 20
SEGMENT = 4096
TABLE_BITS = 20
_ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
# fixed by the contract: words are runs of 0-9, a-z (after lower-casing A-Z) and bytes from 0x80
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class WuManber:
    """Searcher for patterns of at least ``shortest`` bytes (their last block may be shared)."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.shortest = min(map(len, patterns))
        self.block = min(8, self.shortest)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        buf = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        lens = np.array([len(p) for p in patterns])
        first = np.cumsum(lens) - lens
        self.buf, self.first, self.lens = buf, first, lens
        # shift: distance from a block to the end of the first ``shortest`` bytes, smallest kept
        far = self.shortest - self.block
        shift = np.full(1 << TABLE_BITS, far + 1, np.int32)
        for at in range(far + 1):
            np.minimum.at(shift, self.hash_at(buf, first + at), far - at)
        self.shift = shift
        # buckets of patterns by the hash of the block that ends the first ``shortest`` bytes
        key = self.hash_at(buf, first + far)
        self.order = np.argsort(key, kind="stable")
        self.bucket = np.searchsorted(key[self.order], np.arange((1 << TABLE_BITS) + 1))

    def hash_at(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        v = (words[at] & self.mask) * np.uint64(0x9E3779B97F4A7C15)
        return (v >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, buf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all occurrences in buf[:size]; eight spare bytes must follow."""
        far = self.shortest - self.block
        at = np.arange(0, max(size - self.shortest + 1, 0), SEGMENT, dtype=np.int64)
        stop = np.minimum(at + SEGMENT, size - self.shortest + 1)  # window starts of the segment
        found = []
        while len(at):
            jump = self.shift[self.hash_at(buf, at + far)]
            zero = jump == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        key = self.hash_at(buf, at + far)
        n = self.bucket[key + 1] - self.bucket[key]
        pat = self.order[ragged(self.bucket[key], n)]
        at = np.repeat(at, n)
        keep = at + self.lens[pat] <= size
        at, pat = at[keep], pat[keep]
        # direct comparison, eight bytes at a time, the last ones overlapping
        text, own = (np.ndarray((len(b) - 7,), "<u8", b, 0, (1,)) for b in (buf, self.buf))
        live = np.arange(len(at))
        off = 0
        good = [np.zeros(0, np.int64)]
        while len(live):
            left = self.lens[pat[live]] - off
            short = left < 8
            bits = np.where(short, np.maximum(left, 0) * 8, 0).astype(np.uint64)
            mask = np.where(short, (np.uint64(1) << bits) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            ok = ((text[at[live] + off] ^ own[self.first[pat[live]] + off]) & mask) == 0
            good.append(live[ok & (left <= 8)])
            live = live[ok & (left > 8)]
            off += 8
        hit = np.sort(np.concatenate(good))
        return at[hit], pat[hit]


def windows_of(items: list[tuple[str, str]], words: int) -> tuple[list[bytes], list[int], list[list[int]]]:
    """Distinct window patterns, their word counts, and the items (indexes) of each."""
    index: dict[bytes, int] = {}
    sizes: list[int] = []
    owners: list[list[int]] = []
    for k, (_, text) in enumerate(items):
        w = words_of(text)
        size = min(words, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            p = b" " + b" ".join(w[i : i + size]) + b" "
            j = index.setdefault(p, len(index))
            if j == len(sizes):
                sizes.append(size)
                owners.append([])
            if not owners[j] or owners[j][-1] != k:
                owners[j].append(k)
    return list(index), sizes, owners


def find_windows(texts: list, items: list[tuple[str, str]], searchers: list, sizes, owners) -> list[tuple[int, list, list]]:
    """Per text: number of words, hit spans [first word, words) and the ids of items met."""
    split = [words_of(t) for t in texts]
    norm = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
    lens = np.array([len(x) for x in norm])
    first = np.cumsum(lens) - lens
    size = int(lens.sum())
    buf = np.frombuffer(b"".join(norm) + bytes(8), np.uint8)
    blanks = np.flatnonzero(buf[:size] == 32)
    base = np.searchsorted(blanks, first)
    out = [(len(w), [], set()) for w in split]
    for base_no, searcher in searchers:
        at, pat = searcher.search(buf, size)
        doc = np.searchsorted(first + lens, at, "right")
        word = np.searchsorted(blanks, at) - base[doc]
        for d, w, p in zip(doc.tolist(), word.tolist(), (pat + base_no).tolist(), strict=True):
            out[d][1].append((w, sizes[p]))
            out[d][2].update(items[o][0] for o in owners[p])
    return [(n, spans, sorted(met)) for n, spans, met in out]


def make_searchers(items: list[tuple[str, str]], words: int):
    pats, sizes, owners = windows_of(items, words)
    order = sorted(range(len(pats)), key=lambda i: len(pats[i]))
    pats, sizes, owners = [pats[i] for i in order], [sizes[i] for i in order], [owners[i] for i in order]
    searchers, at = [], 0
    while at < len(pats):  # a class holds patterns of up to twice its shortest length
        stop = at
        while stop < len(pats) and len(pats[stop]) <= max(8, 2 * len(pats[at])):
            stop += 1
        searchers.append((at, WuManber(pats[at:stop])))
        at = stop
    return searchers, sizes, owners


def _pass(path: str, number: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = read_block(path, number)
        searchers, sizes, owners = make_searchers(items, words)
        for b in pieces(batches, "text", 2 << 20):
            found = find_windows(b.column("text").to_pylist(), items, searchers, sizes, owners)
            spans = [(old or []) + [x for s in f[1] for x in s] for old, f in zip(b.column("__spans").to_pylist(), found, strict=True)]
            met = [sorted({*(old or []), *f[2]}) for old, f in zip(b.column("__items").to_pylist(), found, strict=True)]
            new = {"__spans": pa.array(spans, pa.list_(pa.int32())), "__items": pa.array(met, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_hit, n_items, sha = [], [], [], []
        for text, spans, items in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), b.column("__items").to_pylist(), strict=True):
            n = len(words_of(text))
            mark = np.zeros(n + 1, np.int32)
            if spans:
                s = np.array(spans).reshape(-1, 2)
                np.add.at(mark, s[:, 0], 1)
                np.add.at(mark, s[:, 0] + s[:, 1], -1)
            n_words.append(n)
            n_hit.append(int((np.cumsum(mark[:-1]) > 0).sum()))
            n_items.append(len(items or []))
            sha.append(hashlib.sha256(",".join(items or []).encode()).hexdigest())
        cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_())]
        keep = [n for n in b.schema.names if n not in ("__spans", "__items", *_ADDED)]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + cols, names=[*keep, *_ADDED])


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> tuple[str, int]:
    """Write the distinct (item_id as string, text) to the shared folder in blocks of about ``limit``
    characters (folders ``block=0``, ``block=1``, …); return the path and the number of blocks."""
    rows = items.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    sized = running_sums(rows, [], ["item_id", "text"], {"upto": F.length("text")})
    block = F.floor((F.col("upto") - F.length("text")) / F.lit(limit)).cast("int")
    # a block may be left out where one long item covers it
    sized = written(sized.select("item_id", "text", block.alias("start")), "item-sizes")
    numbers = sized.select("start").distinct().sort("start").withColumn("block", F.row_number().over(W.orderBy("start")) - 1)  # one row a block
    path = shared_path(items.sparkSession, "item-blocks")
    sized.join(F.broadcast(numbers), "start").select("item_id", "text", "block").write.partitionBy("block").parquet(path)
    return path, numbers.count()


def read_block(path: str, number: int) -> list[tuple[str, str]]:
    """The items of a block, read inside a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(f"{path}/block={number}")
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".parquet"))
    rows = [pq.read_table(f, filesystem=store, columns=["item_id", "text"], partitioning=None) for f in files]
    return [r for t in rows for r in zip(t.column("item_id").to_pylist(), t.column("text").to_pylist(), strict=True)]


def contamination(docs: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """``docs`` (with a column text) plus n_words, n_hit, n_items, items_sha256, contaminated."""
    out = docs.withColumn("__spans", F.lit(None).cast("array<int>")).withColumn("__items", F.lit(None).cast("array<string>"))
    out = out.withColumn("text", F.coalesce("text", F.lit("")))
    search = None
    path, blocks = item_blocks(items)
    for number in range(blocks):
        if search:
            out = out.mapInArrow(search, out.schema)
        search = _pass(path, number, words)
    # the last block's worker also writes the report
    report = _report if search is None else lambda batches: _report(search(batches))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in _ADDED)
    return out.mapInArrow(report, f"{fields}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")
