"""Suffix-array removal of repeated byte strings.

A document's byte is removed when a string of ``length`` bytes that covers it also starts
anywhere else in the input. The suffixes are dealt out by content: each start p owns the
smallest hash of the 128-byte grams inside its window, so equal windows always share that
key (a minimiser), and neighbouring starts mostly share it too, so a run of starts travels
as one region of text. Keys met once, in one place, cannot hold a repeat and are dropped before any text
moves. Each group of regions is then suffix-sorted by two-stage sorting: the suffixes
smaller than their successors are sorted directly, the others are induced from them by
scanning the buckets in order, and common prefixes of neighbours tell the repeats.

Equal texts are collapsed to one row with a count before anything else, and equal regions
before the sort. A key whose distinct regions are too many for one sort (``GROUP_BYTES``)
is salted: each part is sorted alone, and the distinct windows that remain single in their
part are matched across parts by a grouped count of their digests. Nothing is capped.

Edge cases: a null text counts as empty; texts shorter than ``length`` keep all bytes;
rows that repeat a text repeat all its windows; nulls and ties in doc_id are carried
through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import SpanHasher, offsets, pieces, ragged, raw, written

GRAM = 128
GROUP_BYTES = 2 << 20
MAX_RUN = 4096
#: suffixes whose bytes are compared as strings at a time, and windows sent on at a time
SORTED_AT_ONCE, SENT_AT_ONCE = 1 << 15, 1 << 15


# ---------------------------------------------------------------- suffix sorting


def two_stage_order(buf: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``wanted`` in the order of their suffixes, compared to ``depth`` bytes at least.

    ``wanted`` must be closed under "larger than the successor": with a suffix that is not
    smaller than its successor, the successor is wanted too (see ``close``). Stage one sorts
    the suffixes smaller than their successors; stage two induces the others: scanning the
    buckets of first bytes upwards, each suffix in its final place puts its predecessor, if
    that is larger, at the next free place of the predecessor's bucket.
    """
    is_small = smaller(buf)
    is_wanted = np.zeros(len(buf) + 1, bool)
    is_wanted[wanted] = True
    small = wanted[is_small[wanted]]
    small = sort_suffixes(buf, small, depth)
    cuts = np.searchsorted(buf[small], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def induce(done: np.ndarray, c: int) -> np.ndarray:
        """Hand the larger predecessors to their buckets; return those of bucket c itself."""
        prev = done[done > 0] - 1
        prev = prev[is_wanted[prev] & ~is_small[prev]]
        heads = buf[prev]
        own = prev[heads == c]
        prev, heads = prev[heads > c], heads[heads > c]
        if len(prev):
            by = np.argsort(heads, kind="stable")
            prev, heads = prev[by], heads[by]
            at = np.flatnonzero(np.diff(heads)) + 1
            for part in np.split(prev, at):
                pending[buf[part[0]]].append(part)
        return own

    # the suffix after the last byte is empty and smallest
    last = len(buf) - 1
    if last >= 0 and is_wanted[last] and not is_small[last]:
        pending[buf[last]].append(np.array([last], np.int64))
    for c in range(256):
        fresh = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        pending[c] = []
        while len(fresh):
            order.append(fresh)
            fresh = induce(fresh, c)
        direct = small[cuts[c] : cuts[c + 1]]
        if len(direct):
            order.append(direct)
            induce(direct, c)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def sort_suffixes(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` (ascending) in the order of their suffixes' first ``depth`` bytes.

    Sorted by eight bytes as a number; then runs of equal numbers are put together up to
    SORTED_AT_ONCE and sorted as strings, and a longer run goes on to its next eight bytes. So
    the strings held at a time are bounded, whatever the suffixes share.
    """
    text = buf.tobytes()
    padded = text + bytes(8)
    words = np.ndarray((len(text) + 1,), ">u8", padded, 0, (1,))
    out = []
    # later positions first: of suffixes equal up to the end of the buffer, the shorter is smaller
    todo = [(at[::-1], 0)]
    while todo:
        some, off = todo.pop()
        if len(some) <= SORTED_AT_ONCE or off >= depth:
            if off < depth:
                some = np.array(sorted(some.tolist(), key=lambda i: text[i + off : i + depth]), np.int64)
            out.append(some)
            continue
        word = words[np.minimum(some + off, len(text))].astype(np.uint64)
        by = np.argsort(word, kind="stable")
        some, word = some[by], word[by]
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        stop = np.append(begin[1:], len(some))
        parts, a = [], 0
        for b, z in zip(begin.tolist(), stop.tolist(), strict=True):
            if z - b > SORTED_AT_ONCE:
                parts += [(some[a:b], off), (some[b:z], off + 8)]
                a = z
            elif z - a > SORTED_AT_ONCE:
                parts.append((some[a:b], off))
                a = b
        parts.append((some[a:], off))
        todo += [p for p in reversed(parts) if len(p[0])]
    return np.concatenate(out) if out else at


def smaller(buf: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (the last is not)."""
    n = len(buf)
    out = np.zeros(n, bool)
    if n > 1:
        step = np.zeros(n, np.int8)
        step[:-1] = (buf[1:] > buf[:-1]).astype(np.int8) - (buf[1:] < buf[:-1])
        step[-1] = -1
        at = np.flatnonzero(step)
        out = step[at[np.searchsorted(at, np.arange(n))]] > 0
    return out


def close(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions first…last of each region, each run lengthened to its next small suffix."""
    small = np.append(np.flatnonzero(smaller(buf)), len(buf) - 1)
    reach = np.maximum(small[np.minimum(np.searchsorted(small, last), len(small) - 1)], last)
    last = np.minimum(reach, np.append(first[1:] - 1, len(buf) - 1))
    return ragged(first, last - first + 1)


def equal_prefix(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes a and b share a prefix of ``length`` bytes."""
    words = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf.tobytes(), 0, (1,))
    live = np.arange(len(a))
    steps = [length - 8, *range(0, length - 8, 8)] if length >= 8 else []
    for off in steps:
        live = live[words[a[live] + off] == words[b[live] + off]]
    if length < 8:
        for off in range(length):
            live = live[buf[a[live] + off] == buf[b[live] + off]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeats(texts: list[bytes], starts: list[int], counts: list[int], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each region (its text, number of owned starts, times it occurs): a flag per owned
    start that its window repeats among the regions, and whether it is the first of its kind."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    n = np.array(starts)
    owned = ragged(first, n)
    order = two_stage_order(buf, close(buf, first, first + n - 1), length)
    mine = np.zeros(len(buf), bool)
    mine[owned] = True
    order = order[mine[order]]
    same = equal_prefix(buf, order[:-1], order[1:], length)  # adjacent common prefixes
    multi = np.zeros(len(buf), bool)
    multi[owned] = np.repeat(np.array(counts) > 1, n)
    group = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(order) else np.zeros(0, int)
    size = np.bincount(group)
    some = np.zeros(len(size), bool)
    np.logical_or.at(some, group, multi[order])
    flag = np.zeros(len(buf), bool)
    flag[order] = (size[group] > 1) | some[group]
    head = np.zeros(len(buf), bool)
    head[order[np.concatenate([[True], ~same])] if len(order) else order] = True
    cut = np.cumsum(n)[:-1]
    return np.split(flag[owned], cut), np.split(head[owned], cut)


# ---------------------------------------------------------------- content keys


def window_keys(buf: np.ndarray, hasher: SpanHasher, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash at each position, smallest gram hash inside the window of ``length`` bytes at each position)."""
    hasher.load(buf)
    at = np.arange(len(buf) - gram + 1)
    grams = h = hasher.spans(at, at + gram)
    span, done = length - gram + 1, 1
    while done < span:
        step = min(done, span - done)
        h = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return grams, h


def met_twice(grams: np.ndarray, key: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether ``key`` occurs more than once among the grams begin…stop-1 of each run: only
    then can two windows of one run be equal."""
    low = np.flatnonzero(grams <= key.max())
    a, b = np.searchsorted(low, begin), np.searchsorted(low, stop)
    run = np.repeat(np.arange(len(key)), b - a)
    return np.bincount(run[grams[low[ragged(a, b - a)]] == key[run]], minlength=len(key)) > 1


def runs_of(keys: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys inside each document's windows, MAX_RUN at most."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    ends = np.cumsum(windows)
    new[ends[:-1][ends[:-1] < len(keys)]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(keys)))
    parts = (size + MAX_RUN - 1) // MAX_RUN
    start = ragged(np.zeros(len(at), np.int64), parts) * MAX_RUN + np.repeat(at, parts)
    return start, np.minimum(MAX_RUN, np.repeat(at + size, parts) - start)


def _key_runs(length: int, gram: int):
    """Batches of (id, text, copies) -> key, id, lo, n, copies, again for each run of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for b in pieces(batches, "text", 1 << 19):
            buf, at = raw(b.column("text"))
            windows = np.maximum(np.diff(at) - length + 1, 0)
            if not windows.sum():
                continue
            grams, keys = window_keys(buf, hasher, length, gram)
            keys = keys[ragged(at[:-1], windows)]
            start, n = runs_of(keys, windows)
            doc = np.searchsorted(np.cumsum(windows), start, "right")
            lo = start - (np.cumsum(windows) - windows)[doc]
            begin = at[doc] + lo
            again = met_twice(grams, keys[start], begin, begin + n + length - gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[start].view(np.int64)), b.column("id").take(pa.array(doc)), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), b.column("copies").take(pa.array(doc)), pa.array(again)],
                names=["key", "id", "lo", "n", "copies", "again"],
            )

    return run


def _regions(length: int):
    """Batches of (id, text, runs) -> key, region, n, copies, id, lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 19):
            buf, at = raw(b.column("text"))
            data = buf.tobytes()
            runs = b.column("runs")
            per = np.diff(runs.offsets.to_numpy())
            key, lo, n, copies = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            doc = np.repeat(np.arange(b.num_rows), per)
            begin = at[doc] + lo
            out = [data[i : i + k + length - 1] for i, k in zip(begin.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(out, pa.binary()), pa.array(n, pa.int32()), pa.array(copies, pa.int64()), b.column("id").take(pa.array(doc)), pa.array(lo, pa.int32())],
                names=["key", "region", "n", "copies", "id", "lo"],
            )

    return run


def _flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sort_groups(length: int):
    """Regions sorted by (part, key) -> region digest with the runs of repeated starts, and, for
    salted keys, the digests of windows. One sort takes many small groups together."""

    def batch(digest, at, size, window, known) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((digest, at, size, window, known), kinds, strict=True)], names=["digest", "at", "len", "window", "known"])

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        flags, heads = repeats([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], length)
        runs = [(r[0], *_flag_runs(f)) for r, f in zip(rows, flags, strict=True)]
        runs = [(d, a, z) for d, a, z in runs if len(a)]
        none = [None] * len(runs)
        yield batch([d for d, _, _ in runs], [a for _, a, _ in runs], [z - a for _, a, z in runs], none, none)
        for (digest, text, _n, _copies, salted), flag, head in zip(rows, flags, heads, strict=True):
            # of salted keys the first of each distinct window of this part, repeated here or not
            own = np.flatnonzero(head | ~flag) if salted else flag[:0]
            for k in range(0, len(own), SENT_AT_ONCE):
                p = own[k : k + SENT_AT_ONCE]
                windows = [hashlib.blake2b(text[i : i + length], digest_size=16).digest() for i in p.tolist()]
                yield batch([digest] * len(p), p[:, None].tolist(), [[1]] * len(p), windows, flag[p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for b in pieces(batches, "region", 1 << 20):
            part = zip(b.column("part").to_pylist(), b.column("digest").to_pylist(), b.column("region").to_pylist(), b.column("n").to_pylist(), b.column("copies").to_pylist(), b.column("salted").to_pylist(), strict=True)
            for p, *row in part:
                if size >= GROUP_BYTES // 4 and p != last:
                    yield from flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
                last = p
        if rows:
            yield from flush(rows)

    return run


def _cut(length: int):
    """Batches of (id, text, at, len, lo) -> id and the digest columns of the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            res: list = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                mark = np.zeros(len(data) + 1, np.int32)
                if spans:
                    lo = np.array([s["lo"] for s in spans])
                    hi = np.array([s["hi"] for s in spans]) + length - 1
                    np.add.at(mark, lo, 1)
                    np.add.at(mark, hi, -1)
                gone = np.cumsum(mark[:-1]) > 0
                a, _ = _flag_runs(gone)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                # a cut inside a character drops the rest of its bytes from the text
                res.append((len(data), int(gone.sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*res, strict=True)) if res else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


# ---------------------------------------------------------------- the job


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): ``docs`` with a column ``id`` (digest of the text), and (id, text, copies)
    of every distinct text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("id", F.unhex(F.sha2(text, 256)))
    return rows, rows.groupBy("id").agg(F.first(text).alias("text"), F.count("*").alias("copies"))


def repeat_spans(texts: DataFrame, length: int, coded: Callable = iter) -> DataFrame:
    """(id, spans) of the texts that hold repeats: runs lo…hi-1 of starts whose window of ``length``
    bytes occurs again. ``coded`` maps the batches of texts to the bytes that are compared."""
    gram = max(1, min(GRAM, length // 2))
    spark = texts.sparkSession
    key_runs, cut_regions = _key_runs(length, gram), _regions(length)

    runs = written(texts.mapInArrow(lambda batches: key_runs(coded(batches)), "key bigint, id binary, lo int, n int, copies bigint, again boolean"), "suffix-runs")
    seen = runs.groupBy("key").agg(F.count("*").alias("regions"), F.max("copies").alias("most"), F.max("again").alias("again"), F.sum(F.col("n") + F.lit(length)).alias("bytes")).where("regions > 1 OR most > 1 OR again")
    wanted = runs.join(seen.select("key"), "key").groupBy("id").agg(F.collect_list(F.struct("key", "lo", "n", "copies")).alias("runs"))
    regions = texts.select("id", "text").join(wanted, "id").select("id", "text", "runs")
    regions = regions.mapInArrow(lambda batches: cut_regions(coded(batches)), "key bigint, region binary, n int, copies bigint, id binary, lo int")
    regions = written(regions.withColumn("digest", F.unhex(F.sha2(F.col("region"), 256))), "suffix-regions")

    # equal regions travel once; a key too large for one sort is salted by region
    hot = seen.where(F.col("bytes") > GROUP_BYTES).select("key", F.ceil(F.col("bytes") / (GROUP_BYTES // 2)).cast("long").alias("parts"))
    distinct = regions.groupBy("key", "digest").agg(F.first("region").alias("region"), F.first("n").alias("n"), F.sum("copies").alias("copies"))
    distinct = distinct.join(hot, "key", "left").withColumn("salted", F.col("parts").isNotNull())
    salt = F.when(F.col("salted"), F.pmod(F.xxhash64("digest"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    distinct = distinct.withColumn("part", F.xxhash64("key", salt))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = distinct.select("part", "digest", "region", "n", "copies", "salted").repartition(n_parts, "part").sortWithinPartitions("part", "digest")
    marks = written(dealt.mapInArrow(_sort_groups(length), "digest binary, at array<int>, len array<int>, window binary, known boolean"), "suffix-marks")

    inside = marks.where("window IS NULL").select("digest", F.explode(F.arrays_zip("at", "len")).alias("s")).selectExpr("digest", "s.at AS at", "s.len AS len")
    across = marks.where("window IS NOT NULL")
    shared = across.groupBy("window").agg(F.count("*").alias("k"), F.max("known").alias("any")).where("k > 1 OR any").select("window")
    across = across.join(shared, "window").selectExpr("digest", "at[0] AS at", "len[0] AS len")
    found = inside.unionByName(across).groupBy("digest").agg(F.collect_set(F.struct("at", "len")).alias("found"))
    spans = regions.select("id", "lo", "digest").join(found, "digest").select("id", "lo", F.explode("found").alias("f"))
    return spans.groupBy("id").agg(F.collect_list(F.struct((F.col("lo") + F.col("f.at")).alias("lo"), (F.col("lo") + F.col("f.at") + F.col("f.len")).alias("hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): ``docs`` with a column ``id`` (digest of the text), and one row per distinct
    text with id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and
    kept_text (the characters that remain whole)."""
    rows, texts = distinct_texts(docs)
    spans = repeat_spans(texts, length)
    kept = texts.select("id", "text").join(spans, "id", "left").select("id", "text", "spans")
    kept = kept.mapInArrow(_cut(length), "id binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    return rows, kept


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every document after the removal of repeated 400-byte strings."""
    rows, kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "id").join(kept.drop("kept_text"), "id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
