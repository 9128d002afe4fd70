"""MinHash near-duplicate detection.

One-permutation hashing with optimal densification gives each distinct shingle set a
signature of 128 sixteen-bit values; 32 bands of four values make buckets; each bucket
proposes star-shaped edges (member, hub) only. Proposed edges are dropped when the
signature estimate is far below the threshold (``SLACK`` standard deviations) and are
otherwise confirmed on the full shingle sets. A star can miss a link between two members
whose hub is like neither, so buckets that still span several components are gone through
once more: their members are compared by signature in blocks of at most about ``BLOCK``,
pairs of different components that can reach the threshold stay in one row per block
pair, and the members' texts are brought to them to confirm. A pair is tested in the first
band that it shares. No cap drops a bucket or a member.

Equal shingle sets are collapsed before any bucket is formed, so groups of copies of any
size cost one row. Texts meet their partners by shuffle joins, which AQE splits when a
hub is hot.

Edge cases: null or empty texts have an empty set, link with nothing and form their own
component; fewer words than a shingle make one shingle of the whole sequence; rows that
repeat a doc_id keep one row each and share its component when their texts agree; a null
doc_id takes part in links but never becomes a component's id unless all are null. ``kept``
is doc_id = component_id (null equal to null), so rows that share the smallest doc_id, and all
rows of a group without any id, are kept; ``near_duplicate_rows`` lets one row of each group stay.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import SpanHasher, connected_components, mix64, pieces, written

BINS, BANDS, ROWS = 128, 32, 4
SLACK = 6.0
BLOCK = 256
_SETS = "doc_id bigint, row_key bigint, set_hash binary, n_shingles bigint, sig binary"


def shingle_hashes(texts: list, hasher: SpanHasher, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (None: empty set)."""
    norm = [b" ".join((t or "").encode().lower().split()) for t in texts]
    buf = np.frombuffer(b"\n".join(norm) + b"\n", dtype=np.uint8)
    hasher.load(buf)
    gap = (buf == 32) | (buf == 10)
    stop = np.flatnonzero(gap)
    start = np.concatenate([[0], stop[:-1] + 1])
    doc = np.cumsum(buf[stop] == 10) - (buf[stop] == 10)  # document of each word
    real = stop > start  # an empty document has one empty word
    start, stop, doc = start[real], stop[real], doc[real]
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    head = np.arange(len(start)) - first[doc]
    full = head + words <= count[doc]
    short = (head == 0) & (count[doc] < words)
    at = np.flatnonzero(full | short)
    last = np.where(full[at], at + words - 1, first[doc[at]] + count[doc[at]] - 1)
    h = hasher.spans(start[at], stop[last])
    n = np.bincount(doc[at], minlength=len(texts))
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(texts) else []


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures (sets × BINS, uint16), densified: an empty bin takes the value
    of a bin drawn by a universal hash of (bin, attempt) until a filled one is met."""
    width = np.uint64(64 - int(BINS).bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << width
    vals = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            ok = at < len(s)
            at = np.where(ok, at, 0)
            got = s[at]
            filled[k] = ok & ((got >> width) == np.arange(BINS, dtype=np.uint64))
            vals[k] = got
    out = vals.copy()
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):  # the empty bins still without a donor
        attempt += 1
        donor = (mix64(bin_.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(BINS)).astype(int)
        took = filled[row, donor]
        out[row[took], bin_[took]] = vals[row[took], donor[took]]
        row, bin_ = row[~took], bin_[~took]
    return (mix64(out) & np.uint64(0xFFFF)).astype(np.uint16)


def _sets_of(words: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for b in pieces(batches, "text", 1 << 19):
            sets = shingle_hashes(b.column("text").to_pylist(), hasher, words)
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(c) for c in carried],
                    b.column("doc_id"),
                    b.column("row_key"),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                names=[*carried, "doc_id", "row_key", "set_hash", "n_shingles", "sig"],
            )

    return run


def least_estimate(threshold: float) -> float:
    """Signature agreement below which a pair at ``threshold`` is out of reach (SLACK deviations)."""
    return threshold - SLACK * (threshold * (1 - threshold) / BINS) ** 0.5


def _estimate(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BINS) for k in ("sig_a", "sig_b"))
                keep = pa.array((a == c).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(keep)

    return run


def _confirm(num: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for b in pieces(pieces(batches, "text_a", 1 << 19), "text_b", 1 << 19):
            ta, tb = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            sets = dict(zip(uniq := list(dict.fromkeys(ta + tb)), shingle_hashes(uniq, hasher, words), strict=True))
            keep = []
            for x, y in zip(ta, tb, strict=True):
                x, y = sets[x], sets[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            held.append(b.slice(i, j - i))
            if j < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(least: float):
    """Members of block pairs, sorted by group -> one row per group with the pairs that can reach
    the threshold: different components, met in no earlier band, signatures alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "gid"):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, BINS)
            bands = sig.view(np.uint64).reshape(len(sig), BANDS)
            node, comp, block = (t.column(c).to_numpy() for c in ("node", "comp", "block"))
            band = t.column("bucket")[0].as_py() & (BANDS - 1)
            left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            a, b = [], []
            for i in left:
                hit = right[(comp[right] != comp[i]) & ((sig[right] == sig[i]).mean(axis=1) >= least)]
                hit = hit[~(bands[hit, :band] == bands[i, :band]).any(axis=1)]
                hit = hit[node[hit] > node[i]] if block.min() == block.max() else hit
                a.append(np.full(len(hit), node[i]))
                b.append(node[hit])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            if len(a):
                one = [pa.array([t.column("gid")[0].as_py()], pa.int64()), pa.array([a.tolist()], pa.list_(pa.int64())), pa.array([b.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(one, names=["gid", "a", "b"])

    return run


def _confirm_groups(num: int, words: int):
    """Rows sorted by group, the members' texts and one row with the pairs -> confirmed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for t in _groups(batches, "gid"):
            node, text = t.column("node").to_pylist(), t.column("text").to_pylist()
            sets = dict(zip(node, shingle_hashes(text, hasher, words), strict=True))
            lists = [(a, b) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True) if a is not None]
            out = []
            for x, y in {pair for a, b in lists for pair in zip(a, b, strict=True)}:
                m, n = sorted((len(sets[x]), len(sets[y])))
                if 100 * m >= num * n:  # else even a subset is too small
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= num * (m + n - both):
                        out.append((min(x, y), max(x, y)))
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def merged_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after ``links`` (a, b) join some of them: only the components that a
    new link touches are contracted, each as one node."""

    def of(end: str) -> DataFrame:
        return comps.withColumnsRenamed({"node": end, "comp": f"comp_{end}"})

    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).distinct()
    over = connected_components(between, "cc-more")
    over = written(over.select(F.col("node").alias("comp"), F.col("comp").alias("joined")), "minhash-joined")
    moved = comps.join(over, "comp", "left").select("node", F.coalesce("joined", "comp").alias("comp"))
    # a node without a component so far is its own
    single = over.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("joined").alias("comp"))
    return written(moved.unionByName(single), "minhash-comps")


def near_duplicate_rows(docs: DataFrame, row: str, percent: int = 85, words: int = 5) -> DataFrame:
    """``row`` (a key of the rows of ``docs``, equal for equal rows only), ``copies`` (rows of that key) and
    ``stays`` for the rows of all groups of more than one row. One key of each group stays, and one row
    of it: that with the smallest doc_id, rows without one last, then that with the smallest key."""
    found = minhash_components(docs, percent, words, (row,)).where("component IS NOT NULL")
    found = written(found.groupBy("component", row).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "minhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col(row).alias("r")))
    groups = found.groupBy("component").agg(first.alias("first"), F.sum("copies").alias("rows")).where("rows > 1")
    marked = found.join(groups.select("component", F.col("first.r").alias("r")), "component")
    return marked.select(row, "copies", (F.col(row) == F.col("r")).alias("stays"))


def minhash_components(docs: DataFrame, percent: int = 85, words: int = 5, carried: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text); with ``carried``
    columns also those and ``component``, an arbitrary number of the component, null for empty sets.

    Links are sets with 100 · |∩| ≥ percent · |∪|.
    """
    least = least_estimate(percent / 100)
    carried = list(carried)
    base = docs.select(*carried, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))
    types = dict(base.dtypes)
    fields = "".join(f"`{c}` {types[c]}, " for c in carried) + _SETS
    sets = written(base.mapInArrow(_sets_of(words, carried), fields), "minhash-sets")
    classes = (
        sets.where("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("low_id"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes, "minhash-classes")

    # (bucket, node): the bucket's low five bits hold the band
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    slots = classes.select("node", "sig", band).select(
        ((F.xxhash64("band", F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})"))).bitwiseAND(F.lit(~(BANDS - 1)).cast("long")) + F.col("band")).alias("bucket"),
        "node",
    )
    salt = F.xxhash64((F.col("bucket").bitwiseAND(F.lit(BANDS - 1).cast("long"))), F.lit("hub"))
    hubs = (
        slots.groupBy("bucket")
        .agg(F.min(F.col("node").bitwiseXOR(salt)).alias("h"), F.count("*").alias("size"))
        .where("size > 1")
        .select("bucket", F.col("h").bitwiseXOR(salt).alias("hub"), "size")
    )
    # rows that an explode makes are not in the planner's sizes: without the hint they may be broadcast
    buckets = written(slots.hint("merge").join(hubs, "bucket"), "minhash-buckets")

    def pairs_of(frame: DataFrame) -> DataFrame:
        return frame.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    text = base.select("row_key", "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sig = classes.select("node", "sig")
        near = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
        near = written(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimate(least), "a bigint, b bigint"), "minhash-near")
        ends = classes.select("node", "row_key")
        near = near.join(ends.withColumnsRenamed({"node": "a", "row_key": "ka"}), "a").join(ends.withColumnsRenamed({"node": "b", "row_key": "kb"}), "b")
        near = near.join(text.withColumnsRenamed({"row_key": "ka", "text": "text_a"}), "ka").join(text.withColumnsRenamed({"row_key": "kb", "text": "text_b"}), "kb")
        return written(near.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent, words), "a bigint, b bigint").distinct(), "minhash-links")

    links = confirmed(pairs_of(buckets.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    comps = written(connected_components(links), "minhash-comps")

    # buckets that still span components: their members are compared in blocks of bounded size
    member = buckets.where("size > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    span = member.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
    rest = member.join(span, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    rest = rest.join(classes.select("node", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("gid", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rest = rest.select("gid", "bucket", "block", "node", "comp", "sig").repartition(parts, "gid").sortWithinPartitions("gid")
    tested = written(rest.mapInArrow(_block_pairs(least), "gid bigint, a array<bigint>, b array<bigint>"), "minhash-blocks")
    nodes = tested.select("gid", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    nodes = nodes.hint("merge").join(classes.select("node", "row_key"), "node").join(text, "row_key").select("gid", "node", "text")
    none = F.lit(None).cast("array<bigint>")
    lists = tested.select("gid", F.lit(-1).cast("long").alias("node"), F.lit("").alias("text"), "a", "b")
    both = nodes.select("gid", "node", "text", none.alias("a"), none.alias("b")).unionByName(lists)
    both = both.repartition(parts, "gid").sortWithinPartitions("gid")
    more = written(both.mapInArrow(_confirm_groups(percent, words), "a bigint, b bigint").distinct(), "minhash-links")
    comps = merged_components(comps, more)

    # smallest doc_id of each component, then back to the rows
    member = classes.select("node", "set_hash", "low_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = member.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    found = member.join(low, "comp").select("set_hash", "component_id", F.col("comp").alias("component"))
    rows = sets.select(*carried, "doc_id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), *(["component", *carried] if carried else []))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))
