"""Document fingerprints from improbable features (similarity digests).

Every window of 64 bytes has an entropy; how rare a document's windows are is ranked by how
seldom their entropy class occurs in the whole corpus (grouped counts of 1,024 classes; the
lowest and highest classes are never chosen, as they carry no or random content). The
leftmost rarest window of each 64 neighbouring ones earns a point, and windows with enough
points are the features. Each feature sets five bits of a Bloom filter of 2,048 bits; a
filter that holds 160 features is full and the next one is chained. Two digests compare
by the overlap of their filters' bits beyond what chance gives, normalised to 0…1.

The edited text of a document needs the first code points of the next document in ascending
doc_id, so rows are dealt into doc_id ranges by one shuffle, and the first document of each
range also goes to the range before it. Only the range borders (one per partition) and the
class counts are collected.

Edge cases: null texts are empty; empty texts have no features, are alike only to empty
texts (1.0) and to nothing else (0.0); texts shorter than a window are one feature; repeated
doc_ids follow each other by the digest of their text; null doc_ids come first; a single row
is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import mix64, pieces, raw

WINDOW, NEIGHBOURS, POINTS = 64, 64, 16
CLASSES, LOWEST, HIGHEST = 1024, 100, 990
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
_CHUNK = 1 << 18


def _entropy_steps() -> np.ndarray:
    """2**32 · (c log2 c − (c−1) log2 (c−1)) for c = 0…64."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    f = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0)
    return np.concatenate([[0], np.round(np.diff(f) * 2**32)]).astype(np.int64)


def entropy_classes(buf: np.ndarray) -> np.ndarray:
    """Entropy class (0…CLASSES-1) of the window that starts at each byte, len(buf)-63 of them.

    The sum of c·log2 c over byte counts moves by one leaving and one entering byte per
    step; their counts come from comparing the buffer with itself at 63 distances.
    """
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    back = np.ones(n, np.uint8)  # equal bytes among the last 64, itself included
    ahead = np.ones(n, np.uint8)
    same = np.empty(_CHUNK, np.uint8)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        for d in range(1, WINDOW):
            z = min(hi, n - d)
            if z <= lo:
                break
            s = same[: z - lo]
            np.equal(buf[lo:z], buf[lo + d : z + d], out=s.view(bool))
            ahead[lo:z] += s
            back[lo + d : z + d] += s
    step = _entropy_steps()
    # the first window is built by entering its bytes one by one
    first = step[[int((buf[: i + 1] == buf[i]).sum()) for i in range(WINDOW)]].sum()
    change = step[back[WINDOW:]] - step[ahead[: n - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(change)])
    bits = np.log2(WINDOW) - total / (2.0**32 * WINDOW)  # 0…6
    return np.clip(np.rint(bits / np.log2(WINDOW) * (CLASSES - 1)), 0, CLASSES - 1).astype(np.int16)


def select_features(buf: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the chosen windows of all documents buf[at[i]:at[i+1]] of 64 bytes or more."""
    size = np.diff(at)
    classes = entropy_classes(buf)
    rank = ranks[classes].astype(np.int64)
    # windows across a document's end are never chosen
    windows = np.maximum(size - WINDOW + 1, 0)
    n = len(rank)
    edge = np.zeros(n + 1, np.int32)
    some = windows > 0
    np.add.at(edge, at[:-1][some], 1)
    np.add.at(edge, (at[:-1] + windows)[some], -1)
    inside = np.cumsum(edge[:-1]) > 0
    never = np.int64(CLASSES + 1)
    rank[~inside] = never
    key = rank << 32 | np.arange(n)
    span, done, low = NEIGHBOURS, 1, key
    while done < span:
        step = min(done, span - done)
        pad = np.concatenate([low[step:], np.full(min(step, len(low)), np.iinfo(np.int64).max)])[: len(low)]
        low = np.minimum(low, pad)
        done += step
    # a neighbourhood belongs to the document of its first window and must not leave it, except in short texts
    doc = np.searchsorted(at[1:], np.arange(n), "right")
    whole = inside & (np.arange(n) + np.minimum(NEIGHBOURS, windows[doc]) <= (at[:-1] + windows)[doc])
    best = low[whole]
    points = np.bincount(best & 0xFFFFFFFF, minlength=n)
    good = (best >> 32) < CLASSES
    ok = np.zeros(n, bool)
    ok[(best & 0xFFFFFFFF)[good]] = True
    # short texts have fewer neighbourhoods: they keep their best windows
    need = np.minimum(POINTS, np.maximum(1, (windows - NEIGHBOURS) // 8))[doc]
    pick = np.flatnonzero(ok & (points >= need))
    return doc[pick], pick


def feature_bits(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Five filter bits of each window (rows × HASHES)."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf.tobytes(), 0, (1,))
    h = np.zeros(len(start), np.uint64)
    for k in range(0, WINDOW, 8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[start + k])
    return np.stack([(h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1) for k in range(HASHES)], axis=1).astype(np.int64)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Chained filters of each text (filters × FILTER_BITS bool)."""
    size = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    doc, start = select_features(buf[: at[-1]], at, ranks) if at[-1] >= WINDOW else (np.zeros(0, int), np.zeros(0, int))
    bits = feature_bits(buf, start) if len(start) else np.zeros((0, HASHES), np.int64)
    n = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(n)
    out = []
    for k, t in enumerate(texts):
        own = bits[ends[k] - n[k] : ends[k]]
        if not len(own) and t:  # no window qualifies: the whole text is the feature
            raw_hash = np.frombuffer(hashlib.sha1(t).digest()[:10], "<u2").astype(np.int64) & (FILTER_BITS - 1)
            own = raw_hash[None, :]
        filters = np.zeros((-(-len(own) // PER_FILTER), FILTER_BITS), bool)
        filters[np.repeat(np.arange(len(own)) // PER_FILTER, HASHES), own.ravel()] = True
        out.append(filters)
    return out


def to_text(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + ":".join(base64.b64encode(np.packbits(f).tobytes()).decode() for f in filters)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of the shorter digest of their best overlap in the other."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(axis=1), b.sum(axis=1)
    both = a.astype(np.float32) @ b.astype(np.float32).T
    chance = na[:, None] * nb[None, :] / FILTER_BITS
    most = np.minimum(na[:, None], nb[None, :])
    score = np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 0)
    return float(np.clip(score, 0, 1).max(axis=1).mean())


# ---------------------------------------------------------------- Spark


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, np.int64)
    for b in pieces(batches, "text", 4 << 20):
        buf, at = raw(b.column("text"))
        classes = entropy_classes(buf)
        windows = np.maximum(np.diff(at) - WINDOW + 1, 0)
        edge = np.zeros(len(classes) + 1, np.int32)
        np.add.at(edge, at[:-1][windows > 0], 1)
        np.add.at(edge, (at[:-1] + windows)[windows > 0], -1)
        total += np.bincount(classes[np.cumsum(edge[:-1]) > 0], minlength=CLASSES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["class", "n"])


def rarity_ranks(texts: DataFrame) -> np.ndarray:
    """Rank of each entropy class, 0 the rarest in the corpus; classes never chosen get CLASSES."""
    counts = np.zeros(CLASSES, np.int64)
    for r in texts.select("text").mapInArrow(_class_counts, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():  # ≤ CLASSES rows
        counts[r["class"]] = r["n"]
    ranks = np.empty(CLASSES, np.int32)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    ranks[:LOWEST] = ranks[HIGHEST:] = CLASSES
    return ranks


def _fingerprint(ranks: np.ndarray):
    """Rows sorted by (range_no, ahead, doc_id, tie): each compared with its successor."""

    def emit(rows: list, after) -> pa.RecordBatch:
        texts = [r[2] for r in rows] + [after[2]]
        edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for t, nxt in zip(texts, texts[1:], strict=False)]
        own = digests([t.encode() for t in texts], ranks)
        changed = digests([t.encode() for t in edited], ranks)
        cols = [
            [r[1] for r in rows],
            [len(r[2]) for r in rows],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [to_text(f) for f in own[:-1]],
            [to_text(f) for f in changed],
            [likeness(a, b) for a, b in zip(own, changed, strict=False)],
            [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches, "text", 2 << 20):
            for row in zip(*(b.column(c).to_pylist() for c in ("range_no", "doc_id", "text", "ahead")), strict=True):
                if held and row[0] == held[-1][0] and (size > 2 << 20 or row[3]) and not held[-1][3]:
                    yield emit(held, row)
                    held, size = [], 0
                elif held and (row[0] != held[-1][0] or held[-1][3]):
                    held, size = [], 0
                if not row[3]:
                    held.append(row)
                    size += len(row[2])
        # every range ends with the first row of the next one, so nothing is left over

    return run


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ranks = rarity_ranks(base)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # ranges of (doc_id, tie): a null or repeated doc_id is split by the texts' hashes
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")
    keys = base.select(place.alias("place")).repartitionByRange(parts, "place")
    firsts = sorted(tuple(r["first"]) for r in keys.groupBy(F.spark_partition_id()).agg(F.min("place").alias("first")).collect())  # one a range
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)

    def literal(f) -> Column:
        return F.struct(F.lit(f[0]).alias("known"), F.lit(f[1]).cast("bigint").alias("doc_id"), F.lit(f[2]).cast("bigint").alias("tie"))

    bound = F.array(*[literal(f) for f in firsts])
    number = F.greatest(F.size(F.filter(bound, lambda x: x <= F.col("place"))) - 1, F.lit(0))
    ranged = base.withColumn("place", place).withColumn("range_no", number)
    # the first document of each range is also sent to the range before it, that of the first range to the last
    ahead = [((i - 1) % len(firsts), *f) for i, f in enumerate(firsts)]
    extra = spark.createDataFrame(ahead, "to_range int, known boolean, id bigint, t bigint")
    same = (F.col("place.known") == F.col("known")) & (F.col("place.doc_id") == F.col("id")) & (F.col("place.tie") == F.col("t"))
    copies = ranged.join(F.broadcast(extra), same).select(F.col("to_range").alias("range_no"), "doc_id", "tie", "text", F.lit(True).alias("ahead"))
    rows = ranged.select("range_no", "doc_id", "tie", "text", F.lit(False).alias("ahead")).unionByName(copies)
    # range k goes to partition k
    rows = rows.repartitionById(len(firsts), F.col("range_no")).sortWithinPartitions("range_no", "ahead", "doc_id", "tie").select("range_no", "doc_id", "text", "ahead")
    return rows.mapInArrow(_fingerprint(ranks), _SCHEMA)


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
