"""Helpers shared by the corpus operators: shared-folder tables, Arrow maps, span hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Regroup Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lens = np.cumsum(np.diff(offsets(batch.column(column))))
        start = 0
        while start < batch.num_rows:
            base = int(lens[start - 1]) if start else 0
            stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(lens, base + limit - size, "right"))))
            held.append(batch.slice(start, stop - start))
            size += int(lens[stop - 1]) - base
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary Arrow column (nulls count as empty)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary Arrow column."""
    at = offsets(col)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for m in _MIX:
        x ^= x >> np.uint64(33)
        x *= np.uint64(m)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out[:n]


class SpanHasher:
    """64-bit hashes of arbitrary byte spans of one buffer, from prefix sums of a polynomial hash."""

    def __init__(self):
        self.letters = mix64(np.arange(1, 257, dtype=np.uint64))
        self.pow = self.inv = np.zeros(0, np.uint64)

    def load(self, buf: np.ndarray) -> None:
        if len(self.pow) <= len(buf):
            n = max(1 << 16, int(1.25 * len(buf)) + 1)
            self.pow, self.inv = powers(_BASE, n), powers(_BASE_INV, n)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.letters[buf] * self.pow[: len(buf)], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.inv[start]
        return mix64(h + (stop - start).astype(np.uint64) * np.uint64(_MIX[0]))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start … start+len-1."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lens), lens)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b long): comp is the smallest node of its component.

    Alternating large-star / small-star rounds; every round is written to the shared
    folder, so nothing is collected and a lost executor costs one round. Hot nodes meet
    in joins and partial aggregates only. Stops when a round changes nothing; no edges
    take no round.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = written(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), tag)
    before, now = None, state(e)
    while now[0] and now != before:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        # equal rows are left in: the next aggregate and the last distinct take them
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.selectExpr("v AS u", "m AS v").unionByName(low2.selectExpr("u", "m AS v")).where("u <> v").distinct()
        e = written(small, tag)
        before, now = now, state(e)
    return e.selectExpr("u AS node", "v AS comp").unionByName(e.selectExpr("v AS node", "v AS comp").distinct())
