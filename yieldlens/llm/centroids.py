"""k-means over integer vectors, filtered by principal coordinates, verified in integers.

Components become floor(scale * x). The rotation onto the principal axes comes from sums of
products over all rows; every vector is stored once with its ``lead`` leading rotated
coordinates and the norm of the rest. For a vector v and a centroid c

    |lead(v) - lead(c)|^2 + (rest(v) - rest(c))^2  <=  |v - c|^2

so a centroid whose left side, less a margin for rounding, exceeds the exact distance of one
candidate cannot be nearest. The survivors' distances are computed in 64-bit integers, and
the smallest number wins ties. The rotation only sets how many survive, never the result.

Every round is one pass: tasks add up their vectors by centroid and component, a grouped sum
(exact decimals) adds the tasks up, and k * d sums reach the driver, which holds the
centroids. No vector is shuffled, so a cluster of any share of the rows is no hot key. The
prepared table lies in the shared folder; a lost task is done again from there.

Kept are vectors of exactly ``dim`` components, none null or non-finite. Edge cases: a null
or other vector gives no row; repeated rows and ids keep a row each (equal ids as starting
centroids are ordered by their vectors); a null vec_id is assigned, but starts no centroid;
with fewer vectors than k there are as many centroids as vectors with an id, and without any
centroid or vector no rows; other columns are ignored. Components beyond +-1.8e8 after
scaling would leave the range of a long distance and raise an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import written

DIM, K, ROUNDS, SCALE, LEAD = 64, 40, 5, 256, 16
#: largest component whose squared distances fit a long
LARGEST = 180_000_000
#: share of the squared norms that rounding may take off a lower bound (it takes about 1e-14)
MARGIN = 1e-9
BLOCK = 1024

PREPARED = "vec_id bigint, v binary, lead binary, rest double"


def kept_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, x (array of double) of the vectors with ``dim`` components, all finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where((F.size(x) == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    y = np.floor(scale * x)
    if len(y) and np.abs(y).max() > LARGEST:
        raise ValueError(f"a component beyond +-{LARGEST} after scaling: squared distances would not fit a long")
    return y.astype(np.int64)


def _moments(dim: int, scale: int):
    """Per task: row count, sums of components and of products, as rows (i, j, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            y = _integers(_matrix(b, dim), scale).astype(np.float64)
            y = np.concatenate([y, np.ones((len(y), 1))], axis=1)
            total += y.T @ y
        if total[dim, dim]:
            i, j = np.triu_indices(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


def principal_axes(kept: DataFrame, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """Orthonormal columns, by falling variance (the unit matrix for no rows)."""
    total = np.zeros((dim + 1, dim + 1))
    sums = kept.mapInArrow(_moments(dim, scale), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.collect():  # (dim + 1)(dim + 2) / 2 rows
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    n = total[dim, dim]
    if not n:
        return np.eye(dim)
    mean = total[dim, :dim] / n
    _, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _rotated(y: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading coordinates, norm of the others)."""
    p = y.astype(np.float64) @ axes
    return p[:, :lead], np.sqrt((p[:, lead:] ** 2).sum(axis=1))


def _prepare(axes: np.ndarray, dim: int, scale: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _integers(_matrix(b, dim), scale)
            p, rest = _rotated(y, axes, lead)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), _rows(y.astype("<i4")), _rows(p.astype("<f8")), pa.array(rest)], names=["vec_id", "v", "lead", "rest"]
            )

    return run


def _rows(m: np.ndarray) -> pa.Array:
    """Each row of a matrix as binary."""
    width = m.shape[1] * m.itemsize
    at = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _from_rows(col: pa.Array, kind: str, width: int) -> np.ndarray:
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(col), width) if len(col) else np.zeros((0, width), kind)


class Filter:
    """Nearest centroid of blocks of prepared vectors."""

    def __init__(self, centroids: np.ndarray, axes: np.ndarray, lead: int):
        self.c, self.lead_n = centroids, lead
        self.lead, self.rest = _rotated(centroids, axes, lead)
        self.lead2 = (self.lead**2).sum(axis=1)
        self.norm2 = self.lead2 + self.rest**2
        #: pairs of vector and centroid, and those verified
        self.pairs = self.verified = 0

    def nearest(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance), exact."""
        mine2 = (lead**2).sum(axis=1)
        bound = mine2[:, None] + self.lead2[None, :] - 2 * lead @ self.lead.T + (rest[:, None] - self.rest[None, :]) ** 2
        bound -= MARGIN * ((mine2 + rest**2)[:, None] + self.norm2[None, :])
        first = bound.argmin(axis=1)
        reach = self._distance(v, np.arange(len(v)), first)
        row, cand = np.nonzero(bound <= reach[:, None])
        d = self._distance(v, row, cand)
        self.pairs, self.verified = self.pairs + bound.size, self.verified + len(row)
        begin = np.searchsorted(row, np.arange(len(v)))
        best = np.minimum.reduceat(d, begin)
        # candidates of a row are in ascending order, so its first one at the minimum wins
        at = np.flatnonzero(d == best[row])
        pick = at[np.searchsorted(row[at], np.arange(len(v)))]
        return cand[pick], best

    def _distance(self, v, row, cand):
        diff = v[row] - self.c[cand]
        return np.einsum("ij,ij->i", diff, diff)


def _blocks(batches, dim, lead):
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            b = batch.slice(k, BLOCK)
            v = _from_rows(b.column("v"), "<i4", dim).astype(np.int64)
            yield b, v, _from_rows(b.column("lead"), "<f8", lead), b.column("rest").to_numpy()


def _sums(centroids: np.ndarray, axes: np.ndarray, lead: int):
    """Per task: rows (cluster, j, s) of component sums, j = dim for the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Filter(centroids, axes, lead)
        k, dim = centroids.shape
        total = np.zeros((k, dim + 1), np.int64)
        for _, v, p, rest in _blocks(batches, dim, lead):
            cluster, _ = near.nearest(v, p, rest)
            order = np.argsort(cluster, kind="stable")
            begin = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            some = cluster[order][begin]
            total[some, :dim] += np.add.reduceat(v[order], begin)
            total[some, dim] += np.diff(np.append(begin, len(order)))
        c, j = np.nonzero(total)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(total[c, j])], names=["cluster", "j", "s"])

    return run


def _assign(centroids: np.ndarray, axes: np.ndarray, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Filter(centroids, axes, lead)
        for b, v, p, rest in _blocks(batches, centroids.shape[1], lead):
            cluster, d = near.nearest(v, p, rest)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def starting_centroids(prepared: DataFrame, k: int = K, seed: int = 2) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # rows of one id are ordered by the bytes of their vectors
    rows = prepared.where("vec_id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", F.hex("v")).limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the final centroids)."""
    kept = kept_vectors(vectors, dim)
    axes = principal_axes(kept, dim, scale)
    prepared = written(kept.mapInArrow(_prepare(axes, dim, scale, lead), PREPARED), "vectors")
    centroids = starting_centroids(prepared, k)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        part = prepared.mapInArrow(_sums(centroids, axes, lead), "cluster int, j int, s bigint")
        sums = part.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        total = [[0] * (dim + 1) for _ in range(len(centroids))]
        for r in sums.collect():  # k * (dim + 1) rows at most
            total[r["cluster"]][r["j"]] = int(r["s"])
        centroids = np.array([[s // t[dim] for s in t[:dim]] if t[dim] else c.tolist() for t, c in zip(total, centroids, strict=True)], np.int64)
    return prepared.mapInArrow(_assign(centroids, axes, lead), "vec_id bigint, cluster int, distance bigint"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; ``assigned`` is written first."""
    spark = assigned.sparkSession
    assigned = written(assigned, "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # k rows at most
    total = sum(inertia.values())
    rows = [
        (c, inertia[c], total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist()) if c in inertia
    ]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = assigned.join(F.broadcast(stats), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroid_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    """The same for DuckDB, every round a query of all pairs of vector and centroid."""

    def nearest(c):
        return f"""SELECT row_no, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT row_no, vec_id, v, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, {c}
  ) GROUP BY ALL"""

    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS x FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k})
)""",
    ]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT c, list(m ORDER BY j) AS x FROM (
    SELECT c, j, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT c, j, sum(e) AS s, count(*) AS n FROM (
        SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM (
  {nearest(f"c{r}")}
        )
      ) GROUP BY c, j
    )
  ) GROUP BY c
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(a{r}.x::BIGINT[], c{r}.x) AS x FROM c{r} LEFT JOIN a{r} USING (c)
)""")
    last = f"c{rounds}"
    parts.append(f"""f AS MATERIALIZED (
  {nearest(last)}
)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, f.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM f JOIN {last} ON f.c = {last}.c"""


OP12_SQL = centroid_sql()


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
