"""k-nearest-neighbour votes: exact by blocks, and through an index of coarse cells.

Both take training rows (key, vector, ``label_d``) and give a function that adds p, the share
of positive neighbours. Distances are Euclidean, ties go to the smaller training key. Rows meet
in tasks of bounded size, and a window keeps the k best of each task's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _nearest(Q: np.ndarray, X: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, training place, squared distance) of the k nearest training rows of each query
    row, in order of distance, ties by training place; with ``bound`` only those within it.

    A single-precision product finds the candidates, with a margin for its rounding; their
    distances are then computed in full, so the result is exact. Rows with values that the
    product cannot hold (NaN, infinite) are candidates always."""
    n, d = X.shape
    with np.errstate(all="ignore"):
        fine = np.isfinite(X).all(axis=1)
        mid = X[fine].mean(axis=0) if fine.any() else np.zeros(d)
        a = np.empty((n, d + 1), np.float32)
        a[:, :d] = X - mid
        a[:, d] = x2 = ((X - mid) ** 2).sum(axis=1)
        lost = ~np.isfinite(a).all(axis=1)
        a[lost, :d], a[lost, d] = 0, np.inf
        most = x2[~lost].max(initial=0.0)
        b = np.ones((len(Q), d + 1), np.float32)
        b[:, :d] = -2 * (Q - mid)
        q2 = ((Q - mid) ** 2).sum(axis=1)
        open_ = ~np.isfinite(b).all(axis=1) | ~np.isfinite(q2)
        b[open_] = 0
        slack = 5e-7 * (d + 16) * (q2 + most)
    found = []
    step = max(1, (1 << 20) // n)
    for s0 in range(0, len(Q), step):
        at = slice(s0, s0 + step)
        with np.errstate(all="ignore"):
            s = b[at] @ a.T  # squared distance less q2
            limit = np.full(len(s), np.inf) if bound is None else bound[at] - q2[at] + slack[at]
            if n > k:
                wide = np.flatnonzero(~np.isfinite(limit) & ~open_[at])
                for w in range(0, len(wide), 64):
                    some = wide[w : w + 64]
                    limit[some] = np.partition(s[some], k - 1, axis=1)[:, k - 1] + 2 * slack[at][some]
            limit[open_[at]] = np.inf
            hit = s <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
            hit[open_[at]] = True
            qi, ti = np.nonzero(hit)
            dist = np.empty(len(qi))
            for c in range(0, len(qi), 1 << 15):
                piece = slice(c, c + (1 << 15))
                dist[piece] = ((Q[at][qi[piece]] - X[ti[piece]]) ** 2).sum(axis=1)
        order = np.lexsort((dist, qi))  # stable: ties stay in order of training places
        qi, ti, dist = qi[order], ti[order], dist[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        found.append((qi[keep] + s0, ti[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(k: int, key: str):
    """The k nearest training rows of each query row of a cogroup."""

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({key: q[key][:0], "_dist": [], "_tkey": t["_tkey"][:0], "_y": []})
        # keys are sorted, so a stable sort breaks distance ties by key
        t = t.sort_values("_tkey", kind="stable")
        X = np.array(t["_x"].tolist(), dtype=np.float64)
        Q = np.array(q["_x"].tolist(), dtype=np.float64)
        qi, ti, dist = _nearest(Q, X, k)
        return pd.DataFrame({key: q[key].to_numpy()[qi], "_dist": dist, "_tkey": t["_tkey"].to_numpy()[ti], "_y": t["_y"].to_numpy()[ti]})

    return nearest


def _pack(most: int):
    """Rows (key, _x, maybe _y) into blocks of at most ``most`` rows: arrays of the keys and labels,
    one binary of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            n = t.num_rows
            x = np.array(t.column("_x").to_pylist(), dtype=np.float64).reshape(n, -1)
            at = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(at, t.column(c).combine_chunks()) for c in t.column_names if c != "_x"]
            names = [c for c in t.column_names if c != "_x"]
            return pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary())], names=[*names, "_x"])

        held, size = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most - size))
                b, size = b.slice(held[-1].num_rows), size + held[-1].num_rows
                if size == most:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return run


def _meet_blocks(k: int, key: str):
    """The k best of each query row over the training blocks that its block meets in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                no = batch.column("_no")[i].as_py()
                if no != now:
                    if best is not None:
                        yield out(keys, best)
                    now, best = no, None
                    keys = batch.column(key)[i].values
                    Q = np.frombuffer(batch.column("_qx")[i].as_buffer(), np.float64).reshape(len(keys), -1)
                    bound = None
                tkey = pd.Series(batch.column("_tkey")[i].values.to_pandas())
                y = batch.column("_y")[i].values.to_numpy(zero_copy_only=False)
                X = np.frombuffer(batch.column("_x")[i].as_buffer(), np.float64).reshape(len(tkey), -1)
                qi, ti, dist = _nearest(Q, X, k, bound)
                new = pd.DataFrame({"q": qi, "_dist": dist, "_tkey": tkey.to_numpy()[ti], "_y": y[ti]})
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["q", "_dist", "_tkey"], kind="stable", ignore_index=True)
                place = best.groupby("q").cumcount().to_numpy()
                best = best[place < k]
                bound = np.full(len(Q), np.inf)
                last = best[place[place < k] == k - 1]
                bound[last["q"].to_numpy()] = last["_dist"].fillna(np.inf).to_numpy()
        if best is not None:
            yield out(keys, best)

    def out(keys: pa.Array, best: pd.DataFrame) -> pa.RecordBatch:
        cols = [keys.take(pa.array(best["q"].to_numpy())), pa.array(best["_dist"].to_numpy()), pa.array(best["_tkey"]), pa.array(best["_y"])]
        return pa.RecordBatch.from_arrays(cols, names=[key, "_dist", "_tkey", "_y"])

    return run


def _block(c: str, n) -> Column:
    return F.pmod(F.xxhash64(c), n if isinstance(n, Column) else F.lit(max(n, 1)).cast("bigint"))


class ExactKnn:
    """Exact vote. Training and query rows are packed into blocks of bounded size, written once to
    the shared folder, and every query block meets every training block (a Cartesian product of
    the blocks, which reads both sides from the folder and shuffles neither): no copy of a row is
    stored, and a task holds a query block and ``MEET`` training blocks. The work grows with the
    product of both sides, which ``CoarseKnn`` avoids.

    Neither side goes through the driver or whole into one task, and no row pair leaves a task,
    only the k best of each query row. Keys are unique. Training rows without a vector or label are
    no neighbours; a query row without a vector, or without any training row, has p NULL.
    """

    #: most rows of a block, training blocks of a partition, most bytes of a block's vectors
    TRAIN_BLOCK, QUERY_BLOCK, MEET, BYTES = 16384, 4096, 16, 1 << 21

    def __init__(self, k: int = 5, key: str = "key", vec: str = "features"):
        self.k, self.key, self.vec = k, key, vec

    def _rows(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(self.vec) if dict(df.dtypes)[self.vec] == "vector" else F.col(self.vec).cast("array<double>")
        return df.withColumn("_x", arr).where("_x IS NOT NULL")

    def _training(self, train: DataFrame) -> DataFrame:
        return self._rows(train).where("label_d IS NOT NULL").select(F.col(self.key).alias("_tkey"), "_x", F.col("label_d").alias("_y"))

    def fit(self, train: DataFrame):
        neighbours = self.neighbours_of(train)

        def predict(df: DataFrame) -> DataFrame:
            return df.join(neighbours(df).groupBy(self.key).agg(F.avg("_y").alias("p")), self.key, "left")

        return predict

    def neighbours_of(self, train: DataFrame):
        """A function of query rows: (key, _dist squared, _tkey, _y, _r from 1) of their k nearest."""
        tr = self._training(train)
        blocks = self._packed(tr, "_tkey", self.TRAIN_BLOCK, self.MEET)

        def near(df: DataFrame) -> DataFrame:
            kind = dict(df.dtypes)[self.key]
            q = self._packed(self._rows(df).select(self.key, "_x"), self.key, self.QUERY_BLOCK, 1)
            q = q.select(self.key, F.col("_x").alias("_qx"), F.monotonically_increasing_id().alias("_no"))
            # the hint asks for the product by partitions: no side is broadcast, however small
            pairs = q.join(blocks.hint("shuffle_replicate_nl"))
            schema = f"`{self.key}` {kind}, _dist double, _tkey {dict(tr.dtypes)['_tkey']}, _y double"
            return self._ranked(pairs.mapInArrow(_meet_blocks(self.k, self.key), schema))

        return near

    def _packed(self, rows: DataFrame, key: str, most: int, blocks: int) -> DataFrame:
        """``rows`` in blocks of at most ``most`` rows, about ``blocks`` of them a partition, in order
        of the key (which breaks ties inside a block)."""
        n = rows.count()
        wide = rows.agg(F.max(F.size("_x"))).first()[0] or 1
        most = max(1, min(most, self.BYTES // (8 * wide)))
        kinds = ", ".join(f"`{c}` array<{t}>" for c, t in rows.dtypes if c != "_x")
        dealt = rows.repartition(max(1, -(-n // (most * blocks)))).sortWithinPartitions(key)
        return cut_lineage(dealt.mapInArrow(_pack(most), f"{kinds}, _x binary"))

    def _meet(self, left: DataFrame, right: DataFrame, on: list[str], key_type: str, train_type: str) -> DataFrame:
        schema = f"`{self.key}` {key_type}, _dist double, _tkey {train_type}, _y double"
        return self._ranked(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(_best(self.k, self.key), schema))

    def _ranked(self, near: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(self.key).orderBy("_dist", "_tkey"))
        return near.withColumn("_r", rank).where(F.col("_r") <= self.k)


class CoarseKnn(ExactKnn):
    """Approximate vote through coarse cells: k-means centres of a sample of the training vectors
    (at most ``SAMPLE``, those with the smallest hashes of their keys) cut the space into one list
    for every ``rows`` training rows (``LIST`` by default); every training row goes to the list of its nearest centre, a
    query row to its ``probes`` nearest lists only. A list of more than ``BLOCK`` rows is dealt over
    blocks, so no task grows with it.

    A training row is shuffled once, a query row ``probes`` times the blocks of a list. Recall
    against ``ExactKnn`` is measured by the query ``knn_index_recall``; more probes raise it,
    as many as lists make it exact.
    """

    SAMPLE, LIST, BLOCK = 100_000, 256, 16384

    def __init__(self, k: int = 5, key: str = "key", vec: str = "features", probes: int = 8, rows: int | None = None, seed: int = 42):
        super().__init__(k, key, vec)
        self.probes, self.rows, self.seed = probes, rows or self.LIST, seed

    def neighbours_of(self, train: DataFrame):
        tr = cut_lineage(self._training(train))
        n = tr.count()
        lists = max(1, -(-n // self.rows))
        share = min(1.0, self.SAMPLE / max(n, 1))
        sample = tr.where(F.pmod(F.xxhash64("_tkey", F.lit(self.seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        if lists > 1:
            model = KMeans(k=lists, seed=self.seed, featuresCol="_v", maxIter=10, initSteps=2).fit(sample.select(array_to_vector("_x").alias("_v")))
            centres = np.array(model.clusterCenters())
        else:  # one list of all rows
            centres = np.zeros((1, 1))
        probes = min(self.probes, len(centres))

        def lists_of(m: int):
            @F.pandas_udf("array<int>")
            def udf(x: pd.Series) -> pd.Series:
                if len(centres) == 1:
                    return pd.Series([[0]] * len(x), dtype=object)
                out = []
                for a in range(0, len(x), 1024):
                    X = np.array(x.iloc[a : a + 1024].tolist(), dtype=np.float64)
                    d = (X**2).sum(axis=1)[:, None] - 2 * X @ centres.T + (centres**2).sum(axis=1)[None, :]
                    out += list(np.argsort(d, axis=1, kind="stable")[:, :m].astype(np.int32))
                return pd.Series(out, dtype=object)

            return udf

        placed = cut_lineage(tr.withColumn("_list", lists_of(1)("_x")[0]))
        blocks = placed.groupBy("_list").agg(F.ceil(F.count("*") / self.BLOCK).cast("bigint").alias("_blocks"))
        right = placed.join(blocks, "_list").withColumn("_tb", _block("_tkey", F.col("_blocks"))).drop("_blocks")

        def near(df: DataFrame) -> DataFrame:
            q = self._rows(df).select(self.key, "_x").withColumn("_list", F.explode(lists_of(probes)("_x")))
            left = q.join(blocks, "_list").withColumn("_tb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
            return self._meet(left, right, ["_list", "_tb"], dict(df.dtypes)[self.key], dict(tr.dtypes)["_tkey"])

        return near
