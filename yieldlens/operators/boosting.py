"""Gradient-boosted trees of all cells (see ``cells``) grown together over rows that are stored once.

Spark's ``GBTClassifier`` fits one cell at a time: each of its trees is a fit of its own with several
jobs a level, 300 trees one after another in every cell. Here a tree of every cell is grown in one job a
level, by the same rules: labels -1 and 1, the loss 2 log(1 + exp(-2 y F)), a first tree of the labels
and further ones of the residuals 4 y / (1 + exp(2 y F)) times ``step``, splits of the least variance,
p = 1 / (1 + exp(-2 F)).

1. Thresholds, once: of each cell's imputed training values, midpoints of neighbours where they are few,
   else those of Spark's rule (neighbours nearest to the next of ``bins`` equal shares). They come from
   counts of all training rows; Spark's learner counts a sample of about 10,000.
2. A level: each task adds up, by open node and bin, the rows and residuals of its blocks; the driver adds
   up the tasks' sums and takes the best split of each node. It holds sums and the model (at most
   2 ** (depth + 1) nodes a tree), never rows.
3. The margins F of the training rows live with the blocks in memory or on disk, renewed with every tree.
   Every ``CUT`` trees they are written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .cells import FeatureSet
from .ordering import first_n, running_sums
from .packed import Design, PackedCells, Rows, scored, sigmoid, training

#: trees after which the margins are written, tasks whose sums go straight to the driver
CUT, DIRECT = 50, 64


@dataclass(frozen=True)
class BoostSpec:
    trees: int = 300
    depth: int = 4
    step: float = 0.05
    bins: int = 32


def cut_points(found: list[tuple[float, int, int]], distinct: int, total: int, bins: int) -> np.ndarray:
    """Thresholds of one column. ``found``: (value, its rows, rows up to it) ascending, all values or at
    least those next to the shares of ``total`` (see ``thresholds``)."""
    v = np.array([f[0] for f in found])
    n, upto = (np.array([f[i] for f in found], np.int64) for i in (1, 2))
    if distinct <= bins:
        return (v[:-1] + v[1:]) / 2
    stride, out, target = total / bins, [], total / bins
    for i in range(1, len(v)):
        before = upto[i] - n[i]
        if before == upto[i - 1] and abs(before - target) < abs(upto[i] - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out)


def thresholds(p: PackedCells, design: Design, bins: int) -> list[list[np.ndarray]]:
    """By cell and numeric column of the set."""
    listed, decoded, medians, numeric, own = p.listed, p.decoded, p.medians, design.numeric, design.own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decoded(batches):
            for c, at, held in listed:
                rows = training(b, at, held)
                for i, (j, m) in enumerate(zip(numeric, own, strict=True)):
                    if np.isnan(medians[c, j]) or not len(rows):
                        continue
                    v, n = np.unique(np.where(b.gone[rows, m] > 0, medians[c, j], b.x[rows, j]), return_counts=True)
                    at_col = pa.array(np.full(len(v), c), pa.int32()), pa.array(np.full(len(v), i), pa.int32())
                    yield pa.RecordBatch.from_arrays([*at_col, pa.array(v), pa.array(n.astype(np.int64))], names=["cell", "col", "v", "n"])

    out = [[np.zeros(0) for _ in numeric] for _ in listed]
    if not numeric:
        return out
    counts = p.blocks.mapInArrow(count, "cell int, col int, v double, n bigint").groupBy("cell", "col", "v").agg(F.sum("n").alias("n"))
    ranked = running_sums(counts, ["cell", "col"], ["v"], {"upto": F.col("n")}).persist(StorageLevel.DISK_ONLY)
    totals = {(r[0], r[1]): (r["k"], r["total"]) for r in ranked.groupBy("cell", "col").agg(F.count("*").alias("k"), F.sum("n").alias("total")).collect()}  # a row a cell and column
    sizes = p.blocks.sparkSession.createDataFrame([(*at, t) for at, (_, t) in totals.items()] or [(-1, -1, 1)], "cell int, col int, total bigint")
    # a threshold lies before the first value whose middle rank passes the next share, or, after frequent
    # values, before one of the next: the first ``bins`` values behind each share and the last of each
    share = F.least(F.ceil((F.col("upto") - F.col("n") / 2) * bins / F.col("total")), F.lit(bins))
    parted = ranked.join(F.broadcast(sizes), ["cell", "col"]).withColumn("share", share.cast("int")).drop("total")
    first = first_n(parted, ["cell", "col", "share"], ["v"], bins, small=True).select("cell", "col", "v", "n", "upto")
    last = parted.groupBy("cell", "col", "share").agg(F.max(F.struct("v", "n", "upto")).alias("m")).select("cell", "col", "m.*")
    near: dict[tuple, list] = {}
    for r in first.unionByName(last).distinct().collect():  # at most bins * (bins + 1) rows a cell and column
        near.setdefault((r["cell"], r["col"]), []).append((r["v"], r["n"], r["upto"]))
    ranked.unpersist()
    for (c, i), found in near.items():
        out[c][i] = cut_points(sorted(found), *totals[c, i], bins)
    return out


class _Columns:
    """Features as small codes: bins of numeric columns, flags, levels (``k`` for none). ``first`` is where
    a column's codes begin in the sums of a node; ``columns`` lists (column, code) of every candidate in the
    order of the features: rows go left up to a bin, without a flag, off a level."""

    def __init__(self, p: PackedCells, design: Design, edges: list[list[np.ndarray]], bins: int):
        self.numeric, self.own, self.flags, self.hot = design.numeric, design.own, design.flags, design.hot
        self.medians, self.modes, self.edges = p.medians, p.modes, edges
        self.plain, widths = len(self.numeric), [bins] * len(self.numeric) + [2] * len(self.flags) + [k + 1 for _, k in self.hot]
        widths = widths or [1]  # no feature: a constant one, which splits nothing
        self.first = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        self.columns = [(c, k) for c, w in enumerate(widths) for k in range(w - 1)]
        self.leveled = len(self.numeric) + len(self.flags)

    def codes(self, b: Rows, rows: np.ndarray, c: int) -> np.ndarray:
        """A row a column."""
        out = np.zeros((len(self.first) - 1, len(rows)), np.uint8 if self.first[-1] < 256 else np.int32)
        for i, (j, m) in enumerate(zip(self.numeric, self.own, strict=True)):
            if not np.isnan(self.medians[c, j]):
                out[i] = np.searchsorted(self.edges[c][i], np.where(b.gone[rows, m] > 0, self.medians[c, j], b.x[rows, j]))
        for i, m in enumerate(self.flags):
            out[self.plain + i] = b.gone[rows, m]
        for i, (j, k) in enumerate(self.hot):
            lv = b.levels[rows, j]
            lv = np.where(lv < 0, self.modes[c, j], lv)
            out[self.leveled + i] = np.where(lv < 0, k, lv)
        return out


class _Nodes:
    """Nodes of one tree of a cell by place (children of i: 2 i + 1, 2 i + 2); ``column`` -1: a leaf."""

    def __init__(self, depth: int, leveled: int):
        n = 2 ** (depth + 1) - 1
        self.column, self.code, self.value, self.leveled = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), leveled

    def route(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Places of rows after ``depth`` steps, or the leaves they met before."""
        node, rows = np.zeros(codes.shape[1], np.intp), np.arange(codes.shape[1])
        for _ in range(depth):
            column = self.column.take(node)
            x, code = codes[column, rows], self.code.take(node)
            right = np.where(column >= self.leveled, x == code, x > code)
            node = np.where(column < 0, node, 2 * node + 1 + right)
        return node


class _Margins:
    """The training rows of a block: codes, labels (-1, 1) and margins of each cell."""

    def __init__(self, b: Rows, columns: _Columns, listed: list[tuple]):
        self.cells = {}
        for c, at, held in listed:
            rows = training(b, at, held)
            if len(rows):
                self.cells[c] = columns.codes(b, rows, c), np.where(b.y[rows] > 0, 1.0, -1.0), np.zeros(len(rows))

    def after(self, trees: dict[int, _Nodes], depth: int, weight: float) -> _Margins:
        out = object.__new__(_Margins)
        out.cells = {c: (x, y, f + weight * trees[c].value.take(trees[c].route(x, depth))) for c, (x, y, f) in self.cells.items()}
        return out

    def sums(self, trees: dict[int, _Nodes], depth: int, opened: dict[int, np.ndarray], first: np.ndarray, start: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows and residuals by open node and code)."""
        width, begin = int(first[-1]), 2**depth - 1
        for c, (x, y, f) in self.cells.items():
            if c not in opened:
                continue
            with np.errstate(over="ignore"):
                r = y if start else 4.0 * y / (1.0 + np.exp(2.0 * y * f))
            place = np.full(2 ** (depth + 1), -1, np.int64)
            place[opened[c]] = np.arange(len(opened[c]))
            slot = place.take(trees[c].route(x, depth)) if depth else np.zeros(len(y), np.int64)
            on = np.flatnonzero(slot >= 0)
            if len(on) < len(slot):
                x, r, slot = x[:, on], r[on], slot[on]
            out = np.zeros((2, len(opened[c]), width))
            for i, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True)):
                at, n = slot * (z - a) + x[i], len(opened[c]) * (z - a)
                out[0, :, a:z] = np.bincount(at, minlength=n).reshape(-1, z - a)
                out[1, :, a:z] = np.bincount(at, r, n).reshape(-1, z - a)
            yield c, out


class PackedBoosting:
    """Boosted trees of every cell of ``p`` on the features of ``fs``, rows with equal weights."""

    def __init__(self, p: PackedCells, fs: FeatureSet, spec: BoostSpec = BoostSpec()):
        self.p, self.spec, design = p, spec, Design(p, fs)
        self.names = design.names
        self.columns = _Columns(p, design, thresholds(p, design, spec.bins), spec.bins)
        self.listed = [t for t in p.listed if p.classes[t[0]].sum() > 0]
        self.trees: dict[int, list[_Nodes]] = {c: [] for c, _, _ in self.listed}
        if self.listed:
            self._grow()

    def _grow(self) -> None:
        spec, columns, listed, decode = self.spec, self.columns, self.listed, self.p.shape
        spark = self.p.blocks.sparkSession
        ensure_checkpoint_dir(spark)
        blobs = self.p.blocks.select("y", "x", "gone", "levels", "folds", "chosen")
        parts = min(blobs.rdd.getNumPartitions(), max(spark.sparkContext.defaultParallelism, 1))
        now = blobs.rdd.coalesce(parts).map(lambda row: _Margins(Rows(row.asDict(), decode), columns, listed)).persist(StorageLevel.MEMORY_AND_DISK)
        grown = None
        for m in range(spec.trees):
            old = None
            if m:
                old, now = now, now.map(_renewed(grown, spec.depth, 1.0 if m == 1 else spec.step)).persist(StorageLevel.MEMORY_AND_DISK)
                if m % CUT == 0:
                    now.checkpoint()
            grown = {c: _Nodes(spec.depth, columns.leveled) for c, _, _ in listed}
            opened = {c: np.zeros(1, np.int64) for c in grown}
            for depth in range(spec.depth):
                found = self._summed(now, grown, depth, opened, m == 0)
                if old is not None:
                    old.unpersist()
                    old = None
                opened = {c: self._split(grown[c], opened[c], depth, found[c]) for c in opened}
                opened = {c: nodes for c, nodes in opened.items() if len(nodes)}
                if not opened:
                    break
            for c, tree in grown.items():
                self.trees[c].append(tree)
        now.unpersist()

    def _summed(self, now, trees: dict[int, _Nodes], depth: int, opened: dict[int, np.ndarray], start: bool) -> dict[int, np.ndarray]:
        first = self.columns.first

        def add(blocks: Iterator[_Margins]) -> Iterator[dict[int, np.ndarray]]:
            total: dict[int, np.ndarray] = {}
            for b in blocks:
                _added(total, b.sums(trees, depth, opened, first, start))
            yield total

        sums = now.mapPartitions(add)
        if now.getNumPartitions() > DIRECT:
            return sums.treeReduce(lambda a, b: _added(a, b.items()))
        total: dict[int, np.ndarray] = {}
        for one in sums.collect():  # sums by cell, node and code of each task
            _added(total, one.items())
        return total

    def _split(self, tree: _Nodes, nodes: np.ndarray, depth: int, sums: np.ndarray) -> np.ndarray:
        """Put the best splits of a level into a tree; the nodes to split next. Of equal splits, the first."""
        first, leveled = self.columns.first, self.columns.leveled
        total = sums[:, :, : first[1]].sum(axis=2)
        high = []
        for i, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True)):
            part = sums[:, :, a:z]
            high.append(part[:, :, :-1] if i >= leveled else np.cumsum(part[:, :, :0:-1], axis=2)[:, :, ::-1])
        right = np.concatenate(high, axis=2)
        left = total[:, :, None] - right
        if depth == 0:
            tree.value[0] = total[1, 0] / max(total[0, 0], 1.0)
        if not right.shape[2]:
            return np.zeros(0, np.int64)
        both = (left[0] > 0) & (right[0] > 0)
        square = [np.divide(s[1] ** 2, s[0], out=np.zeros(both.shape), where=both) for s in (left, right)]
        whole = total[1] ** 2 / total[0]
        gain = np.where(both, square[0] + square[1] - whole[:, None], -1.0)
        most = gain.max(axis=1)
        # sums of other orders differ in their last digits: splits within these are equal
        near = gain >= (most - 1e-9 * np.abs(most) - 1e-12 * whole)[:, None]
        best = np.argmax(near & both, axis=1)
        n = np.arange(len(nodes))
        # a gain within the rounding of the sums is none
        split = (most > 1e-12 * whole) & (most > 1e-15 * total[0])
        at = np.array(self.columns.columns)[best]
        for i in n[split]:
            k = nodes[i]
            tree.column[k], tree.code[k] = at[i]
            for child, s in ((2 * k + 1, left), (2 * k + 2, right)):
                tree.value[child] = s[1, i, best[i]] / s[0, i, best[i]]
        if depth + 1 == self.spec.depth:
            return np.zeros(0, np.int64)
        pairs = [(2 * nodes[i] + 1 + side, s[0, i, best[i]]) for i in n[split] for side, s in enumerate((left, right))]
        return np.array([k for k, rows in pairs if rows > 1], np.int64)

    def predict(self) -> DataFrame:
        """cell, rep, fold, key, carried columns, label, p: every row once by each cell that held it out."""
        spec, columns = self.spec, self.columns
        # arrays only: a broadcast names its classes, and executors need no install
        trees = self.p.blocks.sparkSession.sparkContext.broadcast({c: [vars(t) for t in some] for c, some in self.trees.items()})

        def score(b: Rows):
            def of(cell: int, rows: np.ndarray) -> dict[str, np.ndarray]:
                x, f = columns.codes(b, rows, cell), np.zeros(len(rows))
                tree = _Nodes(spec.depth, columns.leveled)
                for m, arrays in enumerate(trees.value[cell]):
                    vars(tree).update(arrays)
                    f += (spec.step if m else 1.0) * tree.value.take(tree.route(x, spec.depth))
                return {"p": sigmoid(2.0 * f)}

            return of

        return scored(self.p, score, "p double")


def _added(total: dict[int, np.ndarray], more) -> dict[int, np.ndarray]:
    for c, a in more:
        total[c] = total[c] + a if c in total else a
    return total


def _renewed(trees: dict[int, _Nodes], depth: int, weight: float):
    return lambda block: block.after(trees, depth, weight)
