"""Random forests of many cells grown together, in one pass or in one pass a level.

Spark ML grows one forest a fit; a protocol of 100 cells (repetition, held-out fold) would
read its table 900 times. Here all trees of all cells share the passes:

1. Bin once: thresholds of each numeric column are quantiles of its values (no labels); rows
   become blocks of small integers in the shared folder, with the fold of every repetition.
   A missing value takes the bin of the cell's own training median, a missing level its mode.
2. A table of ``WHOLE`` rows at most goes to every task, which grows whole trees and keeps the place of
   each row from level to level (``_whole``). Larger ones take a pass a level: each task routes its rows through the trees so far, a tree at a time, and counts,
   for every open node and each of its sampled features, the rows by bin and class. A task adds
   up the counts of all its blocks (``GROUP`` at most) and sends them in the narrowest integers;
   those of different tasks meet in a shuffle by chunk of trees, where the best split of each node (weighted
   Gini, at least ``min_leaf`` rows a side) is found. The driver receives the splits: what it
   holds and broadcasts is the model, bounded by cells * trees * 2 ** (depth + 1) nodes,
   never rows.
3. Scores: one pass, each row by the cells that held it out.

Bootstrap counts (Poisson) and feature samples are hashes of (seed, tree, row key or node),
counts are integers: the forest does not depend on partitions or on the order of rows, and a
task that is run again gives the same.

``values`` of nodes give path contributions: along a row's path each split adds the change of
the node's value to its feature; with the root values they sum to the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import prep as PR
from .cells import FeatureSet, level_index
from .metrics import exact_quantiles

#: rows of a block, trees of a chunk, blocks whose counts a task adds up before it sends them
BLOCK, CHUNK, GROUP = 1 << 15, 25, 16
#: rows up to which every task has the whole table, drawn rows of the trees grown at once, rows a node from which nodes are counted one by one
WHOLE, TOGETHER, DENSE = 1 << 21, 1 << 17, 256
MISSING = 255
_POISSON = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040]))
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 300
    depth: int = 8
    min_leaf: int = 15
    bins: int = 32
    seed: int = 42
    #: features tried at a node; 0: the root of their number
    tried: int = 0


def _hash(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _bootstrap(row_hash: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """Times that each row (columns) is drawn for each tree (rows)."""
    t = _hash((trees.astype(np.uint64) + np.uint64(1)) * _GOLD + np.uint64(seed))
    u = _hash(row_hash[None, :] ^ t[:, None])
    u >>= np.uint64(11)
    cuts = (_POISSON * 2.0**53).astype(np.uint64)
    out = (u >= cuts[0]).astype(np.uint8)
    # few rows are drawn more than once: the further cuts look at those only
    at = np.flatnonzero(u >= cuts[1])
    flat, some = out.reshape(-1), u.reshape(-1)[at]
    for c in cuts[1:]:
        on = np.flatnonzero(some >= c)
        at, some = at[on], some[on]
        flat[at] += 1
    return out


# ---------------------------------------------------------------- rows


@dataclass
class BinnedRows:
    """Blocks of binned rows, and what is known of each cell."""

    blocks: DataFrame
    parts: int
    key: str
    keep: list[str]
    numeric: list[str]
    flags: list[str]
    categorical: list[str]
    levels: dict[str, int]
    edges: dict[str, np.ndarray]
    #: (cell, place of its repetition, fold), and per cell: bins of the medians, places of the modes, rows by class
    cells: list[tuple]
    reps: list
    medians: np.ndarray
    modes: np.ndarray
    classes: np.ndarray
    key_type: str = "bigint"
    keep_types: list[str] = field(default_factory=list)
    #: type of the folds; whether every task has all rows
    fold_kind: str = "<i4"
    whole: bool = False


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, np.ndarray]:
    """Thresholds of each column: its distinct quantiles of order i / bins."""
    if not cols:
        return {}
    qs = [i / bins for i in range(1, bins)]
    long = PR._long(df, cols, [], "double")
    found = {r["_col"]: sorted({float(v) for v in r[1:] if v is not None}) for r in exact_quantiles(long, "_val", qs, ["_col"]).collect()}  # a row a column
    return {c: np.array(found.get(c, [])) for c in cols}


def fold_arrays(folds: DataFrame, group: str) -> tuple[DataFrame, list]:
    """(group, folds): the fold of each repetition, in order of the repetitions."""
    reps = [r[0] for r in folds.select("rep").distinct().orderBy("rep").collect()]
    place = F.create_map(*[x for i, r in enumerate(reps) for x in (F.lit(r), F.lit(i))])
    per = folds.groupBy(group).agg(F.collect_list(F.struct(place[F.col("rep")].alias("at"), F.col("fold").cast("int").alias("fold"))).alias("_f"))
    return per.select(group, F.transform(F.array_sort("_f"), lambda x: x["fold"]).alias("folds")), reps


def bin_rows(
    df: DataFrame, folds: DataFrame, group: str, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
    missing_flags: Sequence[str] = (), keep: Sequence[str] = (), bins: int = 32, test_folds: Sequence[int] | None = None,
) -> BinnedRows:
    """Bin ``df``, one row a key. ``folds`` is (rep, group, fold) with integer folds, every group in
    every repetition. Rows without a label are scored, but train nothing."""
    numeric, categorical, flags = list(numeric), list(categorical), list(missing_flags)
    per_group, reps = fold_arrays(folds, group)
    rows = df.join(per_group, group).withColumn("_y", F.col(label).cast("int"))
    levels = {}
    for c in categorical:
        index = cut_lineage(level_index(df, c))
        levels[c] = index.count()
        rows = rows.join(index, c, "left").withColumn(f"{c}_ix", F.coalesce(F.col(f"{c}_ix"), F.lit(-1)))
    rows = cut_lineage(rows.hint("rebalance"))
    edges = bin_edges(rows, numeric, bins)
    pairs = [(r[0], r[1]) for r in folds.select("rep", F.col("fold").cast("int")).distinct().orderBy("rep", "fold").collect()]
    cells = [(i, reps.index(rep), fold) for i, (rep, fold) in enumerate(p for p in pairs if test_folds is None or p[1] in set(test_folds))]
    fold_kind = "i1" if all(-128 <= fold < 128 for _, fold in pairs) else "<i4"
    table = df.sparkSession.createDataFrame(cells, "cell int, _at int, _held int")
    stack = rows.where("_y IS NOT NULL").join(F.broadcast(table), F.expr("folds[_at] <> _held"))  # a row a cell
    classes = np.zeros((len(cells), 2), np.int64)
    for r in stack.groupBy("cell", "_y").agg(F.count("*").alias("n")).collect():  # two rows a cell
        classes[r["cell"], r["_y"]] = r["n"]
    medians = np.zeros((len(cells), len(numeric)), np.uint8)
    if numeric:
        for r in PR.fit_medians(stack, numeric, ["cell"]).collect():  # a row a cell and column
            j = numeric.index(r["_col"])
            medians[r["cell"], j] = np.searchsorted(edges[r["_col"]], r["median"])
    modes = np.full((len(cells), len(categorical)), -1, np.int64)
    for i, c in enumerate(categorical):
        ix = F.col(f"{c}_ix")
        counts = stack.where(ix >= 0).groupBy("cell", ix.alias("ix")).agg(F.count("*").alias("n"))
        most = counts.groupBy("cell").agg(F.min_by("ix", F.struct(-F.col("n"), F.col("ix"))).alias("ix"))
        for r in most.collect():  # a row a cell
            modes[r["cell"], i] = r["ix"]
    types = dict(rows.dtypes)
    base = rows.select(
        F.col(key).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.xxhash64(F.col(key)).alias("h"), F.coalesce("_y", F.lit(-1)).alias("y"),
        "folds", *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(numeric)],
        *[F.col(c).isNull().alias(f"f_{i}") for i, c in enumerate(flags)], *[F.col(f"{c}_ix").alias(f"c_{i}") for i, c in enumerate(categorical)],
    )
    names = ["key", *[f"keep_{c}" for c in keep]]
    kinds = [types[key], *[types[c] for c in keep]]
    schema = ", ".join(f"`{n}` array<{t}>" for n, t in zip(names, kinds, strict=True))
    schema += ", h binary, y binary, folds binary, bins binary, levels binary"
    edge_list, most = [edges[c] for c in numeric], BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(b: pa.Table) -> pa.RecordBatch:
            n = b.num_rows
            x = np.full((n, len(edge_list) + len(flags)), MISSING, np.uint8)
            for i, e in enumerate(edge_list):
                v = b.column(f"x_{i}").to_numpy()
                ok = ~np.isnan(v)
                x[ok, i] = np.searchsorted(e, v[ok])
            for i in range(len(flags)):
                x[:, len(edge_list) + i] = b.column(f"f_{i}").to_numpy()
            lv = np.zeros((n, len(categorical)), "<i4")
            for i in range(len(categorical)):
                lv[:, i] = b.column(f"c_{i}").to_numpy()
            f = np.array(b.column("folds").to_pylist(), fold_kind).reshape(n, -1)
            blobs = [b.column("h").to_numpy().astype("<i8"), b.column("y").to_numpy().astype("i1"), f, x, lv]
            at = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(at, b.column(c).combine_chunks()) for c in names]
            return pa.RecordBatch.from_arrays(lists + [pa.array([z.tobytes()], pa.binary()) for z in blobs], names=[*names, "h", "y", "folds", "bins", "levels"])

        held, size = [], 0
        for b in batches:
            for k in range(0, b.num_rows, most):
                held.append(b.slice(k, most))
                size += held[-1].num_rows
                if size >= most:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield block(pa.Table.from_batches(held))

    blocks = cut_lineage(base.mapInArrow(pack, schema))
    # groups of blocks go to several tasks each, which share out the trees
    sizes = blocks.select(F.monotonically_increasing_id().alias("id"), F.octet_length("y").alias("n")).collect()  # a row a block
    ids, whole = [r["id"] for r in sizes], sum(r["n"] for r in sizes) <= WHOLE
    groups = 1 if whole else max(1, -(-len(ids) // GROUP))
    parts = -(-df.sparkSession.sparkContext.defaultParallelism * 2 // groups)
    place = df.sparkSession.createDataFrame([(b, i % groups) for i, b in enumerate(ids)], "_id bigint, _group int")
    dealt = blocks.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(place), "_id")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = cut_lineage(dealt.repartitionById(groups * parts, F.col("_group") * parts + F.col("part")).drop("_id", "_group"))
    return BinnedRows(blocks, parts, key, list(keep), numeric, flags, categorical, levels, edges, cells, reps, medians, modes, classes, types[key], [types[c] for c in keep], fold_kind, whole)


class _Block:
    """Decoded block, restricted to the columns of a feature set."""

    def __init__(self, row: dict, plain: list[int], n_numeric: int, n_plain: int, hot: list[tuple[int, int]], n_cat: int, fold_kind: str):
        self.h = np.frombuffer(row["h"], "<i8").view(np.uint64)
        n = len(self.h)
        self.y = np.frombuffer(row["y"], "i1").astype(np.int64)
        self.folds = np.frombuffer(row["folds"], fold_kind).reshape(n, -1)
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(n, n_plain)[:, plain]
        self.levels = np.frombuffer(row["levels"], "<i4").reshape(n, n_cat)
        self.numeric, self.hot = [(i, p) for i, p in enumerate(plain) if p < n_numeric], hot

    def of_cell(self, medians: np.ndarray, modes: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Features in bins, the cell's medians and modes in place of missing values."""
        x = self.bins[rows].copy()
        for i, p in self.numeric:
            x[x[:, i] == MISSING, i] = medians[p]
        hot = []
        for c, k in self.hot:
            levels = self.levels[rows, c]
            at = np.where(levels < 0, modes[c], levels)
            hot.append((at[:, None] == np.arange(k)[None, :]).astype(np.uint8))
        return np.concatenate([x, *hot], axis=1)


# ---------------------------------------------------------------- model


@dataclass
class Level:
    """Nodes of one depth, by tree: ``feature`` -1 marks leaves; ``left`` is the place of the left
    child in the next level (the right one follows); ``begin`` the first node of each tree."""

    begin: np.ndarray
    count: np.ndarray
    value: np.ndarray
    open: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray


class _Routes:
    """Nodes of some trees as look-up tables, a level each. Nodes are counted from the first tree; a
    level has one more node, where rows are kept that met a leaf before. ``x`` is 2 * bin + class:
    a row goes left up to ``cut``, whatever its class."""

    def __init__(self, levels: list, a: int, z: int):
        self.levels = []
        for depth, (begin, feature, cut, left) in enumerate(levels):
            lo, hi = begin[a], begin[z]
            f = feature[lo:hi].astype(np.intp)
            out = levels[depth + 1][0] if depth + 1 < len(levels) else None
            ended = int(out[z] - out[a]) if out is not None else 0
            leaf = np.append(f < 0, True)
            to = np.full(len(f) + 1, ended, np.intp)
            if out is not None:
                to[:-1][f >= 0] = left[lo:hi][f >= 0] - out[a]
            to[leaf] = ended
            cuts = np.append(2 * cut[lo:hi].astype(np.int64) + 1, 0)
            cuts[leaf] = np.iinfo(np.uint16).max  # all go left, to the kept place
            self.levels.append((np.where(leaf, 0, np.append(f, 0)), cuts.astype(np.uint16), to, leaf))
        self.begin = [b[a : z + 1] - b[a] for b, _, _, _ in levels]

    def step(self, depth: int, node: np.ndarray, base: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of the rows in the next level; ``base`` is where a row begins in the flat ``x``."""
        feature, cut, to, _ = self.levels[depth]
        at = feature.take(node)
        at += base
        out = to.take(node)
        out += x.take(at) > cut.take(node)
        return out


def _sampled(trees: np.ndarray, places: np.ndarray, depth: int, d: int, m: int, seed: int) -> np.ndarray:
    """The m features tried at each node, ascending."""
    node = _hash(trees.astype(np.uint64) * _GOLD + np.uint64(seed + 7919 * (depth + 1)) + places.astype(np.uint64) * _M1)
    order = _hash(node[:, None] + (np.arange(d, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :m], axis=1) if m < d else np.tile(np.arange(d), (len(trees), 1))


def _best(by_bin: np.ndarray, sampled: np.ndarray, w: np.ndarray, min_leaf: int) -> np.ndarray:
    """The best split of each node from its rows by tried feature, bin and class."""
    low = np.cumsum(by_bin, axis=2, dtype=np.int64)
    total = low[:, :1, -1:, :]
    high = total - low

    def impurity(c):
        w0, w1 = c[..., 0] * w[0], c[..., 1] * w[1]
        both = w0 + w1
        return np.divide(2 * w0 * w1, both, out=np.zeros(both.shape), where=both > 0)

    gain = impurity(total) - impurity(low) - impurity(high)
    enough = (low.sum(axis=-1) >= min_leaf) & (high.sum(axis=-1) >= min_leaf)
    gain = np.where(enough, gain, -1.0).reshape(len(by_bin), -1)
    # shares rounded, so that equal splits tie whatever the order of sums, and the first wins
    base = impurity(total).reshape(-1, 1)
    at = np.round(np.divide(gain, base, out=np.full(gain.shape, -1.0), where=base > 0), 10).argmax(axis=1)
    n = np.arange(len(by_bin))
    out = np.zeros(len(by_bin), _SPLIT)
    j, cut = at // by_bin.shape[2], at % by_bin.shape[2]
    out["gain"] = gain[n, at]
    split = out["gain"] > 1e-12
    out["feature"] = np.where(split, sampled[n, j], -1)
    out["cut"] = cut
    out["sides"][:, 0], out["sides"][:, 1] = low[n, j, cut], high[n, j, cut]
    return out


def _opened(count: np.ndarray, below: int, spec: ForestSpec) -> np.ndarray:
    """Whether nodes of a depth with these rows by class are split further."""
    return (count.sum(axis=1) >= 2 * spec.min_leaf) & (count > 0).all(axis=1) & (below < spec.depth)


def _grow_trees(x: np.ndarray, drawn: list, trees: np.ndarray, w: np.ndarray, tried: int, spec: ForestSpec) -> list[np.ndarray]:
    """The splits of the open nodes of some trees, an array a depth. ``x`` is 2 * bin + class, a row a
    feature; ``drawn`` has (rows, times) of each tree. Nodes with many rows keep them apart; when they
    have few, those of all nodes are counted together."""
    d, n = x.shape
    width, flat, out = 2 * spec.bins, x.ravel(), []
    own, both = list(drawn), None  # (rows, times) a node, or (rows, times, node) of all nodes
    tree_of, places = np.arange(len(trees)), np.zeros(len(trees), np.int64)
    for depth in range(spec.depth):
        m = len(tree_of)
        if not m:
            break
        if both is None and sum(len(rows) for rows, _ in own) < DENSE * m:
            both = np.concatenate([rows for rows, _ in own]), np.concatenate([times for _, times in own]), np.repeat(np.arange(m), [len(rows) for rows, _ in own])
        sampled = _sampled(trees[tree_of], places, depth, d, tried, spec.seed).astype(np.intp)
        counts = np.zeros((m, tried, width), np.int64)
        if both is None:
            for i, (rows, times) in enumerate(own):
                for j, f in enumerate(sampled[i].tolist()):
                    counts[i, j] = np.bincount(x[f].take(rows), times, width)
        else:
            rows, times, node = both
            slot, begin = node * width, np.ascontiguousarray(sampled.T) * n
            for j in range(tried):
                at = begin[j].take(node)
                at += rows
                counts[:, j] = np.bincount(slot + flat.take(at), times, m * width).reshape(m, width)
        found = _best(counts.reshape(m, tried, spec.bins, 2), sampled, w, spec.min_leaf)
        out.append(found)
        split = np.flatnonzero(found["feature"] >= 0)
        below = np.repeat(tree_of[split], 2)
        goes_on = _opened(found["sides"][split].reshape(-1, 2), depth + 1, spec)
        opened = np.flatnonzero(goes_on)
        # rows go to the children of nodes that split, and on if these are open
        if both is None:
            kept = []
            for k, i in enumerate(split.tolist()):
                if goes_on[2 * k] or goes_on[2 * k + 1]:
                    rows, times = own[i]
                    right = x[found["feature"][i]].take(rows) > 2 * found["cut"][i] + 1
                    for side, on in ((~right, goes_on[2 * k]), (right, goes_on[2 * k + 1])):
                        if on:
                            at = np.flatnonzero(side)
                            kept.append((rows.take(at), times.take(at)))
            own = kept
        else:
            number = np.full(2 * len(split) + 2, -1, np.intp)
            number[opened] = np.arange(len(opened))
            first = np.full(m, 2 * len(split), np.intp)
            first[split] = 2 * np.arange(len(split))
            at = (np.maximum(found["feature"], 0).astype(np.intp) * n).take(node)
            at += rows
            child = first.take(node)
            child += flat.take(at) > (2 * found["cut"] + 1).astype(x.dtype).take(node)
            child = number.take(child)
            on = np.flatnonzero(child >= 0)
            both = rows.take(on), times.take(on), child.take(on)
        tree_of = below[opened]
        places = opened - np.searchsorted(below, tree_of)
    return out


def _value(count: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = count * weight
    return np.divide(w[:, 1], w.sum(axis=1), out=np.full(len(w), 0.5), where=w.sum(axis=1) > 0)


class CellForests:
    """One forest a cell of ``data`` on the features of ``fs``."""

    def __init__(self, data: BinnedRows, fs: FeatureSet, spec: ForestSpec = ForestSpec()):
        self.data, self.fs, self.spec = data, fs, spec
        plain = [data.numeric.index(c) for c in fs.numeric] + [len(data.numeric) + data.flags.index(c) for c in fs.missing_flags]
        hot = [(data.categorical.index(c), data.levels[c]) for c in fs.categorical]
        self.names = [*fs.numeric, *[f"{c}_missing" for c in fs.missing_flags], *[f"{c}_{i}" for c in fs.categorical for i in range(data.levels[c])]]
        self.decode = (plain, len(data.numeric), len(data.numeric) + len(data.flags), hot, len(data.categorical), data.fold_kind)
        self.tried = min(len(self.names), spec.tried or max(1, int(len(self.names) ** 0.5)))
        n = data.classes.sum(axis=1, keepdims=True)
        k = (data.classes > 0).sum(axis=1, keepdims=True)
        #: balanced class weights of each cell
        self.weights = np.divide(n, k * data.classes, out=np.zeros(data.classes.shape), where=data.classes > 0)
        self.n_trees = len(data.cells) * spec.trees
        self.levels: list[Level] = []
        self._grow()

    def _slim(self) -> list[tuple]:
        """What routing needs of each level, in narrow integers."""
        return [(v.begin, v.feature.astype(np.int32), v.cut.astype(np.uint8), v.left) for v in self.levels]

    # a chunk is (first tree, last tree + 1) of one cell
    def _chunks(self) -> list[tuple[int, int]]:
        t = self.spec.trees
        return [(c * t + a, c * t + min(a + CHUNK, t)) for c in range(len(self.data.cells)) for a in range(0, t, CHUNK)]

    def _grow(self) -> None:
        spark = self.data.blocks.sparkSession
        if not self.names or not self.data.cells:
            return
        if self.data.whole:
            known = spark.sparkContext.broadcast((self.data.cells, self.data.medians, self.data.modes, self._chunks(), self.weights))
            grown = cut_lineage(self.data.blocks.mapInArrow(self._whole(known), "depth int, chunk int, splits binary"))
            known.unpersist()
            for depth in range(self.spec.depth):
                found = grown.where(F.col("depth") == depth).collect()  # a row a chunk of trees
                if not found or not self._add(depth, {r["chunk"]: r["splits"] for r in found}):
                    break
            return
        for depth in range(self.spec.depth):
            model = spark.sparkContext.broadcast((self._slim(), self.levels[-1].open if depth else None, self.data.cells, self.data.medians, self.data.modes, self._chunks(), self.weights))
            counted = self.data.blocks.mapInArrow(self._count(model, depth), "chunk int, counts binary")
            by_chunk = counted.repartition(F.col("chunk")).sortWithinPartitions("chunk")
            found = by_chunk.mapInArrow(self._split(model, depth), "chunk int, splits binary").collect()  # a row a chunk of trees
            model.unpersist()
            if not found or not self._add(depth, {r["chunk"]: r["splits"] for r in found}):
                break

    def _root(self) -> Level:
        n = self.n_trees
        z = np.zeros(n, np.int32)
        return Level(np.arange(n + 1), np.zeros((n, 2), np.int64), np.zeros(n), np.ones(n, bool), z - 1, z.copy(), z - 1, np.zeros(n))

    def _add(self, depth: int, splits: dict[int, bytes]) -> bool:
        """Put the splits of a depth into its level and open the next one; False if none split."""
        if depth == 0:
            self.levels.append(self._root())
        level = self.levels[depth]
        tree_of = np.repeat(np.arange(self.n_trees), np.diff(level.begin))
        weight = self.weights[tree_of // self.spec.trees]
        sides = np.zeros((len(tree_of), 2, 2), np.int64)
        for chunk, (a, z) in enumerate(self._chunks()):
            nodes = np.arange(level.begin[a], level.begin[z])
            nodes = nodes[level.open[nodes]]
            if chunk not in splits or not len(nodes):
                level.feature[nodes] = -1
                continue
            s = np.frombuffer(splits[chunk], _SPLIT)
            level.feature[nodes], level.cut[nodes], level.gain[nodes] = s["feature"], s["cut"], s["gain"]
            sides[nodes] = s["sides"]
        if depth == 0:
            level.count = sides.sum(axis=1)
            level.value = _value(level.count, weight)
        split = level.feature >= 0
        level.left = np.where(split, 2 * np.cumsum(split) - 2, -1).astype(np.int32)
        if not split.any():
            return False
        count = sides[split].reshape(-1, 2)
        tree = np.repeat(tree_of[split], 2)
        begin = np.searchsorted(tree, np.arange(self.n_trees + 1))
        opened = _opened(count, depth + 1, self.spec)
        n = len(tree)
        self.levels.append(
            Level(begin, count, _value(count, np.repeat(weight[split], 2, axis=0)), opened, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n))
        )
        return bool(opened.any())

    # -------------------------------------------------------- tasks

    def _count(self, model, depth: int):
        spec, decode, tried, d = self.spec, self.decode, self.tried, len(self.names)
        parts, bins = self.data.parts, spec.bins

        def prepared(block: _Block, cell: tuple, medians, modes):
            """Row hashes, classes and flat 2 * bin + class of the cell's training rows, and the row starts."""
            no, at, held = cell
            rows = np.flatnonzero((block.y >= 0) & (block.folds[:, at] != held))
            x = 2 * block.of_cell(medians[no], modes[no])[rows].astype(np.uint16) + block.y[rows].astype(np.uint16)[:, None]
            return block.h[rows], x.ravel(), np.arange(len(rows)) * d

        def count(routes: _Routes, t: int, tree: int, data: tuple, number: np.ndarray, sampled: np.ndarray, counts: np.ndarray):
            """Add the rows of a block to the counts of one tree's open nodes."""
            h, x, starts = data
            drawn = _bootstrap(h, np.array([tree]), spec.seed)[0]
            rows = np.flatnonzero(drawn)
            base = starts.take(rows)
            node = np.full(len(rows), t if depth == 0 else routes.begin[0][t], np.intp)
            for k in range(depth):
                node = routes.step(k, node, base, x)
            mine = number.take(node)
            on = np.flatnonzero(mine >= 0)
            if len(on) < len(rows):
                mine, base, rows = mine.take(on), base.take(on), rows.take(on)
            if not len(on):
                return
            times = drawn.take(rows).astype(np.float64)
            low, high = int(mine.min()), int(mine.max()) + 1
            mine -= low
            slot = mine * (2 * bins)
            for j in range(tried):
                at = sampled[low:high, j].take(mine)
                at += base
                add = np.bincount(slot + x.take(at), times, (high - low) * 2 * bins)
                counts[low:high, j] += add.reshape(high - low, -1).astype(np.int64)

        def of_part(part: int, blocks: list[_Block]) -> Iterator[pa.RecordBatch]:
            levels, opened_all, cells, medians, modes, chunks, _ = model.value
            cell_now, data = None, []
            for no in range(part, len(chunks), parts):
                a, z = chunks[no]
                first, last = (a, z) if depth == 0 else (levels[depth][0][a], levels[depth][0][z])
                opened = np.ones(z - a, bool) if depth == 0 else opened_all[first:last]
                if not opened.any():
                    continue
                cell = cells[a // spec.trees]
                if cell != cell_now:
                    cell_now, data = cell, [prepared(b, cell, medians, modes) for b in blocks]
                if not any(len(h) for h, _, _ in data):
                    continue
                nodes = np.flatnonzero(opened)
                tree_of = nodes if depth == 0 else np.repeat(np.arange(z - a), np.diff(levels[depth][0][a : z + 1]))[nodes]
                places = np.zeros(len(nodes), np.int64) if depth == 0 else nodes + first - levels[depth][0][tree_of + a]
                sampled = _sampled(tree_of + a, places, depth, d, tried, spec.seed).astype(np.intp)
                number = np.full(len(opened) + 1, -1, np.intp)  # the last one: rows that met a leaf before
                number[nodes] = np.arange(len(nodes))
                counts = np.zeros((len(nodes), tried, 2 * bins), np.int64)
                routes = None if depth == 0 else _Routes(levels, a, z)
                for t in np.unique(tree_of).tolist():
                    for one in data:
                        count(routes, t, a + t, one, number, sampled, counts)
                most = counts.max()
                kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([counts.astype(kind).tobytes()], pa.binary())], names=["chunk", "counts"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, list[_Block]] = {}
            for batch in batches:
                for row in batch.select(["h", "y", "folds", "bins", "levels", "part"]).to_pylist():
                    blocks.setdefault(row["part"], []).append(_Block(row, *decode))
            for part, some in blocks.items():
                yield from of_part(part, some)

        return run

    def _whole(self, known):
        """Whole trees in a task, which has all rows and a run of the chunks."""
        spec, decode, tried, d, parts = self.spec, self.decode, self.tried, len(self.names), self.data.parts
        kind = np.uint8 if spec.bins <= 127 else np.uint16

        def prepared(blocks: list[_Block], cell: tuple, medians, modes) -> tuple[np.ndarray, np.ndarray]:
            """Row hashes and 2 * bin + class of the cell's training rows, a row a feature."""
            no, at, held = cell
            h, x = [np.zeros(0, np.uint64)], [np.zeros((d, 0), kind)]
            for b in blocks:
                rows = np.flatnonzero((b.y >= 0) & (b.folds[:, at] != held))
                h.append(b.h[rows])
                one = b.of_cell(medians[no], modes[no], rows).astype(kind)
                one *= 2
                one += b.y[rows].astype(kind)[:, None]
                x.append(one.T)
            return np.concatenate(h), np.concatenate(x, axis=1)

        def of_chunk(a: int, z: int, h: np.ndarray, x: np.ndarray, w: np.ndarray) -> list[bytes]:
            out, held, first, size = [b""] * spec.depth, [], a, 0
            for t in range(a, z):
                times = _bootstrap(h, np.array([t]), spec.seed)[0]
                rows = np.flatnonzero(times)
                held.append((rows, times.take(rows).astype(np.float64)))
                size += len(rows)
                if size >= TOGETHER or t + 1 == z:
                    for depth, s in enumerate(_grow_trees(x, held, np.arange(first, t + 1), w, tried, spec)):
                        out[depth] += s.tobytes()
                    held, first, size = [], t + 1, 0
            return out

        def of_part(part: int, blocks: list[_Block]) -> Iterator[pa.RecordBatch]:
            cells, medians, modes, chunks, weights = known.value
            now, h, x = None, None, None
            for no in range(len(chunks) * part // parts, len(chunks) * (part + 1) // parts):
                a, z = chunks[no]
                cell = cells[a // spec.trees]
                if cell != now:
                    now, (h, x) = cell, prepared(blocks, cell, medians, modes)
                if not len(h):
                    continue
                splits = [(depth, s) for depth, s in enumerate(of_chunk(a, z, h, x, weights[a // spec.trees])) if s]
                cols = [pa.array([depth for depth, _ in splits], pa.int32()), pa.array([no] * len(splits), pa.int32()), pa.array([s for _, s in splits], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["depth", "chunk", "splits"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, list[_Block]] = {}
            for b in batches:
                for k in range(b.num_rows):
                    row = {c: b.column(c)[k].as_buffer() for c in ("h", "y", "folds", "bins", "levels")}
                    blocks.setdefault(b.column("part")[k].as_py(), []).append(_Block(row, *decode))
            for part, some in blocks.items():
                yield from of_part(part, some)

        return run

    def _split(self, model, depth: int):
        spec, tried, d = self.spec, self.tried, len(self.names)

        def nodes_of(no: int, levels, opened, chunks) -> tuple[np.ndarray, np.ndarray]:
            a, z = chunks[no]
            if depth == 0:
                trees, places = np.arange(a, z), np.zeros(z - a, np.int64)
            else:
                begin = levels[depth][0]
                nodes = np.flatnonzero(opened[begin[a] : begin[z]])
                trees = np.repeat(np.arange(a, z), np.diff(begin[a : z + 1]))[nodes]
                places = nodes + begin[a] - begin[trees]
            return trees, places

        def best(no: int, trees: np.ndarray, places: np.ndarray, counts: np.ndarray, chunks, weights) -> bytes:
            sampled = _sampled(trees, places, depth, d, tried, spec.seed)
            return _best(counts.reshape(len(trees), tried, spec.bins, 2), sampled, weights[chunks[no][0] // spec.trees], spec.min_leaf).tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, opened, _, _, _, chunks, weights = model.value
            now, at, total = None, None, None

            def done():
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([best(now, *at, total, chunks, weights)], pa.binary())], names=["chunk", "splits"])

            for batch in batches:
                for no, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                    if no != now:
                        if now is not None:
                            yield done()
                        now, at = no, nodes_of(no, levels, opened, chunks)
                        total = np.zeros(len(at[0]) * tried * spec.bins * 2, np.int64)
                    data = blob.as_buffer()
                    total += np.frombuffer(data, f"<u{data.size // len(total)}")
            if now is not None:
                yield done()

        return run

    def predict(self) -> DataFrame:
        """cell, rep, fold, key, carried columns, label, p: every row once by each cell that held it out."""
        return self._score(False)

    def contributions(self) -> DataFrame:
        """As ``predict``, with base (mean root value) and contributions (array, by ``names``): they sum to p."""
        return self._score(True)

    def _score(self, explain: bool) -> DataFrame:
        data, spec, decode, d, parts = self.data, self.spec, self.decode, len(self.names), self.data.parts
        spark = data.blocks.sparkSession
        model = spark.sparkContext.broadcast((self._slim(), [v.value for v in self.levels], data.cells, data.medians, data.modes, data.reps))
        names = ["key", *[f"keep_{c}" for c in data.keep]]
        kinds = [data.key_type, *data.keep_types]
        rep_type = "int" if all(isinstance(r, int) for r in data.reps) else "string"
        schema = f"cell int, rep {rep_type}, fold int, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)) + ", label_d double, p double"
        if explain:
            schema += ", base double, contributions array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, values, cells, medians, modes, reps = model.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in ("h", "y", "folds", "bins", "levels", "part")}
                    block = _Block(row, *decode)
                    for cell, at, held in cells[row["part"] :: parts]:
                        rows = np.flatnonzero(block.folds[:, at] == held)
                        if not len(rows):
                            continue
                        x = 2 * block.of_cell(medians[cell], modes[cell])[rows].astype(np.uint16).ravel()
                        starts, i = np.arange(len(rows)) * d, np.arange(len(rows))
                        p, base, why = np.zeros(len(rows)), 0.0, np.zeros((len(rows), d) if explain else 0)
                        first, last = cell * spec.trees, (cell + 1) * spec.trees
                        if not levels:
                            p += 0.5 * spec.trees
                            base += 0.5 * spec.trees
                        for t0 in range(first, last if levels else first, CHUNK):
                            t1 = min(t0 + CHUNK, last)
                            routes = _Routes(levels, t0, t1)
                            worth = [np.append(v[b[t0] : b[t1]], 0.0) for v, (b, _, _, _) in zip(values, levels, strict=True)]
                            # what a row gains at a node: its value, if the node is a leaf
                            ends = [np.where(leaf, w, 0.0) for w, (_, _, _, leaf) in zip(worth, routes.levels, strict=True)]
                            base += worth[0][:-1].sum()
                            for t in range(t1 - t0):
                                node = np.full(len(rows), t, np.intp)
                                for depth in range(len(levels)):
                                    p += ends[depth].take(node)
                                    if depth + 1 == len(levels) or (routes.levels[depth][3].take(node)).all():
                                        break
                                    child = routes.step(depth, node, starts, x)
                                    if explain:
                                        on = np.flatnonzero(~routes.levels[depth][3].take(node))
                                        gain = worth[depth + 1].take(child[on]) - worth[depth].take(node[on])
                                        why[i[on], routes.levels[depth][0].take(node[on])] += gain
                                    node = child
                        n = len(rows)
                        take = pa.array(rows)
                        cols = [batch.column(c)[k].values.take(take) for c in names]
                        y = block.y[rows].astype(np.float64)
                        out = [
                            pa.array(np.full(n, cell), pa.int32()), pa.array([reps[at]] * n, pa.int32() if rep_type == "int" else pa.string()),
                            pa.array(np.full(n, held), pa.int32()), *cols, pa.array(y, mask=y < 0), pa.array(p / spec.trees),
                        ]
                        fields = ["cell", "rep", "fold", *names, "label_d", "p"]
                        if explain:
                            flat = pa.array(why.ravel() / spec.trees)
                            out += [pa.array(np.full(n, base / spec.trees)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), flat)]
                            fields += ["base", "contributions"]
                        yield pa.RecordBatch.from_arrays(out, names=fields)

        out = data.blocks.mapInArrow(run, schema)
        renamed = {n: c for n, c in zip(names, [data.key, *data.keep], strict=True)}
        return out.select(*[F.col(c).alias(renamed.get(c, c)) for c in out.columns])

    def importances(self) -> list[tuple[int, str, float]]:
        """(cell, feature, mean share of the Gini decrease over the cell's trees)."""
        out = []
        gain = np.zeros((self.n_trees, len(self.names)))
        for level in self.levels:
            tree = np.repeat(np.arange(self.n_trees), np.diff(level.begin))
            split = level.feature >= 0
            np.add.at(gain, (tree[split], level.feature[split]), level.gain[split])
        total = gain.sum(axis=1, keepdims=True)
        share = np.divide(gain, total, out=np.zeros(gain.shape), where=total > 0).reshape(len(self.data.cells), self.spec.trees, -1).mean(axis=1)
        for c, (cell, _, _) in enumerate(self.data.cells):
            s = share[c] / share[c].sum() if share[c].sum() else share[c]
            out += [(cell, f, float(v)) for f, v in zip(self.names, s, strict=True)]
        return out

    def node_table(self) -> DataFrame:
        """cell, tree, depth, node, feature, threshold (a row goes left up to it), left, value, n of every node.
        The threshold of a flag or level is 0.5."""
        rows = []
        edges = [self.data.edges[c] for c in self.fs.numeric]
        for depth, level in enumerate(self.levels):
            tree = np.repeat(np.arange(self.n_trees), np.diff(level.begin))
            for k, t in enumerate(tree.tolist()):
                f = int(level.feature[k])
                cut = None if f < 0 else float(edges[f][level.cut[k]]) if f < len(edges) else 0.5
                left = int(level.left[k]) if f >= 0 else None
                rows.append((t // self.spec.trees, t % self.spec.trees, depth, k, self.names[f] if f >= 0 else None, cut, left, float(level.value[k]), int(level.count[k].sum())))
        return self.data.blocks.sparkSession.createDataFrame(rows, "cell int, tree int, depth int, node int, feature string, threshold double, left int, value double, n bigint")


_SPLIT = np.dtype([("feature", "<i4"), ("cut", "<i4"), ("gain", "<f8"), ("sides", "<i8", (2, 2))])
