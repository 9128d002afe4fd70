"""Cells (see ``cells``) over rows that are stored once.

A stacked table holds a row for every cell that reads it: 100 copies at 20 x 5 folds, read again by
every iteration of a fit. Here a row is packed once, with its fold of every repetition, into blocks
in the shared folder; what a cell needs besides (medians, modes, means, deviations, class weights)
is a row of parameters a cell, found from counts by repetition and fold less those held out:

* Medians are exact: counts by value range first (ranges from approximate quantiles, any ranges
  would do), then the values of the ranges that hold a cell's middle ranks.
* Imputed, standardised and one-hot features of a cell are a linear map of columns that all cells
  share (value or 0, missing flag, level, 1), so the margins of all cells are one matrix product.

A pass over the blocks sums arrays by cell; the driver holds those sums, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import prep as PR
from .ordering import running_sums

#: rows of a block, quantiles whose values bound the ranges of a median
BLOCK, RANGES = 1 << 13, 256
#: columns up to which second derivatives are summed
WIDEST = 160


def sum_by(blocks: DataFrame, run: Callable) -> dict[int, np.ndarray]:
    """Sum the arrays (no, data: doubles) that ``run`` gives for the blocks of a task, by no."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for no, blob in zip(b.column("no").to_pylist(), b.column("data"), strict=True):
                a = np.frombuffer(blob.as_buffer(), "<f8")
                total[no] = total[no] + a if no in total else a.copy()
        yield sums_batch(total)

    parts = blocks.mapInArrow(run, "no int, data binary").repartition(F.col("no")).mapInArrow(combine, "no int, data binary")
    return {r["no"]: np.frombuffer(r["data"], "<f8") for r in parts.collect()}  # a row a cell


def sums_batch(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([a.tobytes() for a in total.values()], pa.binary())], names=["no", "data"])


_BLOBS = ["y", "x", "gone", "levels", "folds", "chosen"]


class Rows:
    """A decoded block."""

    def __init__(self, row: dict, shape: tuple[int, int, int]):
        numeric, masks, categorical = shape
        self.y = np.frombuffer(row["y"], "<f8")
        n = len(self.y)
        self.x = np.frombuffer(row["x"], "<f8").reshape(n, numeric)
        self.gone = np.frombuffer(row["gone"], np.uint8).reshape(n, masks)
        self.levels = np.frombuffer(row["levels"], "<i4").reshape(n, categorical)
        self.folds = np.frombuffer(row["folds"], "<i4").reshape(n, -1)
        self.chosen = np.frombuffer(row["chosen"], np.uint8).reshape(n, -1)
        self.labelled = ~np.isnan(self.y)


@dataclass
class PackedCells:
    """Blocks of rows and the parameters of every cell. ``listed``: (cell, place of its repetition,
    held-out fold); ``masks``: columns whose absence is stored."""

    blocks: DataFrame
    key: str
    keep: list[str]
    types: list[str]
    numeric: list[str]
    masks: list[str]
    categorical: list[str]
    levels: dict[str, int]
    reps: list
    listed: list[tuple]
    medians: np.ndarray
    modes: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    classes: np.ndarray
    size: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    #: whether a row says by itself which cells it trains (``chosen``), with weight 1
    chosen: bool = False

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.numeric), len(self.masks), len(self.categorical)

    @property
    def cells(self) -> list[tuple]:
        """(cell, rep, fold)."""
        return [(c, self.reps[at], held) for c, at, held in self.listed]

    def test(self) -> None:
        """Packed models score what each cell held out by themselves."""

    def sizes(self) -> DataFrame:
        """(cell, n): training rows of each cell."""
        return self.blocks.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(self.size)], "cell int, n bigint")  # a row a cell

    def class_weights(self) -> np.ndarray:
        """Balanced weights n / (classes * n of the class), a row a cell."""
        n, k = self.classes.sum(axis=1, keepdims=True), (self.classes > 0).sum(axis=1, keepdims=True)
        return np.divide(n, k * self.classes, out=np.zeros(self.classes.shape), where=self.classes > 0)

    @property
    def decoded(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Rows]]:
        """A function of the batches of a task."""
        shape = self.shape

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
            for b in batches:
                for row in b.select(_BLOBS).to_pylist():
                    yield Rows(row, shape)

        return rows


def pack_cells(
    df: DataFrame, folds: DataFrame, group: str, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
    missing_flags: Sequence[str] = (), keep: Sequence[str] = (), test_folds: Sequence[int] | None = None, chosen: str | None = None,
) -> PackedCells:
    """Pack ``df``. ``folds`` is (rep, group, fold) with integer folds, every group in every repetition.
    Rows without a label are scored, but train nothing. ``chosen`` names a column with the places of cells
    that a row trains in a fit of chosen rows (``dataclasses.replace(packed, chosen=True)``)."""
    from .cells import level_index
    from .forest import fold_arrays

    spark = df.sparkSession
    numeric, categorical = list(numeric), list(categorical)
    masks = list(dict.fromkeys([*numeric, *missing_flags]))
    per_group, reps = fold_arrays(folds, group)
    rows = df.join(per_group, group).withColumn("_y", F.col(label).cast("double"))
    levels = {}
    for c in categorical:
        index = cut_lineage(level_index(df, c))
        levels[c] = index.count()
        rows = rows.join(index, c, "left").withColumn(f"{c}_ix", F.coalesce(F.col(f"{c}_ix"), F.lit(-1)))
    rows = cut_lineage(rows.hint("rebalance"))
    pairs = [(r[0], r[1]) for r in folds.select("rep", F.col("fold").cast("int")).distinct().orderBy("rep", "fold").collect()]
    fold_values = np.array(sorted({f for _, f in pairs}), np.int32)
    listed = [(i, reps.index(rep), fold) for i, (rep, fold) in enumerate(p for p in pairs if test_folds is None or p[1] in set(test_folds))]
    centre, scale, edges = _ranges(rows, numeric)
    blocks = _blocks(rows, key, keep, numeric, masks, categorical, chosen, len(listed))
    types = dict(rows.dtypes)
    out = PackedCells(
        blocks, key, list(keep), [types[key], *[types[c] for c in keep]], numeric, masks, categorical, levels, reps, listed,
        *[np.zeros(0)] * 6, centre, scale,
    )
    _parameters(out, rows, spark, fold_values, edges)
    return out


def _ranges(rows: DataFrame, numeric: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Mean and deviation of each column, and thresholds: approximate quantiles, each with the number
    before it, so that a frequent value has a range of its own."""
    if not numeric:
        return np.zeros(0), np.ones(0), []
    aggs = []
    for i, c in enumerate(numeric):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.percentile_approx(v, [j / RANGES for j in range(RANGES + 1)], 10_000).alias(f"q{i}")]
    one = rows.agg(*aggs).first()
    at = [np.unique([float(v) for v in one[f"q{i}"] or []]) for i in range(len(numeric))]
    edges = [np.unique(np.concatenate([v, np.nextafter(v, -np.inf)])) for v in at]
    return np.array([one[f"m{i}"] or 0.0 for i in range(len(numeric))]), np.array([one[f"s{i}"] or 1.0 for i in range(len(numeric))]), edges


def _blocks(rows: DataFrame, key: str, keep: Sequence[str], numeric: list[str], masks: list[str], categorical: list[str], chosen: str | None, n_cells: int) -> DataFrame:
    types = dict(rows.dtypes)
    picked = F.lit(None).cast("array<int>") if chosen is None else F.col(chosen).cast("array<int>")
    base = rows.select(
        F.col(key).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.col("_y").alias("y"), "folds", picked.alias("chosen"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(numeric)],
        *[F.col(c).isNull().alias(f"g_{i}") for i, c in enumerate(masks)], *[F.col(f"{c}_ix").alias(f"c_{i}") for i, c in enumerate(categorical)],
    )
    names = ["key", *[f"keep_{c}" for c in keep]]
    schema = ", ".join(f"`{n}` array<{types[c]}>" for n, c in zip(names, [key, *keep], strict=True))
    schema += ", y binary, folds binary, x binary, gone binary, levels binary, chosen binary"
    n_num, n_mask, n_cat, most = len(numeric), len(masks), len(categorical), BLOCK

    def columns(t: pa.Table, prefix: str, k: int, kind: str) -> np.ndarray:
        out = np.zeros((t.num_rows, k), kind)
        for i in range(k):
            out[:, i] = t.column(f"{prefix}_{i}").to_numpy()
        return out

    def block(t: pa.Table) -> pa.RecordBatch:
        folds = t.column("folds").combine_chunks().flatten().to_numpy().astype("<i4")
        blobs = [t.column("y").to_numpy().astype("<f8"), folds, columns(t, "x", n_num, "<f8"), columns(t, "g", n_mask, "u1"), columns(t, "c", n_cat, "<i4")]
        picked = np.zeros((t.num_rows, n_cells if chosen else 0), np.uint8)
        if chosen:
            lists = t.column("chosen").combine_chunks()
            picked[np.asarray(lists.value_parent_indices()), lists.flatten().to_numpy()] = 1
        blobs.append(picked)
        at = pa.array([0, t.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(at, t.column(c).combine_chunks()) for c in names]
        return pa.RecordBatch.from_arrays(lists + [pa.array([z.tobytes()], pa.binary()) for z in blobs], names=[*names, "y", "folds", "x", "gone", "levels", "chosen"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            k = 0
            while k < b.num_rows:
                held.append(b.slice(k, most - size))
                k += held[-1].num_rows
                size += held[-1].num_rows
                if size >= most:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield block(pa.Table.from_batches(held))

    blocks = cut_lineage(base.mapInArrow(pack, schema))
    n = blocks.count()
    # every task gets a few blocks: as many tasks as the cores take twice, more of a larger table
    parts = max(1, min(n, max(2 * rows.sparkSession.sparkContext.defaultParallelism, n // 64)))
    return cut_lineage(blocks.repartition(parts))


def _parameters(p: PackedCells, rows: DataFrame, spark, fold_values: np.ndarray, edges: list[np.ndarray]) -> None:
    n_num, n_fold = len(p.numeric), len(fold_values)
    widths = [len(e) + 1 for e in edges]
    sizes = [p.levels[c] for c in p.categorical]
    centre, scale, decoded = p.centre, p.scale, p.decoded
    n_reps = len(p.reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in decoded(batches):
            use = b.labelled
            y = b.y[use]
            ix = [np.searchsorted(e, b.x[use, j]) for j, e in enumerate(edges)]
            here = [b.gone[use, j] == 0 for j in range(n_num)]
            v = [(b.x[use, j] - centre[j]) / scale[j] for j in range(n_num)]
            for at in range(n_reps):
                f_all = np.searchsorted(fold_values, b.folds[:, at])
                f = f_all[use]
                out = [np.bincount(f_all, minlength=n_fold), np.bincount(f[y == 0], minlength=n_fold), np.bincount(f[y == 1], minlength=n_fold)]
                for j in range(n_num):
                    g = f[here[j]]
                    w = v[j][here[j]]
                    out += [np.bincount(g, w, n_fold), np.bincount(g, w * w, n_fold)]
                for i, k in enumerate(sizes):
                    lv = b.levels[use, i]
                    out.append(np.bincount(f[lv >= 0] * k + lv[lv >= 0], minlength=n_fold * k))
                for j in range(n_num):
                    out.append(np.bincount(f[here[j]] * widths[j] + ix[j][here[j]], minlength=n_fold * widths[j]))
                flat = np.concatenate(out).astype("<f8")
                total[at] = total[at] + flat if at in total else flat
        yield sums_batch(total)

    sums = sum_by(p.blocks, run)
    c = len(p.listed)
    p.classes, p.size = np.zeros((c, 2)), np.zeros(c)
    p.medians, p.mean, p.sd = (np.full((c, n_num), np.nan) for _ in range(3))
    p.modes = np.full((c, len(sizes)), -1, np.int64)
    targets, moments = [], np.zeros((c, n_num, 3))
    for no, at, held in p.listed:
        if at not in sums:
            continue
        flat, k, pos = sums[at], int(np.searchsorted(fold_values, held)), 0

        def less_held(width: int) -> np.ndarray:
            """Sum over the other folds of the next ``n_fold`` rows of ``width`` numbers."""
            nonlocal pos
            part = flat[pos : pos + n_fold * width].reshape(n_fold, width)
            pos += n_fold * width
            return np.delete(part, k, axis=0).sum(axis=0)

        p.size[no] = less_held(1)[0]
        p.classes[no] = [less_held(1)[0], less_held(1)[0]]
        for j in range(n_num):
            moments[no, j, 1:] = [less_held(1)[0], less_held(1)[0]]
        for i, width in enumerate(sizes):
            count = less_held(width)
            if count.any():
                p.modes[no, i] = int(count.argmax())  # the smallest on ties
        for j in range(n_num):
            upto = np.cumsum(less_held(widths[j]))
            n = moments[no, j, 0] = upto[-1]
            if not n:
                continue
            ranks = [int((n - 1) // 2) + 1, int(-(-(n - 1) // 2)) + 1]
            bins = [int(np.searchsorted(upto, r)) for r in ranks]
            e = edges[j]
            if all(0 < b < len(e) and e[b - 1] == np.nextafter(e[b], -np.inf) for b in bins):
                p.medians[no, j] = (e[bins[0]] + e[bins[1]]) / 2
                continue
            a, z = bins
            targets.append((no, at, int(held), p.numeric[j], float(e[a - 1]) if a else -np.inf, float(e[z]) if z < len(e) else np.inf, int(upto[a - 1]) if a else 0, *ranks))
    for r in _middles(rows, targets, spark):
        p.medians[r["cell"], p.numeric.index(r["_col"])] = (r["low"] + r["high"]) / 2
    n = p.classes.sum(axis=1)
    for j in range(n_num):
        med = (p.medians[:, j] - centre[j]) / scale[j]
        count, s, ss = moments[:, j].T
        gone = n - count
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (s + gone * np.where(gone > 0, med, 0.0)) / n
            square = (ss + gone * np.where(gone > 0, med, 0.0) ** 2) / n
        var = square - mean**2
        sd = np.sqrt(np.where(var > 1e-12 * square, var, 1.0 / scale[j] ** 2))  # constant columns are only centred
        p.mean[:, j], p.sd[:, j] = centre[j] + scale[j] * mean, scale[j] * sd


def _middles(rows: DataFrame, targets: list[tuple], spark) -> list:
    """(cell, _col, low, high): the values of two ranks of a cell's training rows, for each target
    (cell, place of its repetition, held-out fold, column, range of values that holds them, rows before it, ranks)."""
    if not targets:
        return []
    table = spark.createDataFrame(targets, "cell int, _at int, _held int, _col string, _from double, _to double, _off bigint, _lo bigint, _hi bigint")
    cols = sorted({t[3] for t in targets})
    near = None
    for c in cols:
        mine = [t for t in targets if t[3] == c]
        v = F.col(c).cast("double")
        part = rows.where(F.col("_y").isNotNull() & (v > min(t[4] for t in mine)) & (v <= max(t[5] for t in mine)))
        part = part.groupBy("folds", F.lit(c).alias("_col"), v.alias("_val")).agg(F.count("*").alias("_n"))
        near = part if near is None else near.unionByName(part)
    met = near.join(F.broadcast(table), "_col").where("folds[_at] <> _held AND _val > _from AND _val <= _to")
    counts = met.groupBy("cell", "_col", "_val", "_off", "_lo", "_hi").agg(F.sum("_n").alias("_k"))
    ranked = running_sums(counts, ["cell", "_col"], ["_val"], {"_upto": F.col("_k")}).withColumn("_upto", F.col("_upto") + F.col("_off"))

    def at(rank: str):
        return F.max(F.when((F.col("_upto") - F.col("_k") < F.col(rank)) & (F.col(rank) <= F.col("_upto")), F.col("_val")))

    return ranked.groupBy("cell", "_col").agg(at("_lo").alias("low"), at("_hi").alias("high")).collect()  # a row a cell and column


# ---------------------------------------------------------------- features


class Design:
    """Features of a set for all cells: ``shared(block)`` are columns that no cell changes, ``maps[cell]``
    takes them to the cell's prepared features and a last 1; ``prepared(block, rows, cell)`` makes those
    features one by one instead, without the 1."""

    def __init__(self, p: PackedCells, fs):
        self.numeric = [p.numeric.index(c) for c in fs.numeric]
        self.flags = [p.masks.index(c) for c in fs.missing_flags]
        self.masks = list(dict.fromkeys([*[p.masks.index(c) for c in fs.numeric], *self.flags]))
        self.hot = [(p.categorical.index(c), p.levels[c]) for c in fs.categorical]
        self.names = [*fs.numeric, *[f"{c}_missing" for c in fs.missing_flags], *[f"{c}_{i}" for c in fs.categorical for i in range(p.levels[c])]]
        self.width = len(self.names) + 1
        self.columns = len(self.numeric) + len(self.masks) + sum(k + 1 for _, k in self.hot) + 1
        self.centre, self.scale, self.medians, self.modes, self.mean, self.sd = p.centre, p.scale, p.medians, p.modes, p.mean, p.sd
        self.own = [p.masks.index(c) for c in fs.numeric]
        self.maps = np.stack([self._map(c) for c, _, _ in p.listed]) if p.listed else np.zeros((0, self.columns, self.width))

    def _map(self, c: int) -> np.ndarray:
        t = np.zeros((self.columns, self.width))
        first = len(self.numeric)
        for i, (j, m) in enumerate(zip(self.numeric, self.own, strict=True)):
            if np.isnan(self.medians[c, j]):
                continue  # no training value: nothing to learn from
            # (value or centre, less the centre) / scale; where missing, the median in its place
            t[i, i] = self.scale[j] / self.sd[c, j]
            t[first + self.masks.index(m), i] = (self.medians[c, j] - self.centre[j]) / self.sd[c, j]
            t[-1, i] = (self.centre[j] - self.mean[c, j]) / self.sd[c, j]
        for i, m in enumerate(self.flags):
            t[first + self.masks.index(m), first + i] = 1.0
        row, col = first + len(self.masks), first + len(self.flags)
        for i, k in self.hot:
            t[row : row + k, col : col + k] = np.eye(k)
            if self.modes[c, i] >= 0:
                t[row + k, col + self.modes[c, i]] = 1.0
            row, col = row + k + 1, col + k
        t[-1, -1] = 1.0
        return t

    def shared(self, b: Rows) -> np.ndarray:
        n = len(b.y)
        x = (b.x[:, self.numeric] - self.centre[self.numeric]) / self.scale[self.numeric]
        x[b.gone[:, self.own] > 0] = 0.0
        hot = []
        for i, k in self.hot:
            lv = np.where(b.levels[:, i] < 0, k, b.levels[:, i])
            hot.append(lv[:, None] == np.arange(k + 1))
        return np.concatenate([x, b.gone[:, self.masks], *hot, np.ones((n, 1))], axis=1)

    def prepared(self, b: Rows, rows: np.ndarray, c: int) -> np.ndarray:
        x, gone = b.x[rows], b.gone[rows]
        out = np.zeros((len(rows), self.width - 1))
        for i, (j, m) in enumerate(zip(self.numeric, self.own, strict=True)):
            if not np.isnan(self.medians[c, j]):
                out[:, i] = (np.where(gone[:, m] > 0, self.medians[c, j], x[:, j]) - self.mean[c, j]) / self.sd[c, j]
        out[:, len(self.numeric) : len(self.numeric) + len(self.flags)] = gone[:, self.flags]
        col = len(self.numeric) + len(self.flags)
        for i, k in self.hot:
            lv = b.levels[rows, i].astype(np.int64)
            lv = np.where(lv < 0, self.modes[c, i], lv)
            ok = np.flatnonzero(lv >= 0)
            out[ok, col + lv[ok]] = 1.0
            col += k
        return out


def training(b: Rows, at: int, held: int) -> np.ndarray:
    return np.flatnonzero(b.labelled & (b.folds[:, at] != held))


def pieces(rows: np.ndarray, most: int = 1024) -> Iterator[np.ndarray]:
    """Rows whose features stay in a core's cache."""
    for k in range(0, len(rows), most):
        yield rows[k : k + most]


def scored(p: PackedCells, score: Callable, more: str = "") -> DataFrame:
    """cell, rep, fold, key, carried columns, label_d and what ``score(block)`` gives, every row once by
    each cell that held it out. ``score(block)`` is called once a block and gives a function of (cell,
    rows) that returns columns by name; ``more`` is their schema."""
    names = ["key", *[f"keep_{c}" for c in p.keep]]
    rep_type = "int" if all(isinstance(r, int) for r in p.reps) else "string"
    schema = f"cell int, rep {rep_type}, fold int, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, p.types, strict=True)) + ", label_d double, " + more
    reps, shape = p.reps, p.shape
    trained = p.classes.sum(axis=1) > 0
    listed = [t for t in p.listed if trained[t[0]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Rows({c: batch.column(c)[i].as_py() for c in _BLOBS}, shape)
                of = score(b)
                for cell, at, held in listed:
                    rows = np.flatnonzero(b.folds[:, at] == held)
                    if not len(rows):
                        continue
                    n, take = len(rows), pa.array(rows)
                    y = b.y[rows]
                    cols = of(cell, rows)
                    out = [
                        pa.array(np.full(n, cell), pa.int32()), pa.array([reps[at]] * n, pa.int32() if rep_type == "int" else pa.string()),
                        pa.array(np.full(n, held), pa.int32()), *[batch.column(c)[i].values.take(take) for c in names],
                        pa.array(y, mask=np.isnan(y)), *[pa.array(v) for v in cols.values()],
                    ]
                    yield pa.RecordBatch.from_arrays(out, names=["cell", "rep", "fold", *names, "label_d", *cols])

    out = p.blocks.mapInArrow(run, schema)
    renamed = dict(zip(names, [p.key, *p.keep], strict=True))
    return out.select(*[F.col(c).alias(renamed.get(c, c)) for c in out.columns])


# ---------------------------------------------------------------- logistic regression


def sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1.0, e) / (1.0 + e)


def newton(sums: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray, np.ndarray]]], start: dict[int, np.ndarray], ridge: np.ndarray, most: int = 60) -> dict[int, np.ndarray]:
    """Least points of several objectives 1/2 ridge * b**2 + loss(b), by Newton steps, halved where an
    objective grew. ``sums`` gives (loss, gradient, second derivatives) of the listed points."""
    best = {c: b.copy() for c, b in start.items()}
    value = dict.fromkeys(start, np.inf)
    step: dict[int, np.ndarray] = {}
    going = dict(best)
    for _ in range(most):
        found = sums(going)
        following = {}
        for c, b in going.items():
            loss, g, h = found[c]
            f = loss + 0.5 * float(ridge @ (b * b))
            if f > value[c] + 1e-9 * abs(value[c]):
                step[c] = step[c] / 2
                if np.abs(step[c]).max() > 1e-9:
                    following[c] = best[c] + step[c]
                continue
            best[c], value[c] = b, f
            g = g + ridge * b
            step[c] = -np.linalg.lstsq(h + np.diag(ridge), g, rcond=1e-15)[0]
            following[c] = b + step[c]
            if -float(g @ step[c]) <= 1e-8:  # the step after this one would not be seen
                best[c] = following.pop(c)
        going = following
        if not going:
            return best
    raise RuntimeError(f"no minimum after {most} Newton steps for cells {sorted(going)}")


class PackedLogistic:
    """The logistic regression of every cell (penalty 1/2 ``ridge`` * b**2, the last for the intercept)."""

    def __init__(self, p: PackedCells, fs, ridge: float):
        self.p, self.design = p, Design(p, fs)
        d, width = self.design, self.design.width
        self.ridge = np.append(np.ones(width - 1), ridge)
        trained = p.classes.sum(axis=1) > 0
        start = {c: np.zeros(width) for c, _, _ in p.listed if trained[c]}
        at = np.triu_indices(d.columns)

        def sums(points: dict[int, np.ndarray]) -> dict[int, tuple]:
            found = self._pass(points, at)
            out = {}
            for c in points:
                a = found[c]
                h = np.zeros((d.columns, d.columns))
                h[at] = a[1 + d.columns :]
                h = h + np.triu(h, 1).T
                t = d.maps[c]
                out[c] = a[0], t.T @ a[1 : 1 + d.columns], t.T @ h @ t
            return out

        self.coef = newton(sums, start, self.ridge)

    def _pass(self, points: dict[int, np.ndarray], at: tuple) -> dict[int, np.ndarray]:
        d, decoded = self.design, self.p.decoded
        cells = sorted(points)
        by = np.stack([d.maps[c] @ points[c] for c in cells], axis=1)
        listed = {c: (a, h) for c, a, h in self.p.listed}
        places = np.array([listed[c][0] for c in cells])
        held = np.array([listed[c][1] for c in cells], np.int32)
        weights, chosen = self.p.class_weights()[cells], self.p.chosen
        few = max(1, 2_000_000 // (len(at[0]) + 4 * len(cells)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, g, h = np.zeros(len(cells)), np.zeros((d.columns, len(cells))), np.zeros((len(at[0]), len(cells)))
            for b in decoded(batches):
                for k in range(0, len(b.y), few):
                    use = k + np.flatnonzero(b.labelled[k : k + few])
                    if not len(use):
                        continue
                    u, y = d.shared(_taken(b, use)), b.y[use]
                    if chosen:
                        w = b.chosen[use][:, cells].astype(float)
                    else:
                        w = np.where(y[:, None] > 0, weights[:, 1], weights[:, 0])
                        w *= b.folds[use][:, places] != held
                    m = u @ by
                    e = np.exp(-np.abs(m))
                    s = np.where(m >= 0, 1.0, e) / (1.0 + e)
                    loss += (w * (np.maximum(m, 0.0) - y[:, None] * m + np.log1p(e))).sum(axis=0)
                    g += u.T @ (w * (s - y[:, None]))
                    w *= s
                    w *= 1.0 - s
                    h += (u[:, at[0]] * u[:, at[1]]).T @ w
            yield sums_batch({c: np.concatenate([[loss[i]], g[:, i], h[:, i]]) for i, c in enumerate(cells)})

        return sum_by(self.p.blocks, run)

    def predict(self) -> DataFrame:
        d = self.design
        by = np.zeros((d.columns, len(self.p.listed)))
        for c, b in self.coef.items():
            by[:, c] = d.maps[c] @ b

        def score(b: Rows):
            p = sigmoid(d.shared(b) @ by)
            return lambda cell, rows: {"p": p[rows, cell]}

        return scored(self.p, score, "p double")

    def gradients(self) -> list[tuple[int, str, float]]:
        """(cell, feature, gradient) of each cell's objective, from its features prepared one by one."""
        d, coef, decoded, listed, weights = self.design, self.coef, self.p.decoded, self.p.listed, self.p.class_weights()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {c: np.zeros(d.width) for c in coef}
            for b in decoded(batches):
                for c, at, held in listed:
                    rows = training(b, at, held)
                    if c not in coef or not len(rows):
                        continue
                    x, y = d.prepared(b, rows, c), b.y[rows]
                    r = np.where(y > 0, weights[c, 1], weights[c, 0]) * (sigmoid(x @ coef[c][:-1] + coef[c][-1]) - y)
                    total[c] += np.append(r @ x, r.sum())
            yield sums_batch(total)

        names = [*d.names, "(intercept)"]
        free = np.append(np.ones(d.width - 1), 0.0)
        return [(c, n, float(v)) for c, g in sum_by(self.p.blocks, run).items() for n, v in zip(names, g + free * coef[c], strict=True)]


def _taken(b: Rows, rows: np.ndarray) -> Rows:
    out = object.__new__(Rows)
    for k, v in b.__dict__.items():
        setattr(out, k, v[rows])
    return out


# ---------------------------------------------------------------- SVM on random features

#: half widths of the rounded corner of the hinge loss, one after another, and steps tried
CORNERS, STEPS = (1.0, 0.3, 0.1, 0.03, 0.01), 0.5 ** np.arange(8)


class PackedSvm:
    """The linear SVM of every cell on random Fourier features of its prepared rows (penalty 1/2 b**2 on
    all), by Newton steps on a hinge loss whose corner is rounded ever less, then Platt scaling. The
    rounded loss lies within corner / 4 of the hinge, and only for rows that near to the margin."""

    def __init__(self, p: PackedCells, fs, w: np.ndarray, b: np.ndarray):
        self.p, self.design, self.w, self.b = p, Design(p, fs), w, b
        self.trained = [t for t in p.listed if p.classes[t[0]].sum() > 0]
        self.gamma = self._gamma()
        width = len(b) + 1
        self.coef = {c: np.zeros(width) for c, _, _ in self.trained}
        self.value: dict[int, float] = {}
        for corner in CORNERS:
            self._fit(corner, 1e-5 if corner == CORNERS[-1] else 1e-3)
        self.platt = newton(self._platt_sums, {c: np.zeros(2) for c in self.coef}, np.zeros(2), 200)

    def _gamma(self) -> dict[int, float]:
        d, decoded, listed, k = self.design, self.p.decoded, self.trained, self.design.width - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {c: np.zeros(3) for c, _, _ in listed}
            for b in decoded(batches):
                for c, at, held in listed:
                    x = d.prepared(b, np.flatnonzero(b.folds[:, at] != held), c)
                    total[c] += [x.size, x.sum(), (x * x).sum()]
            yield sums_batch(total)

        return {c: 1.0 / (k * ((ss / n - (s / n) ** 2 if n else 0.0) or 1.0)) for c, (n, s, ss) in sum_by(self.p.blocks, run).items()}

    def _mapper(self) -> Callable[[Rows, np.ndarray, int], np.ndarray]:
        d, w, b, gamma = self.design, self.w.T.copy(), self.b, self.gamma
        scale = (2.0 / len(b)) ** 0.5

        def mapped(block: Rows, rows: np.ndarray, c: int) -> np.ndarray:
            z = np.empty((len(rows), len(b) + 1))
            np.matmul(d.prepared(block, rows, c) * np.sqrt(2 * gamma[c]), w, out=z[:, :-1])
            z[:, :-1] += b
            np.cos(z[:, :-1], out=z[:, :-1])
            z[:, :-1] *= scale
            z[:, -1] = 1.0  # the last one is the intercept
            return z

        return mapped

    def _pass(self, points: dict[int, tuple[np.ndarray, np.ndarray]], corner: float) -> dict[int, tuple]:
        """Of each (point, step): losses after parts of the step, gradient and second derivatives after the whole."""
        mapped, decoded, weights = self._mapper(), self.p.decoded, self.p.class_weights()
        listed = [t for t in self.trained if t[0] in points]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(next(iter(points.values()))[0])
            total = {c: [np.zeros(len(STEPS)), np.zeros(k), np.zeros((k, k))] for c, _, _ in listed}
            for b in decoded(batches):
                for c, at, held in listed:
                    for rows in pieces(training(b, at, held)):
                        z, y = mapped(b, rows, c), b.y[rows]
                        side, w = np.where(y > 0, 1.0, -1.0), np.where(y > 0, weights[c, 1], weights[c, 0])
                        old, move = z @ points[c][0], z @ points[c][1]
                        for i, part in enumerate(STEPS):
                            short = 1.0 - side * (old + part * move)
                            total[c][0][i] += w @ np.where(short > corner, short, np.clip(short + corner, 0.0, None) ** 2 / (4 * corner))
                        short = 1.0 - side * (old + move)
                        total[c][1] -= (w * side * np.clip((short + corner) / (2 * corner), 0.0, 1.0)) @ z
                        near = np.flatnonzero(np.abs(short) < corner)
                        zn = z[near]
                        total[c][2] += (zn * (w[near] / (2 * corner))[:, None]).T @ zn
            yield sums_batch({c: np.concatenate([v.ravel() for v in t]) for c, t in total.items()})

        out = {}
        for c, a in sum_by(self.p.blocks, run).items():
            k = len(points[c][0])
            out[c] = a[: len(STEPS)], a[len(STEPS) : len(STEPS) + k], a[len(STEPS) + k :].reshape(k, k)
        return out

    def _fit(self, corner: float, tol: float, most: int = 60) -> None:
        """Until a step gains, or would gain, less than ``tol`` of the objective (as ``LinearSVC`` stops)."""
        going, before = {c: (b, np.zeros(len(b))) for c, b in self.coef.items()}, dict.fromkeys(self.coef, np.inf)
        for _ in range(most):
            found, following = self._pass(going, corner), {}
            for c, (b, move) in going.items():
                losses, g, h = found[c]
                values = np.array([f + 0.5 * float((b + s * move) @ (b + s * move)) for f, s in zip(losses, STEPS, strict=True)])
                i = int(values.argmin())
                if i:  # a part of the step is better: go there first
                    following[c] = b + STEPS[i] * move, np.zeros(len(b))
                    continue
                b = self.coef[c] = b + move
                self.value[c] = float(values[0])
                g = g + b
                move = -np.linalg.solve(h + np.eye(len(b)), g)
                if min(-float(g @ move), before[c] - self.value[c]) > tol * self.value[c]:
                    following[c] = b, move
                before[c] = self.value[c]
            going = following
            if not going:
                return

    def _platt_sums(self, points: dict[int, np.ndarray]) -> dict[int, tuple]:
        mapped, decoded, coef = self._mapper(), self.p.decoded, self.coef
        listed = [t for t in self.trained if t[0] in points]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {c: np.zeros(6) for c, _, _ in listed}
            for b in decoded(batches):
                for c, at, held in listed:
                    rows = training(b, at, held)
                    if not len(rows):
                        continue
                    m, y = np.concatenate([mapped(b, some, c) @ coef[c] for some in pieces(rows)]), b.y[rows]
                    t = points[c][0] * m + points[c][1]
                    s = sigmoid(t)
                    v = s * (1 - s)
                    total[c] += [(np.maximum(t, 0.0) - y * t + np.log1p(np.exp(-np.abs(t)))).sum(), (s - y) @ m, (s - y).sum(), v @ (m * m), v @ m, v.sum()]
            yield sums_batch(total)

        return {c: (a[0], a[1:3], np.array([[a[3], a[4]], [a[4], a[5]]])) for c, a in sum_by(self.p.blocks, run).items()}

    def predict(self) -> DataFrame:
        mapped, coef, platt = self._mapper(), self.coef, self.platt

        def score(b: Rows):
            def of(cell: int, rows: np.ndarray) -> dict:
                m = np.concatenate([mapped(b, some, cell) @ coef[cell] for some in pieces(rows)])
                return {"p": sigmoid(platt[cell][0] * m + platt[cell][1]), "class": (m >= 0).astype(np.int32)}

            return of

        return scored(self.p, score, "p double, class int")
