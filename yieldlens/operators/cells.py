"""Many fits at once: every cell (repetition, held-out fold) of a protocol in one table.

A cell is trained on the rows of its repetition that lie in other folds and scores the rows
of its fold; ``assigned`` rows carry (rep, fold). The same shape holds grouped k-fold (20 x 5
cells), seeded single splits (one cell a seed: fold 1 against fold 0) and leaving one stratum
out (fold = stratum).

* Preparation: medians, modes, means, deviations and class weights of all cells come from
  grouped aggregates over the stacked training rows, one row of parameters a cell. A level's
  one-hot place is the same in every cell; a level without training rows in a cell has a zero
  column there, which neither the penalised logistic fit nor a tree uses, so unseen levels
  count as none.
* Logistic regression: the cells' feature vectors are put into one block-diagonal vector
  (``Interaction`` of the one-hot cell and the features) and fitted by one
  ``LogisticRegression``. The objective separates by cell; with regParam = 1 / sum of all
  weights each cell has the penalty of its own fit with C = 1. A constant column of height
  ``INTERCEPT`` in each block is the cell's intercept, its penalty 1 / INTERCEPT**2 of the
  others'.
* ``BlockSvm``: a linear SVM on random Fourier features of each cell, stacked in the same way.
* ``fit_each``: other learners, a fit a cell from one prepared table, by a small pool of driver
  threads; each fit over partitions that Spark sizes by bytes.

Nothing per row passes through the driver: it sees the list of cells, the levels' number and
the fitted models.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from . import prep as PR
from .ordering import sequence_number
from .packed import WIDEST, PackedCells, PackedLogistic, PackedSvm

#: height of the constant column that serves as a block's intercept
INTERCEPT = 32.0
#: rows of a file of one cell
SLICE = 200_000


@dataclass(frozen=True)
class FeatureSet:
    """Inputs of one model: numeric columns (imputed, standardised), columns whose absence is
    flagged, and categorical columns (one-hot)."""

    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    missing_flags: Sequence[str] = ()


@dataclass
class Cells:
    """Prepared rows of all cells.

    ``rows``: cell, rep, fold, is_test, label_d, weight, key, carried columns, z-scored numeric
    columns, ``<c>_missing`` flags and ``<c>_ix`` places of the levels (-1: none). ``cells``:
    (cell, rep, fold) in order; ``levels``: number of levels a categorical column has.
    """

    rows: DataFrame
    cells: list[tuple]
    levels: dict[str, int]
    key: str = "key"
    keep: list[str] = field(default_factory=list)

    def train(self) -> DataFrame:
        return self.rows.where("is_test = 0")

    def test(self) -> DataFrame:
        return self.rows.where("is_test = 1")

    def sizes(self) -> DataFrame:
        """(cell, n): training rows of each cell."""
        return self.train().groupBy("cell").agg(F.count("*").alias("n"))


def level_index(df: DataFrame, col: str) -> DataFrame:
    """(col, <col>_ix): each non-NULL level and its place from 0 in sorted order."""
    levels = df.where(F.col(col).isNotNull()).select(col).distinct()
    return sequence_number(levels, [], [col], "_n").select(col, (F.col("_n") - 1).cast("int").alias(f"{col}_ix"))


def cell_table(folds: DataFrame, test_folds: Sequence | None = None) -> tuple[DataFrame, list[tuple]]:
    """(cell, rep, _held) of every (rep, fold) of ``folds``, or of those folds that are listed."""
    pairs = [(r[0], r[1]) for r in folds.select("rep", "fold").distinct().orderBy("rep", "fold").collect()]
    if test_folds is not None:
        pairs = [p for p in pairs if p[1] in set(test_folds)]
    cells = [(i, rep, fold) for i, (rep, fold) in enumerate(pairs)]
    types = dict(folds.dtypes)
    spark = folds.sparkSession
    return spark.createDataFrame(cells, f"cell int, rep {types['rep']}, _held {types['fold']}"), cells


def prepare_cells(
    assigned: DataFrame,
    key: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    missing_flags: Sequence[str] = (),
    keep: Sequence[str] = (),
    test_folds: Sequence | None = None,
    weight: str | None = None,
    soft: bool = False,
) -> Cells:
    """Prepare all cells of ``assigned`` (rows with rep and fold) with parameters of their own
    training rows. ``keep`` columns are carried as they are; ``weight`` (a column) multiplies
    the balanced class weights. Rows without a label are scored, but train nothing. With
    ``soft`` the label is a share in [0, 1]: a training row becomes one row a class with that
    share as a further weight, and counts in the class weights by it."""
    numeric, categorical = list(numeric), list(categorical)
    cells_df, cells = cell_table(assigned, test_folds)
    carried = {f"_keep_{c}": F.col(c) for c in keep}
    stack = assigned.withColumns({"label_d": F.col(label).cast("double"), **carried})
    if weight is not None:
        stack = stack.withColumn("_user", F.col(weight).cast("double"))
    stack = PR.missing_flags(stack, missing_flags)
    stack = stack.join(F.broadcast(cells_df), "rep")  # one row a cell
    stack = stack.withColumn("is_test", F.col("fold").eqNullSafe(F.col("_held")).cast("int"))
    training = (F.col("is_test") == 0) & F.col("label_d").isNotNull()
    by = ["cell"]
    out = PR.impute(stack, stack.where(training), numeric, categorical, by)
    out = PR.standardize(out, out.where(training), numeric, by)
    levels = {}
    for c in categorical:
        index = cut_lineage(level_index(assigned, c))
        levels[c] = index.count()
        out = out.join(index, c, "left").withColumn(f"{c}_ix", F.coalesce(F.col(f"{c}_ix"), F.lit(-1)))
    if soft:
        parts = PR.soft_rows(out.where(training), "label_d", "_mass")
        out = parts.unionByName(out.where(~F.coalesce(training, F.lit(False))).withColumn("_mass", F.lit(1.0)))
    else:
        out = out.withColumn("_mass", F.lit(1.0))
    training = training & F.col("label_d").isin(0.0, 1.0)
    out = PR.balanced_weights(out, out.where(training).select("cell", "label_d", "_mass"), "label_d", "weight", by, "_mass")
    out = out.withColumn("weight", F.col("weight") * F.col("_mass") * (F.col("_user") if weight is not None else F.lit(1.0)))
    cols = ["cell", "rep", "fold", "is_test", key, "label_d", "weight", *[F.col(f"_keep_{c}").alias(c) for c in keep]]
    cols += [*numeric, *[f"{c}_missing" for c in missing_flags], *[f"{c}_ix" for c in categorical]]
    return Cells(cut_lineage(out.select(*cols)), cells, levels, key, list(keep))


def features(cells: Cells, fs: FeatureSet, constant: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the vector ``features`` of the set (one-hot vectors are sparse, of any
    number of levels), with a last constant column if asked for."""
    ones = [c for c in fs.categorical if cells.levels[c]]
    plain = [*fs.numeric, *[f"{c}_missing" for c in fs.missing_flags]]
    encoders = []
    for c in ones:
        n = cells.levels[c]
        # the place n stands for no level and is dropped
        names = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(n + 1)], "name": f"{c}_at"}}
        at = F.when(F.col(f"{c}_ix") < 0, F.lit(n)).otherwise(F.col(f"{c}_ix")).cast("double").alias(f"{c}_at", metadata=names)
        encoders.append((at, OneHotEncoder(inputCol=f"{c}_at", outputCol=f"{c}_hot", dropLast=True)))
    inputs = plain + [f"{c}_hot" for c in ones]

    def add(df: DataFrame) -> DataFrame:
        if constant is not None:
            df = df.withColumn("_one", F.lit(float(constant)))
        for at, enc in encoders:
            df = df.select("*", at)
            df = enc.fit(df).transform(df)
        names = inputs + (["_one"] if constant is not None else [])
        out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)
        return out.drop("_one", *[f"{c}_at" for c in ones], *[f"{c}_hot" for c in ones])

    return add


def feature_names(cells: Cells, fs: FeatureSet) -> list[str]:
    """Names of the places of ``features``."""
    hot = [f"{c}_{i}" for c in fs.categorical for i in range(cells.levels[c])]
    return [*fs.numeric, *[f"{c}_missing" for c in fs.missing_flags], *hot]


def stacked(cells: Cells, df: DataFrame, vector: str, out: str = "block") -> DataFrame:
    """Adds ``out``: ``vector`` in the block of the row's cell, all other blocks empty."""
    n = len(cells.cells)
    names = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(n)], "name": "cell_at"}}
    df = df.select("*", F.col("cell").cast("double").alias("cell_at", metadata=names))
    df = OneHotEncoder(inputCol="cell_at", outputCol="cell_hot", dropLast=False).fit(df).transform(df)
    return Interaction(inputCols=["cell_hot", vector], outputCol=out).transform(df).drop("cell_at", "cell_hot")


def total_weight(cells: Cells) -> float:
    return cells.train().where("label_d IS NOT NULL").agg(F.sum("weight")).first()[0]


def narrow(levels: dict[str, int]) -> bool:
    """Whether the features of packed rows are few enough for second derivatives."""
    return sum(levels.values()) <= WIDEST


class BlockLogistic:
    """One logistic regression a cell (C = 1 on all but the intercept), fitted together: packed cells by
    Newton steps, a table of stacked rows by one ``LogisticRegression``."""

    def __init__(self, cells: Cells | PackedCells, fs: FeatureSet, tol: float = 1e-7, max_iter: int = 1000):
        self.cells, self.fs = cells, fs
        self.packed = PackedLogistic(cells, fs, INTERCEPT**-2) if isinstance(cells, PackedCells) else None
        if self.packed:
            return
        self.add = features(cells, fs, INTERCEPT)
        train = self._blocks(cells.train().where("label_d IS NOT NULL")).select("label_d", "weight", "block")
        self.model: LogisticRegressionModel = LogisticRegression(
            featuresCol="block", labelCol="label_d", weightCol="weight", maxIter=max_iter, tol=tol,
            regParam=1.0 / total_weight(cells), elasticNetParam=0.0, standardization=False, fitIntercept=False,
        ).fit(train)

    def _blocks(self, df: DataFrame) -> DataFrame:
        return stacked(self.cells, self.add(df), "features").drop("features")

    def predict(self, df: DataFrame | None = None) -> DataFrame:
        """``df`` (rows of the cells' table) with p; of packed cells the rows that each held out."""
        if self.packed:
            return self.packed.predict()
        out = self.model.transform(self._blocks(df)).withColumn("p", vector_to_array("probability")[1])
        return out.drop("block", "rawPrediction", "probability", "prediction")

    def coefficients(self) -> list[tuple[int, list[float], float]]:
        """(cell, coefficients, intercept), a row a cell."""
        if self.packed:
            return [(c, b[:-1].tolist(), float(b[-1])) for c, b in sorted(self.packed.coef.items())]
        flat = self.model.coefficients.toArray().tolist()
        width = len(flat) // len(self.cells.cells)
        return [(c, flat[i * width : (i + 1) * width - 1], INTERCEPT * flat[(i + 1) * width - 1]) for i, (c, _, _) in enumerate(self.cells.cells)]

    def gradients(self) -> DataFrame:
        """(cell, feature, gradient) of each cell's own objective (penalty and weighted loss) at its
        coefficients, over its training rows: near zero where the fit is a minimum."""
        if self.packed:
            return self.cells.blocks.sparkSession.createDataFrame(self.packed.gradients(), "cell int, feature string, gradient double")  # a row a cell and feature
        names = [*feature_names(self.cells, self.fs), "(intercept)"]
        spark = self.cells.rows.sparkSession
        coef = [(c, names[j], float(b), j) for c, w, b0 in self.coefficients() for j, b in enumerate([*w, b0])]
        coef = spark.createDataFrame(coef, "cell int, feature string, b double, j int")  # a row a cell and feature
        add = features(self.cells, self.fs, 1.0)
        rows = self.predict(self.cells.train().where("label_d IS NOT NULL"))
        x = F.posexplode(vector_to_array("features")).alias("j", "x")
        part = add(rows).select("cell", (F.col("weight") * (F.col("p") - F.col("label_d"))).alias("r"), x)
        sums = part.groupBy("cell", "j").agg(F.sum(F.col("r") * F.col("x")).alias("g"))
        penalty = F.when(F.col("feature") == "(intercept)", 0.0).otherwise(F.col("b"))
        return sums.join(F.broadcast(coef), ["cell", "j"]).select("cell", "feature", (F.col("g") + penalty).alias("gradient"))


class BlockSvm:
    """One approximate RBF SVM a cell, fitted together: random Fourier features
    z(x) = sqrt(2/D) cos(sqrt(2 g) W x + b) with W standard normal and g = 1 / (d var) of the
    cell's training inputs, a linear SVM (C = 1) on them, Platt scaling of its margin on the
    training rows. The class is the side of the margin, as with a kernel SVM. Packed cells are
    fitted by ``PackedSvm``, a table of stacked rows by one ``LinearSVC``."""

    def __init__(self, cells: Cells | PackedCells, fs: FeatureSet, dim: int = 200, seed: int = 42):
        self.cells, self.dim, self.packed = cells, dim, None
        if isinstance(cells, PackedCells):
            rng = np.random.default_rng(seed)
            d = len(feature_names(cells, fs))
            self.packed = PackedSvm(cells, fs, rng.normal(size=(dim, d)), rng.uniform(0.0, 2 * np.pi, size=dim))
            return
        self.add = features(cells, fs)
        rng = np.random.default_rng(seed)
        d = len(feature_names(cells, fs))
        self.w, self.b = rng.normal(size=(dim, d)), rng.uniform(0.0, 2 * np.pi, size=dim)
        # variance over all inputs of a cell's training rows
        inputs = self.add(cells.train()).select("cell", F.explode(vector_to_array("features")).alias("v"))
        self.gamma = {r["cell"]: 1.0 / (d * (r["v"] or 1.0)) for r in inputs.groupBy("cell").agg(F.var_pop("v").alias("v")).collect()}  # a row a cell
        train = self._mapped(cells.train().where("label_d IS NOT NULL")).select("cell", "label_d", "weight", "block")
        penalty = 1.0 / total_weight(cells)
        self.svm = LinearSVC(featuresCol="block", labelCol="label_d", weightCol="weight", regParam=penalty, maxIter=100, tol=1e-5, standardization=False, fitIntercept=False).fit(train)
        lines = self._line(self._margin(train))
        self.platt = LogisticRegression(featuresCol="line", labelCol="label_d", regParam=0.0, standardization=False, fitIntercept=False, maxIter=200).fit(lines)

    def _mapped(self, df: DataFrame) -> DataFrame:
        w, b, gamma, scale = self.w, self.b, self.gamma, (2.0 / self.dim) ** 0.5

        @F.pandas_udf("array<double>")
        def project(x: pd.Series, cell: pd.Series) -> pd.Series:
            g = np.sqrt(2 * cell.map(gamma).to_numpy(float))
            z = np.cos((np.stack(x.to_numpy()) @ w.T) * g[:, None] + b) * scale if len(x) else np.zeros((0, len(b)))
            return pd.Series([np.append(r, 1.0) for r in z])  # the last one is the intercept

        names = {"ml_attr": {"num_attrs": self.dim + 1, "attrs": {"numeric": [{"idx": i, "name": f"z{i}"} for i in range(self.dim + 1)]}}}
        df = self.add(df)
        df = df.select("*", array_to_vector(project(vector_to_array("features"), F.col("cell"))).alias("z", metadata=names))
        return stacked(self.cells, df, "z").drop("z", "features")

    def _margin(self, df: DataFrame) -> DataFrame:
        return self.svm.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction", "block")

    def _line(self, df: DataFrame) -> DataFrame:
        df = VectorAssembler(inputCols=["margin", "_one"], outputCol="_m").transform(df.withColumn("_one", F.lit(1.0)))
        return stacked(self.cells, df, "_m", "line").drop("_m", "_one")

    def predict(self, df: DataFrame | None = None) -> DataFrame:
        """``df`` with p and class; of packed cells the rows that each held out."""
        if self.packed:
            return self.packed.predict()
        out = self.platt.transform(self._line(self._margin(self._mapped(df)))).withColumn("p", vector_to_array("probability")[1])
        return out.withColumn("class", (F.col("margin") >= 0).cast("int")).drop("line", "rawPrediction", "probability", "prediction", "margin")


def fit_each(
    cells: Cells, fs: FeatureSet, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], max_workers: int = 8, reread: bool = True
) -> DataFrame:
    """Test rows of all cells with p, each cell by a model of its own (``fit(train)`` gives a
    function that adds p), from one table of assembled rows, a folder a cell. For learners that are
    not fitted together. With ``reread`` the training rows are kept in memory for a learner that
    reads them many times."""
    names = ["cell", "rep", "fold", "is_test", cells.key, "label_d", "weight", *cells.keep, "features"]
    spark = cells.rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex[:12]}"
    slices = -(-cells.rows.count() // (len(cells.cells) * SLICE)) or 1
    dealt = features(cells, fs)(cells.rows).select(*names).repartition("cell", F.pmod(F.xxhash64(cells.key), F.lit(slices)))
    dealt.write.partitionBy("cell").parquet(path)
    rows = spark.read.parquet(path)

    def run(cell):
        mine = rows.where(F.col("cell") == cell)
        if not reread:
            return cut_lineage(fit(mine.where("is_test = 0 AND label_d IS NOT NULL"))(mine.where("is_test = 1")).drop("features"))
        # the rebalanced table is written, so that its partitions are those that Spark sized by bytes
        # (a cache alone keeps the planned number); every iteration of a learner reads them again
        train = cut_lineage(mine.where("is_test = 0 AND label_d IS NOT NULL").hint("rebalance")).cache()
        out = cut_lineage(fit(train)(mine.where("is_test = 1")).drop("features", "rawPrediction", "probability", "prediction"))
        train.unpersist()
        return out

    with ThreadPoolExecutor(max_workers=min(max_workers, len(cells.cells))) as ex:
        parts = list(ex.map(run, [c for c, _, _ in cells.cells]))
    return reduce(DataFrame.unionByName, parts)
