"""Models on Spark ML: per-fold preparation + fit, out-of-fold (OOF) predictions,
a registry of estimator factories, random-Fourier-feature SVM, k-NN (operators.neighbours),
permutation importance and recalibration.

Fits are Spark ML jobs (distributed over rows); the (rep, fold) fits of one
model are launched from a small driver thread pool so independent fits overlap.
The stacked OOF table is checkpointed once so later metrics reuse it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import prep as PR
from .isotonic import isotonic_apply, isotonic_fit
from .metrics import ranking_metrics
from .neighbours import CoarseKnn, ExactKnn
from .sizing import with_scalars


@dataclass
class FrameSpec:
    """Roles of the modelling frame's columns."""

    key: str
    label: str
    group: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    missing_flags: list[str] = field(default_factory=list)


def prepare(train: DataFrame, test: DataFrame, spec: FrameSpec) -> tuple[DataFrame, DataFrame, list[str]]:
    """Fit preparation on ``train`` only and apply it to both sides: missing flags,
    median / mode imputation, standardisation, one-hot; assemble ``features``.
    Returns (train, test, feature names)."""
    flags = [f"{c}_missing" for c in spec.missing_flags]
    tr = PR.missing_flags(train, spec.missing_flags)
    te = PR.missing_flags(test, spec.missing_flags)
    tr_imp = PR.impute(tr, tr, spec.numeric, spec.categorical)
    te_imp = PR.impute(te, tr, spec.numeric, spec.categorical)
    tr_z = PR.standardize(tr_imp, tr_imp, spec.numeric)
    te_z = PR.standardize(te_imp, tr_imp, spec.numeric)
    levels = PR.one_hot_levels(tr_z, spec.categorical)
    tr_o, onehot = PR.one_hot_encode(tr_z, levels)
    te_o, _ = PR.one_hot_encode(te_z, levels)
    names = spec.numeric + flags + onehot
    asm = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    w = PR.balanced_weights(asm.transform(tr_o), tr_o, spec.label, "weight")
    return w, asm.transform(te_o), names


# --- estimator registry ---------------------------------------------------------


def _proba(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1])


class SparkModel:
    """Wraps a Spark ML estimator factory ``make(train) -> Estimator``."""

    def __init__(self, make: Callable[[DataFrame], object]):
        self.make = make

    def fit(self, train: DataFrame):
        est = self.make(train)
        model = est.fit(train)
        return lambda df: _proba(model.transform(df))


def _logistic(train: DataFrame):
    # penalty ½‖w‖² + C Σ wᵢ lossᵢ (C = 1) equals Spark's mean-loss objective with
    # regParam = 1 / Σ wᵢ; features are standardised already.
    sw = train.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        featuresCol="features", labelCol="label_d", weightCol="weight", maxIter=1000,
        regParam=1.0 / sw, elasticNetParam=0.0, standardization=False, tol=1e-4,
    )


def _forest(train: DataFrame):
    return RandomForestClassifier(
        featuresCol="features", labelCol="label_d", weightCol="weight", numTrees=300, maxDepth=8,
        minInstancesPerNode=15, featureSubsetStrategy="sqrt", seed=42,
    )


def _boosting(train: DataFrame):
    # Spark's GBT minimises logistic loss with its own tree learner: results are
    # comparable in kind, not numerically equal to other libraries.
    return GBTClassifier(
        featuresCol="features", labelCol="label_d", maxIter=300, maxDepth=4, stepSize=0.05, seed=42, cacheNodeIds=True, maxMemoryInMB=512,
    )


class RffSvm:
    """RBF-kernel SVM re-aimed for Spark: random Fourier features
    z(x) = √(2/D) cos(Wx + b), W ~ N(0, 2γ), γ = 1/(d · Var(X)) ('scale'), a
    class-weighted linear SVM on z, then Platt scaling (logistic regression on the
    SVM margin, fitted on the training rows). An approximation of the kernel SVM."""

    def __init__(self, dim: int = 200, seed: int = 42, reg: float = 0.01):
        self.dim, self.seed, self.reg = dim, seed, reg

    def fit(self, train: DataFrame):
        d = len(train.select("features").first()[0])
        var = train.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        gamma = 1.0 / (d * var)
        rng = np.random.default_rng(self.seed)
        W = rng.normal(0.0, math.sqrt(2 * gamma), size=(self.dim, d))
        b = rng.uniform(0.0, 2 * math.pi, size=self.dim)
        scale = math.sqrt(2.0 / self.dim)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            # Arrow batch → one matrix product; no per-row Python
            X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, d))
            Z = np.cos(X @ W.T + b) * scale
            return pd.Series(list(Z))

        def rff(df: DataFrame) -> DataFrame:
            return df.withColumn("rff", array_to_vector(project(vector_to_array("features"))))

        tr = rff(train).cache()
        svm = LinearSVC(featuresCol="rff", labelCol="label_d", weightCol="weight", regParam=self.reg, maxIter=100, tol=1e-4).fit(tr)
        margin = lambda df: (
            svm.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
        )
        tm = VectorAssembler(inputCols=["margin"], outputCol="m_vec").transform(margin(tr))
        platt = LogisticRegression(featuresCol="m_vec", labelCol="label_d", regParam=0.0).fit(tm)

        tr.unpersist()

        def predict(df: DataFrame) -> DataFrame:
            m = VectorAssembler(inputCols=["margin"], outputCol="m_vec").transform(margin(rff(df)))
            return platt.transform(m).withColumn("p", vector_to_array("probability")[1]).drop("m_vec", "rff", "margin")

        return predict


MODELS: dict[str, Callable[[FrameSpec], object]] = {
    "logistic": lambda spec: SparkModel(_logistic),
    "forest": lambda spec: SparkModel(_forest),
    "boosting": lambda spec: SparkModel(_boosting),
    "rff_svm": lambda spec: RffSvm(),
    "knn": lambda spec: ExactKnn(5, key=spec.key),
    "knn_index": lambda spec: CoarseKnn(5, key=spec.key),
}


def oof_predictions(
    df: DataFrame,
    spec: FrameSpec,
    model: str,
    folds: DataFrame,
    max_workers: int = 8,
    extra: Sequence[str] = (),
    train_transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Out-of-fold probability for every row and repetition.

    ``folds`` is (rep, group, fold). For each (rep, fold) the preparation and the
    model are fitted on the other folds and applied to this fold. Output:
    (rep, fold, key, label, p, *extra) — exactly one score per (rep, row).
    ``train_transform`` (e.g. class rebalancing) applies to training folds only.
    """
    assigned = df.join(folds, spec.group).withColumn("label_d", F.col(spec.label).cast("double"))
    # carried columns survive preparation (which replaces categorical inputs)
    assigned = assigned.withColumns({f"_keep_{c}": F.col(c) for c in extra})
    cells = [(r[0], r[1]) for r in folds.select("rep", "fold").distinct().orderBy("rep", "fold").collect()]

    def run(cell):
        rep, fold = cell
        part = assigned.where(F.col("rep") == rep)
        train = part.where(F.col("fold") != fold)
        if train_transform is not None:
            train = train_transform(train)
        train = train.cache()
        test = part.where(F.col("fold") == fold)
        tr, te, _ = prepare(train, test, spec)
        tr = tr.cache()
        predict = MODELS[model](spec).fit(tr)
        out = predict(te).select("rep", "fold", spec.key, spec.label, "p", *[F.col(f"_keep_{c}").alias(c) for c in extra])
        res = cut_lineage(out)
        tr.unpersist()
        train.unpersist()
        return res

    with ThreadPoolExecutor(max_workers=min(max_workers, len(cells))) as ex:
        parts = list(ex.map(run, cells))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame],
    test: DataFrame,
    label: str,
    features: Sequence[str],
    all_features: Sequence[str],
    key: str,
    seed: int = 7,
    max_workers: int = 8,
) -> DataFrame:
    """AUROC drop when one prepared input column is permuted: rows are re-paired
    with the values of other rows in md5(seed ':' key) order, the feature vector is
    re-assembled and re-scored. ``test`` carries the prepared columns. No data is
    collected; the per-feature jobs run concurrently."""
    from .ordering import sequence_number
    from .splits import seeded_hash

    asm = VectorAssembler(inputCols=list(all_features), outputCol="features", handleInvalid="keep")
    base_df = test.drop("features")
    base = ranking_metrics(predict(asm.transform(base_df)), label, "p").select(F.col("auroc").alias("base_auroc"))
    pos = sequence_number(base_df.select(key), [], [key], "_i")

    def one(c: str) -> DataFrame:
        vals = sequence_number(base_df.select(key, c).withColumn("_h", seeded_hash(seed, key)), [], ["_h", key], "_i")
        perm = pos.join(vals.select("_i", F.col(c).alias("_perm")), "_i").drop("_i")
        t = base_df.join(perm, key).drop(c).withColumnRenamed("_perm", c)
        m = ranking_metrics(predict(asm.transform(t)), label, "p")
        return cut_lineage(m.select(F.lit(c).alias("feature"), F.col("auroc").alias("permuted_auroc")))

    with ThreadPoolExecutor(max_workers=min(max_workers, len(features))) as ex:
        rows = list(ex.map(one, features))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return with_scalars(out, base).withColumn("importance", F.col("base_auroc") - F.col("permuted_auroc"))


def downsample_majority(train: DataFrame, label: str, key: str, seed: int = 11, by: Sequence[str] = ()) -> DataFrame:
    """Balance classes (inside each ``by`` group) by keeping, in every class, the first n_minority
    rows in md5(seed ':' key) order (exact per-class quota, deterministic)."""
    from .metrics import join_groups
    from .ordering import first_n
    from .splits import seeded_hash

    counts = train.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_nc"))
    quota = counts.groupBy(*by).agg(F.min("_nc").alias("_quota"))
    t = join_groups(train, quota, list(by)).withColumn("_h", seeded_hash(seed, key))
    return first_n(t, [*by, label], [F.col("_h"), F.col(key)], "_quota", out="_r").drop("_h", "_r", "_quota")


def calibrate(
    oof: DataFrame, label: str, score: str = "p", method: str = "platt", rep: str = "rep", fold: str = "fold"
) -> DataFrame:
    """Recalibrate out-of-fold scores: 'platt' (logistic on the score) or 'isotonic'.
    Cross-fitted: the rows of a (rep, fold) are mapped by a calibrator fitted on the other
    folds of that repetition, so no row takes part in its own calibration."""
    cells = oof.select(F.col(rep).alias("_rep"), F.col(fold).alias("_held")).distinct()
    if method == "isotonic":
        others = oof.join(cells, (F.col(rep) == F.col("_rep")) & (F.col(fold) != F.col("_held")))
        pools = isotonic_fit(others, score, label, ["_rep", "_held"])
        held = oof.withColumns({"_rep": F.col(rep), "_held": F.col(fold)})
        return isotonic_apply(held, pools, score, ["_rep", "_held"]).drop("_rep", "_held")
    v = VectorAssembler(inputCols=[score], outputCol="_s").transform(oof.withColumn("_y", F.col(label).cast("double")))
    parts = []
    for r, f in [(x[0], x[1]) for x in cells.orderBy("_rep", "_held").collect()]:
        here = v.where(F.col(rep) == r)
        others, held = here.where(F.col(fold) != f), here.where(F.col(fold) == f)
        m = LogisticRegression(featuresCol="_s", labelCol="_y", regParam=0.0).fit(others)
        out = m.transform(held).withColumn("p_cal", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        parts.append(out.drop("_s", "_y"))
    return reduce(DataFrame.unionByName, parts)
