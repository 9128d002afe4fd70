"""Cells over rows stored once, against the stacked table and fits of their own."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cells import CAT, FLAGS, NUM, newton, numpy_cell

from yieldlens.operators import cells as CE
from yieldlens.operators import packed as PA
from yieldlens.operators import splits as SP


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x, z = 1e4 + rng.normal(), float(rng.integers(0, 4))
        y = int(x - 1e4 + 0.7 * z + rng.normal() > 1.2)
        cat = "rare" if i % 30 == 7 else [None, "a", "b", "c"][i % 4]
        rows.append((i % 390, i % 30, y if i != 11 else None, None if i % 9 == 0 else x, None if i % 50 == 3 else z, cat, 7.25))
    return spark.createDataFrame(rows, "key long, grp long, y int, x double, z double, cat string, flat double")


@pytest.fixture(scope="module")
def folds(frame):
    return SP.grouped_kfold(frame.where("y IS NOT NULL"), "grp", "y", 4, reps=2).cache()


@pytest.fixture(scope="module")
def packed(frame, folds):
    return PA.pack_cells(frame, folds, "grp", "key", "y", [*NUM, "flat"], CAT, FLAGS, keep=["cat"])


@pytest.fixture(scope="module")
def stacked(frame, folds):
    return CE.prepare_cells(frame.join(folds, "grp"), "key", "y", [*NUM, "flat"], CAT, FLAGS, keep=["cat"])


FS = CE.FeatureSet([*NUM, "flat"], CAT, FLAGS)


def rows_of(packed):
    return [b for b in packed.decoded(packed.blocks.toArrow().to_batches())]


def test_rows_are_stored_once(packed, frame):
    blocks = rows_of(packed)
    assert sum(len(b.y) for b in blocks) == frame.count() == 400  # the stacked table has 8 copies
    assert len(packed.cells) == 8 and packed.levels == {"cat": 4}


def test_parameters_are_those_of_the_stacked_table(packed, stacked):
    """Prepared features, one by one and by the shared columns' map, equal those of the stacked rows."""
    d = PA.Design(packed, FS)
    want = {}
    add = CE.features(stacked, FS)
    for r in add(stacked.rows).select("cell", "features", "weight").collect():
        want.setdefault(r["cell"], []).append(r["features"].toArray())
    for c, _, _ in packed.listed:
        one = np.concatenate([d.prepared(b, np.arange(len(b.y)), c) for b in rows_of(packed)])
        via = np.concatenate([d.shared(b) @ d.maps[c] for b in rows_of(packed)])
        assert np.abs(via[:, :-1] - one).max() < 1e-9 and (via[:, -1] == 1).all()
        got, exp = (a[np.lexsort(np.round(a, 6).T)] for a in (one, np.array(want[c])))
        assert got.shape == exp.shape and np.abs(got - exp).max() < 1e-7
    weights = {(r["cell"], r["label_d"]): r["weight"] for r in stacked.train().where("label_d IS NOT NULL").select("cell", "label_d", "weight").distinct().collect()}
    assert all(abs(packed.class_weights()[c, int(y)] - w) < 1e-12 for (c, y), w in weights.items())
    assert {r["cell"]: r["n"] for r in packed.sizes().collect()} == {r["cell"]: r["n"] for r in stacked.sizes().collect()}


def test_medians_of_many_values_are_exact(spark):
    """Ranges hold many values each, so the middle ranks are looked up in the second step."""
    rng = np.random.default_rng(1)
    v = np.round(rng.gamma(1.0, 50.0, 6000), 3)
    v[::7] = 33.125  # a frequent value
    rows = [(i, i % 40, int(i % 3 == 0), float(a) if i % 11 else None) for i, a in enumerate(v)]
    df = spark.createDataFrame(rows, "key long, grp long, y int, x double")
    folds = SP.grouped_kfold(df, "grp", "y", 5, reps=2).cache()
    p = PA.pack_cells(df, folds, "grp", "key", "y", ["x"])
    at = {(r["rep"], r["grp"]): r["fold"] for r in folds.collect()}
    for c, rep, held in p.cells:
        mine = [r[3] for r in rows if r[3] is not None and at[rep, r[1]] != held]
        assert p.medians[c, 0] == np.median(mine)


def test_packed_logistic_equals_each_cell(frame, folds):
    p = PA.pack_cells(frame, folds, "grp", "key", "y", NUM, CAT, FLAGS, keep=["cat"])
    fs = CE.FeatureSet(NUM, CAT, FLAGS)
    model = CE.BlockLogistic(p, fs)
    scores = model.predict().toPandas()
    assert len(scores) == 800 and set(scores.columns) == {"cell", "rep", "fold", "key", "cat", "label_d", "p"}
    for (cell, coef, intercept), (_, rep, fold) in zip(model.coefficients(), p.cells, strict=True):
        X, y, w, train, held, keys = numpy_cell(frame, folds, rep, fold)
        want = newton(X[train], y[train], w[train])
        assert np.abs(np.array([*coef, intercept]) - want).max() < 1e-3
        prob = 1 / (1 + np.exp(-(np.c_[X, np.ones(len(X))] @ want)))
        mine = scores[scores["cell"] == cell]
        assert np.abs(np.sort(mine["p"].to_numpy()) - np.sort(prob[held])).max() < 1e-3
    assert max(abs(r["gradient"]) for r in model.gradients().collect()) < 2e-3


def test_packed_logistic_equals_the_joint_fit(packed, stacked):
    a = CE.BlockLogistic(packed, FS).predict().groupBy("cell", "key").agg(F.sum("p").alias("a"))
    joint = CE.BlockLogistic(stacked, FS, tol=1e-10)
    b = joint.predict(stacked.test()).groupBy("cell", "key").agg(F.sum("p").alias("b"))
    both = a.join(b, ["cell", "key"], "full").toPandas()
    assert len(both) == 780 and (both["a"] - both["b"]).abs().max() < 1e-5


def test_chosen_rows_train_with_weight_one(frame, folds):
    """Rows say themselves which cells they train."""
    chosen = frame.withColumn("pick", F.when(F.col("y").isNotNull() & (F.col("grp") % 2 == 0), F.array(F.lit(0), F.lit(3))))
    p = PA.pack_cells(chosen, folds, "grp", "key", "y", NUM, CAT, FLAGS, chosen="pick")
    model = CE.BlockLogistic(dataclasses.replace(p, chosen=True), CE.FeatureSet(NUM, CAT, FLAGS))
    coef = {c: np.array([*b, b0]) for c, b, b0 in model.coefficients()}
    pdf = frame.toPandas()
    for cell in (0, 3):
        _, rep, fold = p.cells[cell]
        X, y, _, _, _, keys = numpy_cell(frame, folds, rep, fold)
        use = (pdf.sort_values("key")["grp"] % 2 == 0).to_numpy() & ~np.isnan(y)
        assert np.abs(coef[cell] - newton(X[use], y[use], np.ones(use.sum()))).max() < 1e-3
    assert np.abs(coef[1]).max() < 1e-9  # no row chose it


def test_packed_svm_reaches_the_least_objective(frame, folds):
    """Not above the objective that Spark's LinearSVC reaches on the same features, cell by cell."""
    frame, folds = frame.withColumnRenamed("z", "v"), folds.where("rep = 0").cache()
    packed = PA.pack_cells(frame, folds, "grp", "key", "y", ["x", "v"], CAT, FLAGS)
    stacked = CE.prepare_cells(frame.join(folds, "grp"), "key", "y", ["x", "v"], CAT, FLAGS)
    fs = CE.FeatureSet(["x", "v"], CAT, FLAGS)
    model = CE.BlockSvm(packed, fs, dim=10)
    out = model.predict().toPandas()
    assert len(out) == 400 and out["p"].between(0, 1).all() and set(out["class"]) == {0, 1}
    old = CE.BlockSvm(stacked, fs, dim=10)
    train = old._mapped(stacked.train().where("label_d IS NOT NULL")).select("cell", "label_d", "weight", "block")
    for c, w in model.packed.coef.items():
        rows = train.where(F.col("cell") == c).collect()
        z = np.array([r["block"].toArray()[c * 11 : (c + 1) * 11] for r in rows])
        side, wt = np.array([2 * r["label_d"] - 1 for r in rows]), np.array([r["weight"] for r in rows])
        value = lambda b: 0.5 * b @ b + wt @ np.maximum(0, 1 - side * (z @ b))
        spark_w = old.svm.coefficients.toArray()[c * 11 : (c + 1) * 11]
        assert abs(old.gamma[c] - model.packed.gamma[c]) < 1e-9
        assert value(w) <= value(spark_w) * 1.0005
