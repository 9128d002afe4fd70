"""Boosted trees of many cells against Spark's learner, and their thresholds against its rule."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from yieldlens.operators import boosting as BO
from yieldlens.operators import cells as CE
from yieldlens.operators import packed as PA
from yieldlens.operators import splits as SP
from yieldlens.plans import q_models as Q

NUM, CAT, FLAGS = ["x", "z", "v"], ["cat"], ["x"]
FS = CE.FeatureSet(NUM, CAT, FLAGS)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x, z, v = rng.normal(), float(rng.integers(0, 5)), float(rng.gamma(1.0, 9.0))
        if i % 3 == 0:
            v = 4.0  # a frequent value
        y = int(x + 0.5 * z + 0.02 * v + rng.normal() > 1.5)
        rows.append((i, i % 60, y if i % 101 else None, None if i % 10 == 3 else x, z, v, [None, "a", "b", "c"][i % 4]))
    return spark.createDataFrame(rows, "key long, grp long, y int, x double, z double, v double, cat string").cache()


@pytest.fixture(scope="module")
def folds(frame):
    return SP.grouped_kfold(frame, "grp", "y", 3, reps=1).cache()


@pytest.fixture(scope="module")
def packed(frame, folds):
    return PA.pack_cells(frame, folds, "grp", "key", "y", NUM, CAT, FLAGS, keep=["cat"])


def reference_cuts(values, bins=32):
    """Spark's rule, value by value."""
    v, n = np.unique(values, return_counts=True)
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    out, stride, upto = [], len(values) / bins, int(n[0])
    target = stride
    for i in range(1, len(v)):
        before, upto = upto, upto + int(n[i])
        if abs(before - target) < abs(upto - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out)


def test_thresholds_follow_the_rule(packed, frame, folds):
    found = BO.thresholds(packed, PA.Design(packed, FS), 32)
    pdf = frame.join(folds, "grp").toPandas()
    for c, _, held in packed.cells:
        mine = pdf[(pdf["fold"] != held) & pdf["y"].notna()]
        for i, col in enumerate(NUM):
            want = reference_cuts(mine[col].fillna(mine[col].median()).to_numpy())
            assert len(found[c][i]) == len(want) and np.allclose(found[c][i], want, rtol=0, atol=1e-12)


def test_scores_are_those_of_sparks_learner(packed, frame, folds):
    """Trees of depth 2 over hundreds of rows a node have no equal splits."""
    mine = BO.PackedBoosting(packed, FS, BO.BoostSpec(trees=12, depth=2, step=0.3)).predict().toPandas()
    assert len(mine) == 900 and set(mine.columns) == {"cell", "rep", "fold", "key", "cat", "label_d", "p"}
    assert mine["label_d"].isna().sum() == frame.where("y IS NULL").count()
    stacked = CE.prepare_cells(frame.join(folds, "grp"), "key", "y", NUM, CAT, FLAGS, keep=["cat"])
    rows = CE.features(stacked, FS)(stacked.rows).cache()
    parts = []
    for c, _, _ in stacked.cells:
        gbt = GBTClassifier(featuresCol="features", labelCol="label_d", maxIter=12, maxDepth=2, stepSize=0.3, seed=42)
        model = gbt.fit(rows.where(f"cell = {c} AND is_test = 0 AND label_d IS NOT NULL"))
        parts.append(model.transform(rows.where(f"cell = {c} AND is_test = 1")).select("key", vector_to_array("probability")[1].alias("want")).toPandas())
    both = mine.merge(pd.concat(parts), on="key")
    assert len(both) == 900 and (both["p"] - both["want"]).abs().max() < 1e-9


def test_scores_do_not_depend_on_partitions(packed, spark):
    spec = BO.BoostSpec(trees=6, depth=3, step=0.3)
    one = BO.PackedBoosting(packed, FS, spec).predict().toPandas().set_index("key")["p"]
    df = packed.blocks.sparkSession.createDataFrame(sorted(packed.blocks.collect(), key=lambda r: -len(r["y"])), packed.blocks.schema).repartition(1)
    other = BO.PackedBoosting(PA.PackedCells(df, **{k: v for k, v in packed.__dict__.items() if k != "blocks"}), FS, spec).predict().toPandas().set_index("key")["p"]
    assert (one - other.loc[one.index]).abs().max() < 1e-9


def test_a_job_a_level_for_all_cells(packed, spark):
    """Spark's learner ran several jobs a level in every cell."""
    sc = spark.sparkContext
    sc.setJobGroup("boosting", "")
    BO.PackedBoosting(packed, CE.FeatureSet((), CAT, FLAGS), BO.BoostSpec(trees=10, depth=2))
    jobs = len(sc.statusTracker().getJobIdsForGroup("boosting"))
    sc.setJobGroup("", "")
    assert jobs <= 2 * 10 + 1


def test_no_feature_and_one_class(spark):
    """A set without features scores every row by the share of its class; rows of one class stay whole."""
    df = spark.createDataFrame([(i, i % 6, 1, None, "a") for i in range(30)], "key long, grp long, y int, x double, cat string")
    folds = SP.grouped_kfold(df, "grp", "y", 3, reps=1).cache()
    p = PA.pack_cells(df, folds, "grp", "key", "y", ["x"], ["cat"], ["x"])
    spec = BO.BoostSpec(trees=4)
    for fs in (CE.FeatureSet(), CE.FeatureSet(["x"], ["cat"], ["x"])):
        got = BO.PackedBoosting(p, fs, spec).predict().select("key", "p").collect()
        assert len(got) == 30 and all(r["p"] > 0.85 for r in got)


def test_the_query_uses_the_joint_trees(spark, monkeypatch):
    called = []
    monkeypatch.setattr(CE, "fit_each", lambda *a, **k: called.append(1))
    rows = [(i, i % 12, i % 12, f"unit{i % 3}", float(i % 7), int(i % 5 < 2), i % 24, 0) for i in range(120)]
    df = spark.createDataFrame(rows, "order_id long, subject_id long, stay_id long, unit string, view_min double, y int, hour int, is_repeat int")
    df = df.withColumns({c: F.col("view_min") for c in Q.FEATURES if c != "view_min"})
    monkeypatch.setattr(BO.PackedBoosting.__init__, "__defaults__", (BO.BoostSpec(trees=3),))
    out = Q._kfold(df, 1).scores("boosting", Q.MAIN)
    assert out.count() == 120 and not called and out.columns == ["rep", "fold", "order_id", "unit", "y", "p", "class"]
