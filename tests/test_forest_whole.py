"""Forests of a table that every task holds whole: no pass a level, the same trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlens.operators import cells as CE
from yieldlens.operators import forest as FO
from yieldlens.operators import splits as SP

FS = CE.FeatureSet(["x", "z"], ["cat"], ["x"])
SPEC = FO.ForestSpec(trees=30, depth=5, min_leaf=4)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        x, z = rng.normal(), float(rng.integers(0, 6))
        y = int(x + 0.4 * z + rng.normal() > 1.2)
        rows.append((i, i % 70, y if i % 89 else None, None if i % 9 == 2 else x, z, [None, "a", "b"][i % 3]))
    return spark.createDataFrame(rows, "key long, grp long, y int, x double, z double, cat string").cache()


def scores(frame, folds):
    binned = FO.bin_rows(frame, folds, "grp", "key", "y", ["x", "z"], ["cat"], ["x"])
    forest = FO.CellForests(binned, FS, SPEC)
    return {(r["rep"], r["key"]): r["p"] for r in forest.predict().collect()}, forest


def test_whole_trees_are_those_of_the_level_passes(spark, frame, monkeypatch):
    folds = SP.grouped_kfold(frame, "grp", "y", 3, reps=2).cache()
    monkeypatch.setattr(FO, "DENSE", 40)  # both ways of counting
    with monkeypatch.context() as m:
        m.setattr(FO.CellForests, "_count", lambda *a: pytest.fail("a pass a level"))
        whole, a = scores(frame, folds)
    monkeypatch.setattr(FO, "WHOLE", 0)
    monkeypatch.setattr(FO, "BLOCK", 100)
    passes, b = scores(frame, folds)
    assert whole == passes and len(whole) == 1800
    assert all((u.feature == v.feature).all() and (u.count == v.count).all() for u, v in zip(a.levels, b.levels, strict=True))


def test_cells_without_rows(spark, frame):
    """A cell whose training rows have no label scores one half."""
    folds = frame.select("grp").distinct().select(F.lit(0).alias("rep"), "grp", F.when(F.col("grp") < 35, 0).otherwise(1).alias("fold"))
    df = frame.withColumn("y", F.when(F.col("grp") < 35, F.col("y")))
    got, _ = scores(df, folds)
    assert len(got) == 900
    assert {p for (_, k), p in got.items() if k % 70 < 35} == {0.5}
