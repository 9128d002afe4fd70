"""Out-of-fold predictions: full cover, one score per (rep, row), planted signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlens.operators import models as ML
from yieldlens.operators import splits as SP
from yieldlens.operators.metrics import ranking_metrics


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for i in range(240):
        g = i % 24
        x = (i * 37 % 100) / 100.0
        y = int(x > 0.55)
        rows.append((i, g, y, x if i % 11 else None, ["a", "b", "c"][i % 3]))
    return spark.createDataFrame(rows, "key long, grp long, y int, x double, cat string")


def test_oof_cover_and_signal(frame):
    spec = ML.FrameSpec(key="key", label="y", group="grp", numeric=["x"], categorical=["cat"], missing_flags=["x"])
    folds = SP.grouped_kfold(frame, "grp", "y", 3, reps=2)
    oof = ML.oof_predictions(frame, spec, "logistic", folds)
    assert oof.count() == 2 * 240
    assert oof.groupBy("rep", "key").count().where("count > 1").count() == 0
    # every row is scored by the fold that held it out
    assigned = frame.join(folds, "grp").select("rep", "key", F.col("fold").alias("f_assigned"))
    assert oof.join(assigned, ["rep", "key"]).where("fold != f_assigned").count() == 0
    assert ranking_metrics(oof, "y", "p").first().auroc > 0.8  # planted signal is found


def test_one_hot_names_do_not_claim_other_columns(frame):
    spec = ML.FrameSpec(key="key", label="y", group="grp", numeric=["cat_score"], categorical=["cat"])
    f = frame.withColumn("cat_score", F.coalesce("x", F.lit(0.5)))
    _, _, names = ML.prepare(f, f, spec)
    assert names == ["cat_score", "cat_a", "cat_b", "cat_c"]


def test_blocked_knn_equals_brute_force(spark, monkeypatch):
    """Several blocks a side, repeated vectors (ties by key), NULL vectors."""
    monkeypatch.setattr(ML.ExactKnn, "TRAIN_BLOCK", 16)
    monkeypatch.setattr(ML.ExactKnn, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(5)
    vec = rng.integers(0, 3, (90, 3)).astype(float).tolist()
    train = [(i, vec[i], float(i % 3 == 0)) for i in range(60)] + [(60, None, 1.0)]
    test = [(100 + i, vec[60 + i]) for i in range(30)] + [(200, None)]
    predict = ML.ExactKnn(5, key="id", vec="v").fit(spark.createDataFrame(train, "id long, v array<double>, label_d double"))
    got = {r.id: r.p for r in predict(spark.createDataFrame(test, "id long, v array<double>")).collect()}
    for k, v in test:
        if v is None:
            assert got[k] is None
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, x)), t, y) for t, x, y in train if x is not None)[:5]
        assert got[k] == pytest.approx(sum(y for _, _, y in near) / 5)
    empty = ML.ExactKnn(5, key="id", vec="v").fit(spark.createDataFrame([], "id long, v array<double>, label_d double"))
    assert [r.p for r in empty(spark.createDataFrame(test[:2], "id long, v array<double>")).collect()] == [None, None]


def test_calibration_leaves_the_own_fold_out(spark):
    """In the larger fold 0 the score means the opposite of what it means in fold 1, whose
    calibrator maps fold 0 and so leaves its order of scores (one fit on all would turn it)."""
    rows = [(0, int(i % 3 == 0), i, int((i % 10 > 4) != (i % 3 != 0)), (i % 10) / 10) for i in range(90)]
    oof = spark.createDataFrame(rows, "rep int, fold int, key long, y int, p double")
    for method in ("platt", "isotonic"):
        cal = ML.calibrate(oof, "y", "p", method)
        assert cal.count() == 90
        high, low = (cal.where(f"fold = 0 AND p {c}").agg(F.avg("p_cal")).first()[0] for c in ("> 0.6", "< 0.3"))
        assert high > low


def test_registered_protocols(spark, monkeypatch):
    """Repeats, folds and models of the comparison queries, with scores in place of the fits."""
    from yieldlens.plans import q_models as Q

    calls = []

    def scores(self, model, fs):
        cells = self.folds.select("rep", "fold").distinct().count()
        calls.append((model, self.folds.select("rep").distinct().count(), cells))
        p = F.pmod(F.xxhash64("order_id", "rep"), F.lit(1000)) / 1000
        return self.f.join(self.folds, self.group).select("rep", "fold", "order_id", "unit", "y", p.alias("p"), F.lit(1).alias("class"))

    monkeypatch.setattr(Q.Protocol, "scores", scores)
    sf = "/root/testdata/sf0.001"
    got = {(r.feature_set, r.model) for r in Q.ablation_summary(spark, sf).collect()}
    assert got == {(s, m) for s in Q.SETS for m in ("logistic", "forest")}
    assert len(calls) == 8
    assert all(c[1:] == (20, 100) for c in calls)
    calls.clear()
    Q.within_unit_increment(spark, sf).collect()
    assert calls == [("forest", 5, 25)] * 2
    calls.clear()
    Q.model_seed_robustness(spark, sf).collect()
    assert [c[1] for c in calls] == [25] * len(Q.TABLE_MODELS)
