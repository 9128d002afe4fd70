"""Isotonic fit by hulls against pooling by hand; neighbours through the index against the exact ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldlens.operators import models as ML
from yieldlens.operators import neighbours as NB
from yieldlens.operators.isotonic import isotonic_apply, isotonic_fit, lower_hull


def pav(points):
    """Pools (lo, hi, n, value) of (score, weight, label) rows by adjacent violators."""
    per = {}
    for s, w, y in points:
        a = per.setdefault(s, [0.0, 0.0])
        a[0] += w
        a[1] += w * y
    pools = []
    for s in sorted(per):
        pools.append([s, s, per[s][0], per[s][1]])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            b = pools.pop()
            pools[-1] = [pools[-1][0], b[1], pools[-1][2] + b[2], pools[-1][3] + b[3]]
    return [(a, b, n, y / n) for a, b, n, y in pools]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in ("a", "b", None):
        for _ in range(400):
            s = float(rng.integers(0, 60)) / 10
            rows.append((g, s, int(rng.random() < s / 8 + 0.1), 1.0 + float(rng.integers(0, 3))))
    rows += [("a", None, 1, 1.0), ("a", 2.0, None, 1.0), ("one", 3.0, 1, 1.0), ("flat", 1.0, 0, 1.0), ("flat", 2.0, 0, 1.0), ("fall", 1.0, 1, 1.0), ("fall", 2.0, 0, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, s double, y int, w double")


@pytest.mark.parametrize("weight", [None, "w"])
def test_isotonic_pools(scored, weight):
    rows, df = scored
    got = {}
    for r in isotonic_fit(df.repartition(7), "s", "y", ["g"], weight).orderBy("pool").collect():
        got.setdefault(r["g"], []).append((r["lo"], r["hi"], r["n"], r["value"]))
    for g in {r[0] for r in rows}:
        want = pav([(s, w if weight else 1.0, y) for k, s, y, w in rows if k == g and s is not None and y is not None])
        # pools of equal value may be cut or joined: values of all scores decide
        value = lambda pools, s: next(v for lo, hi, _, v in pools if lo <= s <= hi)
        for _, s, y, _ in (r for r in rows if r[0] == g and r[1] is not None and r[2] is not None):
            assert value(got[g], s) == pytest.approx(value(want, s), abs=1e-12)
        assert sum(n for _, _, n, _ in got[g]) == pytest.approx(sum(n for _, _, n, _ in want))
        assert all(a[3] < b[3] for a, b in zip(got[g], got[g][1:], strict=False))


def test_isotonic_apply_interpolates(spark):
    fit = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (6.0, 1)], "s double, y int")
    pools = isotonic_fit(fit, "s", "y")
    ask = spark.createDataFrame([(x,) for x in (0.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 9.0, None)], "s double")
    got = {r["s"]: r["p_cal"] for r in isotonic_apply(ask, pools, "s").collect()}
    assert got == {0.0: 0.0, 1.5: 0.0, 2.0: 0.0, 2.5: 0.25, 3.0: 0.5, 4.0: 1.0, 5.0: 1.0, 9.0: 1.0, None: None}
    empty = isotonic_fit(fit.limit(0), "s", "y")
    assert empty.count() == 0
    assert {r["p_cal"] for r in isotonic_apply(ask, empty, "s").collect()} == {None}


def test_lower_hull():
    x, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 1, 2, 2])
    assert lower_hull(x, y).tolist() == [0, 4]
    assert lower_hull(x, x**2).tolist() == [0, 1, 2, 3, 4]
    assert lower_hull(x[:0], y[:0]).tolist() == []


def test_cross_fitted_isotonic_leaves_its_fold_out(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i % 4, i, int(rng.random() < (i % 10) / 10), (i % 10) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "rep int, fold int, key int, y int, p double")
    got = {r["key"]: r["p_cal"] for r in ML.calibrate(df, "y", "p", "isotonic").collect()}
    assert len(got) == 200
    for fold in range(4):
        pools = pav([(p, 1.0, y) for _, f, _, y, p in rows if f != fold])
        for _, f, key, _, p in rows:
            if f == fold:
                inside = [v for lo, hi, _, v in pools if lo <= p <= hi]
                assert inside and got[key] == pytest.approx(inside[0], abs=1e-12)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 4, (12, 8))
    x = middles[rng.integers(0, 12, 900)] + rng.normal(0, 1, (900, 8))
    train = [(i, x[i].tolist(), float(i % 3 == 0)) for i in range(700)] + [(700, None, 1.0), (701, x[0].tolist(), None)]
    test = [(1000 + i, x[700 + i].tolist()) for i in range(200)] + [(2000, None)]
    t = spark.createDataFrame(train, "id long, v array<double>, label_d double")
    return t, spark.createDataFrame(test, "id long, v array<double>")


def test_index_recall(vectors, monkeypatch):
    train, test = vectors
    monkeypatch.setattr(NB.CoarseKnn, "LIST", 50)
    exact = {(r["id"], r["_tkey"]) for r in NB.ExactKnn(5, "id", "v").neighbours_of(train)(test).collect()}
    assert len(exact) == 1000
    some = {(r["id"], r["_tkey"]) for r in NB.CoarseKnn(5, "id", "v", probes=4).neighbours_of(train)(test).collect()}
    assert len(exact & some) / len(exact) >= 0.9
    every = {(r["id"], r["_tkey"]) for r in NB.CoarseKnn(5, "id", "v", probes=100).neighbours_of(train)(test).collect()}
    assert every == exact


def test_index_splits_hot_lists(vectors, monkeypatch):
    """One list of all rows, dealt over blocks: the exact vote again."""
    train, test = vectors
    monkeypatch.setattr(NB.CoarseKnn, "LIST", 10_000)
    monkeypatch.setattr(NB.CoarseKnn, "BLOCK", 40)
    got = {r["id"]: r["p"] for r in NB.CoarseKnn(5, "id", "v").fit(train)(test).collect()}
    want = {r["id"]: r["p"] for r in NB.ExactKnn(5, "id", "v").fit(train)(test).collect()}
    assert got == want and got[2000] is None
    empty = NB.CoarseKnn(5, "id", "v").fit(train.limit(0))
    assert {r["p"] for r in empty(test.limit(3)).collect()} == {None}


def test_soft_labels_are_two_weighted_rows(spark):
    from yieldlens.operators import cells as CE
    from yieldlens.operators.prep import soft_rows

    df = spark.createDataFrame([(1, 0.25), (2, 1.0), (3, 0.0), (4, None)], "k int, y double")
    assert sorted((r["k"], r["y"], r["mass"]) for r in soft_rows(df, "y").collect() if r["y"] is not None) == [(1, 0.0, 0.75), (1, 1.0, 0.25), (2, 1.0, 1.0), (3, 0.0, 1.0)]
    rng = np.random.default_rng(6)
    rows = [(i, i % 20, float(rng.normal()), [0.0, 1.0, 0.5][i % 3]) for i in range(240)]
    frame = spark.createDataFrame(rows, "key long, grp long, x double, y double").withColumn("rep", F.lit(0)).withColumn("fold", (F.col("grp") % 4).cast("int"))
    soft = CE.prepare_cells(frame, "key", "y", ["x"], soft=True)
    # each training row's mass is one; a label of a half counts half in both classes
    mass = soft.train().groupBy("cell", "key").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    assert mass.join(frame.where("y = 0.5"), "key").where("n <> 2").count() == 0
    model = CE.BlockLogistic(soft, CE.FeatureSet(["x"]))
    for r in model.gradients().collect():
        assert abs(r["gradient"]) < 1e-2
    # the gradient of a half is the mean of both hard labels' gradients: brute force on one cell
    cell = [r for r in soft.train().where("cell = 0").collect()]
    b, b0 = model.coefficients()[0][1][0], model.coefficients()[0][2]
    p = {r["key"]: 1 / (1 + np.exp(-(r["x"] * b + b0))) for r in cell}
    total = sum(r["weight"] * (p[r["key"]] - r["label_d"]) * r["x"] for r in cell) + b
    assert abs(total) < 1e-2


def test_nearest_kernel_keeps_no_full_order():
    """The k best of a pair of blocks own their memory (a slice of the full order, 8 bytes a pair of
    rows, stayed alive before), and are those of brute force."""
    import tracemalloc

    from yieldlens.operators.neighbours import _best

    rng = np.random.default_rng(3)
    q = pd.DataFrame({"key": np.arange(2000), "_x": list(rng.normal(size=(2000, 4)))})
    t = pd.DataFrame({"_tkey": rng.permutation(8000), "_x": list(rng.integers(0, 4, size=(8000, 4)) + rng.integers(0, 2, size=(8000, 1)) * 1e6), "_y": 1.0})
    tracemalloc.start()
    got = _best(5, "key")(q, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 128 MB of places before
    x = np.array(t["_x"].tolist())
    for i in range(0, 2000, 97):
        d = ((q["_x"][i] - x) ** 2).sum(axis=1)
        assert got["_tkey"][got["key"] == i].tolist() == t["_tkey"].to_numpy()[np.lexsort((t["_tkey"], d))[:5]].tolist()


def test_exact_neighbours_store_no_copies(spark, monkeypatch):
    """Blocks meet without a shuffle of vectors: only the k best of each query row are exchanged."""
    monkeypatch.setattr(NB.ExactKnn, "TRAIN_BLOCK", 16)
    monkeypatch.setattr(NB.ExactKnn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(NB.ExactKnn, "MEET", 2)
    rows = spark.range(300).selectExpr("id AS key", "array(cast(id % 7 AS double), cast(id % 5 AS double)) AS embedding", "cast(id % 2 AS double) AS label_d")
    near = NB.ExactKnn(5, key="key", vec="embedding").neighbours_of(rows.where("key < 200"))(rows.where("key >= 200"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    got = {}
    for r in near.collect():
        got.setdefault(r["key"], []).append((r["_dist"], r["_tkey"]))
    for k in range(200, 300):
        want = sorted(((k % 7 - t % 7) ** 2 + (k % 5 - t % 5) ** 2, t) for t in range(200))[:5]
        assert sorted(got[k]) == want
