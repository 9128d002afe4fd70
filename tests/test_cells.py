"""Cells fitted together: block-diagonal logistic regression and forests, against fits of their own."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from yieldlens.operators import cells as CE
from yieldlens.operators import forest as FO
from yieldlens.operators import splits as SP

NUM, CAT, FLAGS = ["x", "z"], ["cat"], ["x"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x, z = rng.normal(), float(rng.integers(0, 4))
        y = int(x + 0.7 * z + rng.normal() > 1.2)
        # 'rare' is in one group only, so cells that hold it out never train on it
        cat = "rare" if i % 30 == 7 else [None, "a", "b", "c"][i % 4]
        rows.append((i, i % 30, y if i != 11 else None, None if i % 9 == 0 else x, z, cat))
    return spark.createDataFrame(rows, "key long, grp long, y int, x double, z double, cat string")


@pytest.fixture(scope="module")
def folds(frame):
    return SP.grouped_kfold(frame.where("y IS NOT NULL"), "grp", "y", 4, reps=2).cache()


@pytest.fixture(scope="module")
def prepared(frame, folds):
    return CE.prepare_cells(frame.join(folds, "grp"), "key", "y", NUM, CAT, FLAGS, keep=["cat"])


def numpy_cell(frame, folds, rep, fold):
    """Preparation of one cell by hand: (X train, y, weights, X test by key)."""
    pdf = frame.join(folds.where(F.col("rep") == rep), "grp").toPandas().sort_values("key")
    held = (pdf["fold"] == fold).to_numpy()
    train = ~held & pdf["y"].notna().to_numpy()
    cols = []
    for c in NUM:
        v = pdf[c].to_numpy(dtype=float, na_value=np.nan)
        v = np.where(np.isnan(v), np.nanmedian(v[train]), v)
        cols.append((v - v[train].mean()) / (v[train].std() or 1.0))
    cols += [pdf[c].isna().to_numpy().astype(float) for c in FLAGS]
    mode = pdf.loc[train, "cat"].value_counts()
    mode = min(mode[mode == mode.max()].index)
    cat = pdf["cat"].where(pdf["cat"].notna(), mode)
    cols += [((cat == lv) & cat.isin(cat[train])).to_numpy().astype(float) for lv in sorted(pdf["cat"].dropna().unique())]
    X, y = np.stack(cols, axis=1), pdf["y"].to_numpy(dtype=float, na_value=np.nan)
    n, n1 = train.sum(), y[train].sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    return X, y, w, train, held, pdf["key"].to_numpy()


def newton(X, y, w):
    """Logistic regression with penalty 1/2 |b|^2 on all but the intercept."""
    A = np.c_[X, np.ones(len(X))]
    D = np.diag([1.0] * X.shape[1] + [0.0])
    b = np.zeros(A.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-A @ b))
        b -= np.linalg.solve((A * (w * p * (1 - p))[:, None]).T @ A + D, A.T @ (w * (p - y)) + D @ b)
    return b


def test_cover_and_shapes(prepared):
    assert len(prepared.cells) == 8 and prepared.levels == {"cat": 4}
    test = prepared.test()
    assert test.groupBy("rep", "key").count().where("count > 1").count() == 0
    assert test.count() == 2 * 300
    both = prepared.rows.groupBy("cell", "key").count()
    assert both.where("count > 1").count() == 0 and prepared.rows.count() == 8 * 300


def test_block_logistic_equals_each_cell(frame, folds, prepared):
    fs = CE.FeatureSet(NUM, CAT, FLAGS)
    model = CE.BlockLogistic(prepared, fs)
    scores = {(r["cell"], r["key"]): r["p"] for r in model.predict(prepared.test()).collect()}
    assert len(scores) == 600
    for (cell, coef, intercept), (_, rep, fold) in zip(model.coefficients(), prepared.cells, strict=True):
        X, y, w, train, held, keys = numpy_cell(frame, folds, rep, fold)
        want = newton(X[train], y[train], w[train])
        assert np.abs(np.array([*coef, intercept]) - want).max() < 1e-4
        p = 1 / (1 + np.exp(-(np.c_[X, np.ones(len(X))] @ want)))
        assert max(abs(scores[cell, k] - p[i]) for i, k in enumerate(keys) if held[i]) < 1e-4


def test_block_logistic_equals_spark_cell_by_cell(prepared):
    fs = CE.FeatureSet(NUM, (), FLAGS)
    together = CE.BlockLogistic(prepared, fs).coefficients()
    add = CE.features(prepared, fs)
    for cell in (0, 5):
        tr = add(prepared.train().where(F.col("cell") == cell).where("label_d IS NOT NULL"))
        total = tr.agg(F.sum("weight")).first()[0]
        alone = LogisticRegression(featuresCol="features", labelCol="label_d", weightCol="weight", maxIter=1000, regParam=1.0 / total, standardization=False, tol=1e-10).fit(tr)
        assert np.abs(np.array(together[cell][1]) - alone.coefficients.toArray()).max() < 1e-4
        assert abs(together[cell][2] - alone.intercept) < 1e-4


def test_user_weights_multiply_balanced_ones(frame, folds):
    a = frame.join(folds, "grp").withColumn("w", F.when(F.col("key") % 2 == 0, 0.0).otherwise(2.0))
    c = CE.prepare_cells(a, "key", "y", ["z"], weight="w")
    assert c.train().where("key % 2 = 0").agg(F.max("weight")).first()[0] == 0.0
    plain = CE.prepare_cells(a, "key", "y", ["z"])
    pairs = c.train().where("key % 2 = 1 AND label_d IS NOT NULL").select("cell", "key", F.col("weight").alias("v")).join(plain.train(), ["cell", "key"])
    assert pairs.where("abs(v - 2 * weight) > 1e-12").count() == 0


def test_listed_folds_only(frame, folds):
    c = CE.prepare_cells(frame.join(folds, "grp"), "key", "y", ["z"], test_folds=[1])
    assert [(r, f) for _, r, f in c.cells] == [(0, 1), (1, 1)]


# ---------------------------------------------------------------- forests


@pytest.fixture(scope="module")
def binned(frame, folds):
    return FO.bin_rows(frame, folds, "grp", "key", "y", NUM, CAT, FLAGS, keep=["cat"])


SMALL = FO.ForestSpec(trees=7, depth=4, min_leaf=5)


def plain_forest(binned, spec, frame, folds):
    """The same trees row by row: (score of each (rep, key))."""
    fs_names = [*NUM, "x_missing", *[f"cat_{i}" for i in range(4)]]
    pdf = frame.toPandas().sort_values("key").reset_index(drop=True)
    levels = sorted(pdf["cat"].dropna().unique())
    hashed = {r["key"]: r["h"] for r in frame.select("key", F.xxhash64("key").alias("h")).collect()}
    h = np.array([hashed[k] for k in pdf["key"]], np.int64).view(np.uint64)
    where = {(r["rep"], r["grp"]): r["fold"] for r in folds.collect()}
    tried = max(1, int(len(fs_names) ** 0.5))
    out = {}
    for cell, at, held in binned.cells:
        fold = np.array([where[binned.reps[at], g] for g in pdf["grp"]])
        y = pdf["y"].to_numpy(dtype=float, na_value=-1)
        train = (fold != held) & (y >= 0)
        cols = []
        for i, c in enumerate(NUM):
            v = pdf[c].to_numpy(dtype=float, na_value=np.nan)
            b = np.searchsorted(binned.edges[c], np.where(np.isnan(v), np.nanmedian(v[train]), v))
            cols.append(b)
        cols.append(pdf["x"].isna().to_numpy().astype(int))
        mode = pdf.loc[train, "cat"].value_counts()
        cat = pdf["cat"].fillna(min(mode[mode == mode.max()].index))
        cols += [(cat == lv).to_numpy().astype(int) for lv in levels]
        X = np.stack(cols, axis=1)
        n, n1 = train.sum(), int(y[train].sum())
        cw = (n / (2 * (n - n1)), n / (2 * n1))
        p = np.zeros(len(y))
        for t in range(spec.trees):
            tree = cell * spec.trees + t
            times = FO._bootstrap(h, np.array([tree]), spec.seed)[0].astype(int) * train

            # breadth first, as places of a depth count its nodes in order
            level = [(np.ones(len(y), bool), True)]
            for depth in range(spec.depth + 1):
                below = []
                for place, (mask, is_open) in enumerate(level):
                    c = np.array([(times * mask)[y == k].sum() for k in (0, 1)])
                    w = c * np.array(cw)
                    value = w[1] / w.sum() if w.sum() else 0.5
                    best = (1e-12, None, None)
                    whole = 2 * c[0] * cw[0] * c[1] * cw[1] / w.sum() if w.sum() else 0
                    if depth < spec.depth and is_open:
                        for f in FO._sampled(np.array([tree]), np.array([place]), depth, X.shape[1], tried, spec.seed)[0]:
                            for cut in range(spec.bins):
                                left = mask & (X[:, f] <= cut)
                                cl = np.array([(times * left)[y == k].sum() for k in (0, 1)])
                                cr = c - cl
                                if min(cl.sum(), cr.sum()) < spec.min_leaf:
                                    continue
                                g = sum(s * (2 * a[0] * cw[0] * a[1] * cw[1] / (a[0] * cw[0] + a[1] * cw[1])) for s, a in ((1, c), (-1, cl), (-1, cr)) if a.sum())
                                g = round(g / whole, 10) if whole else -1
                                if g > best[0]:
                                    best = (g, f, cut)
                    if best[1] is None:
                        p[mask] += value
                    else:
                        for side in (mask & (X[:, best[1]] <= best[2]), mask & (X[:, best[1]] > best[2])):
                            cs = np.array([(times * side)[y == k].sum() for k in (0, 1)])
                            below.append((side, cs.sum() >= 2 * spec.min_leaf and (cs > 0).all()))
                level = below
        for i in np.flatnonzero(fold == held):
            out[binned.reps[at], int(pdf["key"][i])] = p[i] / spec.trees
    return out


def test_forest_equals_row_by_row(frame, folds, binned):
    forest = FO.CellForests(binned, CE.FeatureSet(NUM, CAT, FLAGS), SMALL)
    got = {(r["rep"], r["key"]): r["p"] for r in forest.predict().collect()}
    want = plain_forest(binned, SMALL, frame, folds)
    assert got.keys() == want.keys() and len(got) == 600
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_forest_does_not_depend_on_blocks(frame, folds, binned, monkeypatch):
    fs = CE.FeatureSet(NUM, CAT, FLAGS)
    one = {(r["rep"], r["key"]): r["p"] for r in FO.CellForests(binned, fs, SMALL).predict().collect()}
    monkeypatch.setattr(FO, "BLOCK", 32)
    small = FO.bin_rows(frame.repartition(5), folds, "grp", "key", "y", NUM, CAT, FLAGS, keep=["cat"])
    assert small.blocks.where("part = 0").count() > 3
    many = {(r["rep"], r["key"]): r["p"] for r in FO.CellForests(small, fs, SMALL).predict().collect()}
    assert one == many


def test_contributions_sum_to_the_score(binned):
    fs = CE.FeatureSet(NUM, CAT, FLAGS)
    forest = FO.CellForests(binned, fs, SMALL)
    rows = forest.contributions().collect()
    assert len(rows) == 600 and all(len(r["contributions"]) == len(forest.names) for r in rows)
    assert max(abs(r["base"] + sum(r["contributions"]) - r["p"]) for r in rows) < 1e-9
    shares = {}
    for cell, name, share in forest.importances():
        shares.setdefault(cell, {})[name] = share
    assert all(abs(sum(s.values()) - 1) < 1e-9 for s in shares.values())
    # the planted signal is in z and x
    assert all(s["x"] + s["z"] > 0.6 for s in shares.values())


def test_node_table_gives_the_score(frame, binned):
    """Walking the stored nodes over raw values gives the forest's score of a row without gaps."""
    forest = FO.CellForests(binned, CE.FeatureSet(["z"], ["cat"]), SMALL)
    nodes = {}
    for r in forest.node_table().collect():
        nodes[r["depth"], r["node"]] = r
    raw = {r["key"]: r for r in frame.collect()}
    levels = sorted({r["cat"] for r in raw.values() if r["cat"] is not None})
    for r in forest.predict().where("cell = 2").collect():
        if raw[r["key"]]["cat"] is None:
            continue
        x = raw[r["key"]]
        p = 0.0
        for t in range(SMALL.trees):
            depth, node = 0, r["cell"] * SMALL.trees + t
            while (n := nodes[depth, node])["feature"] is not None:
                v = x["z"] if n["feature"] == "z" else float(levels.index(x["cat"]) == int(n["feature"][4:]))
                depth, node = depth + 1, n["left"] + (v > n["threshold"])
            p += n["value"] / SMALL.trees
        assert abs(p - r["p"]) < 1e-9


def test_forest_without_features_or_splits(frame, folds, binned):
    none = FO.CellForests(binned, CE.FeatureSet(), SMALL)
    assert {r["p"] for r in none.predict().collect()} == {0.5}
    stump = FO.CellForests(binned, CE.FeatureSet(["z"]), FO.ForestSpec(trees=3, depth=3, min_leaf=10_000))
    assert max(abs(r["p"] - 0.5) for r in stump.predict().collect()) < 0.2


def test_tasks_send_one_count_a_chunk(frame, folds, monkeypatch):
    """A task adds up the counts of its blocks: as many messages as groups, in narrow integers
    (before, one of every block, in four bytes)."""
    monkeypatch.setattr(FO, "BLOCK", 32)
    many = FO.bin_rows(frame.repartition(5), folds, "grp", "key", "y", NUM, CAT, FLAGS)
    assert many.blocks.where("part = 0").count() > 3
    forest = FO.CellForests(many, CE.FeatureSet(["z"], CAT), FO.ForestSpec(trees=3, depth=1, min_leaf=5))
    spark = many.blocks.sparkSession
    model = spark.sparkContext.broadcast(([], None, many.cells, many.medians, many.modes, forest._chunks(), forest.weights))
    sent = many.blocks.mapInArrow(forest._count(model, 0), "chunk int, counts binary")
    rows = sent.groupBy("chunk").agg(F.count("*").alias("n"), F.max(F.octet_length("counts")).alias("bytes")).collect()
    assert len(rows) == len(forest._chunks()) and {r["n"] for r in rows} == {1}
    assert max(r["bytes"] for r in rows) <= 3 * forest.tried * forest.spec.bins * 2 * 2
