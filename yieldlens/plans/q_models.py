"""Model queries: out-of-fold predictions of the five classifiers, the results table and seed
robustness, feature-set comparison, cohort sensitivity, within-unit increment, refits without a
unit, attribution and recalibration. All cells of a protocol share their preparation and, but for
k-NN, their fit (``operators.cells``, ``operators.forest``, ``operators.boosting``)."""

from __future__ import annotations

import dataclasses

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting as BO
from ..operators import casemix as CM
from ..operators import cells as CE
from ..operators import cohort as C
from ..operators import forest as FO
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import packed as PA
from ..operators import prep as PR
from ..operators import report as R
from ..operators import splits as SP
from ..session import cut_lineage
from ..sources import standins as S
from .q_cohort import _ORDERS_SQL
from .q_metrics import D, rnd
from .q_model_frame import _FRAME_SQL, _SPLIT_SQL, FEATURES, K, REPS, SEED, _folds_sql, frame
from .registry import query

SPEC = ML.FrameSpec(
    key="order_id", label="y", group="subject_id", numeric=[*FEATURES, "hour"], categorical=["unit"], missing_flags=FEATURES
)
NUMERIC = [*FEATURES, "hour", "is_repeat"]


def _set(numeric=(), categorical=()) -> CE.FeatureSet:
    return CE.FeatureSet(tuple(numeric), tuple(categorical), tuple(c for c in numeric if c in FEATURES))


MAIN = _set(SPEC.numeric, SPEC.categorical)
SETS = {
    "A_unit_only": _set((), ["unit"]),
    "B_context": _set(["hour", "is_repeat"], ["unit"]),
    "C_clinical": _set(FEATURES),
    "D_clinical_context": _set(NUMERIC, ["unit"]),
}
#: the stand-in for the predictors known from the literature
LITERATURE = _set(["view_max", "click_max", "hour"])
#: the reference's models and repeats of the feature-set comparison
COMPARATORS = ["logistic", "forest"]
#: the reference's model, repeats and least rows of the scores inside units
WITHIN_MODEL, WITHIN_REPS, WITHIN_ROWS = "forest", 5, 40
#: seeded 80/20 splits of the robustness check
SPLIT_SEEDS = 25


def _frame(spark, sf):
    """The modelling table, written once (checkpoint) so every fold reads it."""
    f = frame(spark, sf)
    o = C.repeat_flag(S.index_orders(spark, sf), ["subject_id", "hadm_id"], "t0", "order_id").select("order_id", "is_repeat")
    return cut_lineage(f.join(o, "order_id"))


class Protocol:
    """The cells of one table and its folds; their preparations are made when first asked for."""

    def __init__(self, f: DataFrame, folds: DataFrame, group: str = SPEC.group, test_folds=None):
        self.f, self.folds, self.group, self.test_folds = f, cut_lineage(folds), group, test_folds
        self._cells = self._binned = self._stored = None

    @property
    def cells(self) -> CE.Cells:
        if self._cells is None:
            assigned = SP.assign_folds(self.f, self.folds, self.group)
            self._cells = CE.prepare_cells(assigned, "order_id", "y", NUMERIC, ["unit"], FEATURES, keep=["unit"], test_folds=self.test_folds)
        return self._cells

    @property
    def stored(self) -> PA.PackedCells:
        """Rows stored once for all cells."""
        if self._stored is None:
            self._stored = PA.pack_cells(self.f, self.folds, self.group, "order_id", "y", NUMERIC, ["unit"], FEATURES, keep=["unit"], test_folds=self.test_folds)
        return self._stored

    @property
    def packed(self) -> PA.PackedCells | CE.Cells:
        """Rows stored once for all cells; the stacked table, where the levels are too many for second derivatives."""
        return self.stored if CE.narrow(self.stored.levels) else self.cells

    @property
    def binned(self) -> FO.BinnedRows:
        if self._binned is None:
            self._binned = FO.bin_rows(self.f, self.folds, self.group, "order_id", "y", NUMERIC, ["unit"], FEATURES, keep=["unit"], test_folds=self.test_folds)
        return self._binned

    def scores(self, model: str, fs: CE.FeatureSet) -> DataFrame:
        """(rep, fold, order_id, unit, y, p, class): every row once by each cell that held it out."""
        if model == "forest":
            out = FO.CellForests(self.binned, fs).predict()
        elif model == "logistic":
            out = CE.BlockLogistic(self.packed, fs).predict(self.packed.test())
        elif model == "rff_svm":
            out = CE.BlockSvm(self.packed, fs).predict(self.packed.test())
        elif model == "boosting":
            out = BO.PackedBoosting(self.stored, fs).predict()
        else:
            out = CE.fit_each(self.cells, fs, lambda train: ML.MODELS[model](SPEC).fit(train), reread=model != "knn")
        if "class" not in out.columns:
            out = out.withColumn("class", (F.col("p") >= 0.5).cast("int"))
        return cut_lineage(out.select("rep", "fold", "order_id", "unit", F.col("label_d").cast("int").alias("y"), "p", "class"))


def _kfold(f: DataFrame, reps: int) -> Protocol:
    return Protocol(f, SP.grouped_kfold(f, SPEC.group, SPEC.label, K, reps))


def _oof(spark, sf, model: str):
    """One repeat, as the reference's out-of-fold scores have."""
    return _kfold(_frame(spark, sf), 1).scores(model, MAIN)


def _oof_query(model: str, doc: str):
    def fn(spark, sf):
        return rnd(_oof(spark, sf, model).drop("unit", "class"), 6)

    fn.__doc__ = doc
    return fn


for _name, _model, _doc in [
    ("lr_oof", "logistic", "Out-of-fold logistic regression (L2, balanced weights), 5 grouped folds."),
    ("rf_oof", "forest", "Out-of-fold random forest (300 trees, depth 8, min leaf 15, balanced)."),
    ("gbt_oof", "boosting", "Out-of-fold gradient-boosted trees (300 × depth 4, step 0.05)."),
    ("rff_svm_oof", "rff_svm", "Out-of-fold RBF-SVM approximation (random Fourier features + linear SVM + Platt)."),
    ("knn_oof", "knn", "Out-of-fold exact 5-nearest-neighbour vote on the prepared features."),
]:
    query(_name)(_oof_query(_model, _doc))

_COVER_SQL = f"""SELECT f.rep, f.fold, o.unit, count(*) AS n_scores, count(DISTINCT o.order_id) AS n_orders, CAST(sum(o.y) AS BIGINT) AS n_pos,
  0 AS n_outside FROM {_ORDERS_SQL} o JOIN {_folds_sql(_ORDERS_SQL, "subject_id", REPS)} f USING (subject_id) GROUP BY f.rep, f.fold, o.unit"""


def _cover(spark, sf, model: str):
    scored = _kfold(_frame(spark, sf), REPS).scores(model, SETS["D_clinical_context"])
    outside = F.count_if(F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1))
    return scored.groupBy("rep", "fold", "unit").agg(
        F.count("*").alias("n_scores"), F.countDistinct("order_id").alias("n_orders"), F.sum("y").alias("n_pos"), outside.cast("int").alias("n_outside")
    )


@query("logistic_cover", _COVER_SQL)
def logistic_cover(spark, sf):
    """Cover of the 20 × 5 logistic cells: each order scored once a repeat, by the fold that held it
    out, with a probability."""
    return _cover(spark, sf, "logistic")


@query("forest_cover", _COVER_SQL)
def forest_cover(spark, sf):
    """Cover of the 20 × 5 forest cells."""
    return _cover(spark, sf, "forest")


_GRADIENT_SQL = f"""WITH f AS {_FRAME_SQL}, folds AS {_folds_sql(_ORDERS_SQL, "subject_id", REPS)},
    u AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS i FROM (SELECT DISTINCT unit FROM f WHERE unit IS NOT NULL)),
    names AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in [*NUMERIC, *[f"{c}_missing" for c in FEATURES], "(intercept)"]) + f"""
      UNION ALL SELECT 'unit_' || i FROM u)
    SELECT c.rep, c.fold, n.feature, 0.0::DOUBLE AS gradient FROM (SELECT DISTINCT rep, fold FROM folds) c, names n"""


@query("logistic_gradients", _GRADIENT_SQL)
def logistic_gradients(spark, sf):
    """Gradient of every cell's own penalised objective at the coefficients of the joint fit, per
    training row and to two decimals: zero, as each cell's fit is its own minimum."""
    cells = _kfold(_frame(spark, sf), REPS).packed
    at = spark.createDataFrame(cells.cells, "cell int, rep int, fold int")  # a row a cell
    size = cells.sizes()
    g = CE.BlockLogistic(cells, SETS["D_clinical_context"]).gradients().join(F.broadcast(at), "cell").join(F.broadcast(size), "cell")
    # + 0.0 turns a negative zero
    return g.select("rep", "fold", "feature", (F.round(F.col("gradient") / F.sqrt("n"), 2) + F.lit(0.0)).alias("gradient"))


@query(
    "knn_score",
    f"""WITH e AS (SELECT vec_id AS key, embedding, CAST(label < 3 AS INTEGER) AS y FROM embeddings),
    s AS (SELECT key, r <= ceil(g * 0.2) AS is_test FROM (SELECT key, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(key AS VARCHAR)), key) AS r,
      count(*) OVER () AS g FROM e)),
    tr AS (SELECT e.* FROM e JOIN s USING (key) WHERE NOT is_test), te AS (SELECT e.* FROM e JOIN s USING (key) WHERE is_test),
    d AS (SELECT te.key, tr.key AS tkey, tr.y AS ty,
      list_distance(CAST(te.embedding AS DOUBLE[]), CAST(tr.embedding AS DOUBLE[])) AS dist FROM te, tr),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, tkey) AS rn FROM d)
    SELECT key, round(avg(ty), 6) AS p FROM r WHERE rn <= 5 GROUP BY key""",
)
def knn_score(spark, sf):
    """Exact 5-NN vote on the embedding vectors: train = 80 % of vectors (seeded),
    score = share of positive neighbours for each held-out vector."""
    v = S.vectors(spark, sf).withColumn("label_d", F.col("y").cast("double"))
    split = SP.group_split(v, "key", 0.2, SEED)
    j = v.join(split, "key")
    predict = ML.ExactKnn(5, key="key", vec="embedding").fit(j.where("is_test = 0"))
    return rnd(predict(j.where("is_test = 1")).select("key", "p"), 6)


@query("permutation_importance")
def permutation_importance(spark, sf):
    """AUROC drop of the held-out logistic model when each input is permuted."""
    f = _frame(spark, sf).withColumn("label_d", F.col("y").cast("double"))
    split = SP.group_split(f, "subject_id", 0.2, SEED)
    j = f.join(split, "subject_id")
    tr, te, names = ML.prepare(j.where("is_test = 0"), j.where("is_test = 1"), SPEC)
    predict = ML.MODELS["logistic"](SPEC).fit(tr.cache())
    te = cut_lineage(te)
    return rnd(ML.permutation_importance(predict, te, "y", SPEC.numeric, names, "order_id"), 6)


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    """Platt and isotonic recalibration of the out-of-fold logistic scores, each fold
    mapped by calibrators fitted on the other folds."""
    oof = _oof(spark, sf, "logistic").drop("unit", "class")
    platt = ML.calibrate(oof, "y", "p", "platt").select("order_id", F.col("p_cal").alias("p_platt"))
    iso = ML.calibrate(oof, "y", "p", "isotonic").select("order_id", F.col("p_cal").alias("p_isotonic"))
    return rnd(oof.join(platt, "order_id").join(iso, "order_id"), 6)


def _ranked(parts: dict[tuple, DataFrame], names: list[str]) -> DataFrame:
    """AUROC and average precision of every (rep, fold) of several score tables, one curve job."""
    tables = [df.withColumns({n: F.lit(v) for n, v in zip(names, key, strict=True)}) for key, df in parts.items()]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return cut_lineage(M.ranking_metrics(both, "y", "p", [*names, "rep", "fold"]))


def _mean_ranges(per: DataFrame, metrics: dict[str, str], by: list[str]) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of each metric over the cells."""
    out = None
    for col, name in metrics.items():
        m = M.mean_ci(per, col, by).select(*by, F.col("mean").alias(f"{name}_mean"), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
        out = m if out is None else out.join(m, by)
    return out


def _compare(f: DataFrame, sets: dict[str, CE.FeatureSet], models=COMPARATORS) -> DataFrame:
    p = _kfold(f, REPS)
    scores = {(name, model): p.scores(model, fs) for name, fs in sets.items() for model in models}
    per = _ranked(scores, ["feature_set", "model"])
    return rnd(_mean_ranges(per, {"auroc": "auroc", "average_precision": "auprc"}, ["feature_set", "model"]), 6)


@query("ablation_summary")
def ablation_summary(spark, sf):
    """Feature-set comparison (unit only / context / clinical / both) under the
    grouped CV protocol (20 × 5), logistic model and forest: AUROC and AUPRC mean and range."""
    return _compare(_frame(spark, sf), SETS)


@query("cohort_sensitivity")
def cohort_sensitivity(spark, sf):
    """The feature-set comparison rerun without the listed units."""
    return _compare(_frame(spark, sf).where(~F.col("unit").isin("unit0", "unit1", "unit2")), SETS)


@query("literature_vs_full")
def literature_vs_full(spark, sf):
    """Literature predictors alone against the full set, 20 × 5."""
    return _compare(_frame(spark, sf), {"literature": LITERATURE, "full": SETS["D_clinical_context"]})


@query("within_unit_increment")
def within_unit_increment(spark, sf):
    """Within-unit AUROC of the clinical model minus the context-only model, for
    units with enough rows (pooled predictions of the forest, 5 repeats, scored inside each unit)."""
    p = _kfold(_frame(spark, sf), WITHIN_REPS)
    res = {}
    for name in ("B_context", "C_clinical"):
        oof = p.scores(WITHIN_MODEL, SETS[name])
        res[name] = CM.within_stratum(oof, "unit", "y", "p", "rep", WITHIN_ROWS).select(
            "unit", "n_rows", F.col("auroc_mean").alias(f"auroc_{name}")
        )
    j = res["C_clinical"].join(res["B_context"].drop("n_rows"), "unit")
    return rnd(j.withColumn("increment", F.col("auroc_C_clinical") - F.col("auroc_B_context")), 6)


#: the reference's five models; the results table leaves boosting to gbt_oof (README)
TABLE_MODELS = ["logistic", "forest", "boosting", "rff_svm", "knn"]
RESULT_MODELS = [m for m in TABLE_MODELS if m != "boosting"]


def _all_metrics(scores: dict[str, DataFrame]) -> DataFrame:
    """model, rep, fold, auroc, average_precision, accuracy (of the model's own class), brier."""
    both = None
    for name, df in scores.items():
        t = df.withColumn("model", F.lit(name))
        both = t if both is None else both.unionByName(t)
    by = ["model", "rep", "fold"]
    ranked = M.ranking_metrics(both, "y", "p", by).select(*by, "auroc", "average_precision")
    plain = both.groupBy(*by).agg(
        F.avg((F.col("class") == F.col("y")).cast("double")).alias("accuracy"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")
    )
    return cut_lineage(ranked.join(plain, by))


METRICS = {"auroc": "auroc", "average_precision": "auprc", "accuracy": "accuracy", "brier": "brier"}


@query("model_results")
def model_results(spark, sf):
    """Results table: models × AUROC, AUPRC, accuracy at the model's own cut and Brier score, mean
    and 95 % range over 20 × 5 grouped cells."""
    p = _kfold(_frame(spark, sf), REPS)
    return rnd(_mean_ranges(_all_metrics({m: p.scores(m, MAIN) for m in RESULT_MODELS}), METRICS, ["model"]), 6)


@query("model_seed_robustness")
def model_seed_robustness(spark, sf):
    """25 seeded patient-grouped 80/20 splits, each refitted: AUROC mean, population deviation, least
    and greatest, and AUPRC mean per model."""
    f = _frame(spark, sf)
    folds = None
    for seed in range(SPLIT_SEEDS):
        one = SP.group_split(f, SPEC.group, 0.2, seed).select(F.lit(seed).alias("rep"), SPEC.group, F.col("is_test").alias("fold"))
        folds = one if folds is None else folds.unionByName(one)
    p = Protocol(f, folds, test_folds=[1])
    per = _all_metrics({m: p.scores(m, MAIN) for m in TABLE_MODELS})
    return rnd(per.groupBy("model").agg(
        F.count("auroc").alias("n_splits"), F.avg("auroc").alias("auroc_mean"), F.stddev_pop("auroc").alias("auroc_std"),
        F.min("auroc").alias("auroc_min"), F.max("auroc").alias("auroc_max"), F.avg("average_precision").alias("auprc_mean"),
    ), 6)


@query("leave_one_unit_out_refit")
def leave_one_unit_out_refit(spark, sf):
    """Each eligible unit scored by a forest and a logistic model fitted on all other units:
    n, positive rate, AUROC and AUPRC per held-out unit."""
    f = _frame(spark, sf).where(F.col("unit").isNotNull())
    place = cut_lineage(CE.level_index(f, "unit"))
    folds = place.select(F.lit(0).alias("rep"), "unit", F.col("unit_ix").alias("fold"))
    gate = SP.stratum_gate(f, "unit", "y", 40).where("eligible = 1").join(place, "unit")
    held = [r["unit_ix"] for r in gate.select("unit_ix").collect()]  # units
    p = Protocol(f, folds, "unit", test_folds=held)
    out = None
    for model in COMPARATORS:
        m = CM.holdout_metrics(p.scores(model, SETS["C_clinical"]), "unit", "y", "p", 40).withColumn("model", F.lit(model))
        out = m if out is None else out.unionByName(m)
    return rnd(out, 6)


@query("flag_chain")
def flag_chain(spark, sf):
    """The flag on real out-of-fold scores of the forest: operating point at 95 % sensitivity, and net
    benefit of the model and of scanning all at the published thresholds, as (step, x, name, value)."""
    oof = _oof(spark, sf, "forest")
    point = M.operating_point(oof, "y", "p", 0.95)
    fields = [c for c in point.columns if c != "threshold"]
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in fields])
    a = point.select(F.lit("operating_point").alias("step"), F.col("threshold").cast("double").alias("x"), F.explode(rows).alias("r"))
    nb = M.net_benefit(oof, "y", "p", [0.05, 0.1, 0.15, 0.2, 0.3])
    grid = [c for c in nb.columns if c.startswith("pt") or c == "threshold"][0]
    values = [c for c in nb.columns if c != grid]
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in values])
    b = nb.select(F.lit("net_benefit").alias("step"), F.col(grid).cast("double").alias("x"), F.explode(rows).alias("r"))
    return rnd(a.unionByName(b).select("step", "x", "r.name", "r.value"), 6)


@query("tree_attribution")
def tree_attribution(spark, sf):
    """Path contributions of the out-of-fold forest: per feature the mean and mean absolute
    contribution over all orders, its share of the Gini decrease, and the largest gap between base
    plus contributions and the score (zero)."""
    p = _kfold(_frame(spark, sf), 1)
    forest = FO.CellForests(p.binned, MAIN)
    names = F.array(*[F.lit(n) for n in forest.names])
    rows = cut_lineage(forest.contributions())
    gap = rows.agg(F.max(F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) - F.col("p"))).alias("gap"))
    long = rows.select(F.explode(F.arrays_zip(names.alias("feature"), F.col("contributions").alias("c"))).alias("z")).select("z.feature", "z.c")
    mean = long.groupBy("feature").agg(F.avg("c").alias("mean_contribution"), F.avg(F.abs("c")).alias("mean_absolute"))
    share = spark.createDataFrame(forest.importances(), "cell int, feature string, share double")  # a row a cell and feature
    share = share.groupBy("feature").agg(F.avg("share").alias("importance"))
    return rnd(ML.with_scalars(mean.join(share, "feature"), gap), 6)


@query("resampling_compare")
def resampling_compare(spark, sf):
    """Class imbalance handled by balanced weights vs by down-sampling the majority
    class in each training fold (logistic model): fold AUROC / AUPRC means."""
    f = cut_lineage(_frame(spark, sf).withColumn("_row", F.monotonically_increasing_id()))
    folds = cut_lineage(SP.grouped_kfold(f, SPEC.group, SPEC.label, K, 1))
    # the rows that each cell keeps: a narrow table, a row a training row and cell
    table, _ = CE.cell_table(folds)
    train = SP.assign_folds(f.select("_row", "order_id", SPEC.group, F.col("y").cast("double").alias("label_d")), folds, SPEC.group)
    train = train.join(F.broadcast(table), "rep").where("fold <> _held AND label_d IS NOT NULL")
    kept = ML.downsample_majority(train, "label_d", "order_id", by=["cell"]).groupBy("_row").agg(F.collect_list("cell").alias("kept"))
    f = cut_lineage(f.join(kept, "_row", "left"))
    cells = PA.pack_cells(f, folds, SPEC.group, "order_id", "y", NUMERIC, ["unit"], FEATURES, keep=["unit"], chosen="kept")
    both = {"weights": cells, "downsample": dataclasses.replace(cells, chosen=True)}
    if not CE.narrow(cells.levels):
        own = CE.prepare_cells(SP.assign_folds(f, folds, SPEC.group), "order_id", "y", NUMERIC, ["unit"], FEATURES, keep=["unit", "kept"])
        less = own.rows.where("is_test = 1 OR array_contains(kept, cell)").withColumn("weight", F.lit(1.0))
        both = {"weights": own, "downsample": dataclasses.replace(own, rows=cut_lineage(less))}
    parts = {}
    for name, variant in both.items():
        scores = CE.BlockLogistic(variant, MAIN).predict(variant.test())
        parts[(name,)] = cut_lineage(scores.select("rep", "fold", "p", F.col("label_d").cast("int").alias("y")))
    m = _ranked(parts, ["variant"])
    return rnd(m.groupBy("variant").agg(F.avg("auroc").alias("auroc_mean"), F.avg("average_precision").alias("auprc_mean")), 6)


@query("impute_vs_drop_refit")
def impute_vs_drop_refit(spark, sf):
    """Inputs with too many missing values dropped at several thresholds, the rest imputed, and the
    logistic model refitted on each: inputs kept, AUROC and AUPRC over 5 grouped folds."""
    f = _frame(spark, sf)
    p = _kfold(f, 1)
    scores, at = {}, []
    for t in (0.1, 0.3, 0.5, 0.7, 0.9):
        left = PR.drop_sparse(f.select(*FEATURES, "hour"), t, keep=["hour"]).columns
        at.append((t, len(left), ",".join(left)))
        if (at[-1][2],) not in scores:
            scores[(at[-1][2],)] = p.scores("logistic", _set(left, ["unit"]))
    m = _ranked(scores, ["inputs"]).groupBy("inputs").agg(F.avg("auroc").alias("auroc_mean"), F.avg("average_precision").alias("auprc_mean"))
    at = spark.createDataFrame(at, "threshold double, n_inputs int, inputs string")  # a row a threshold
    return rnd(at.join(m, "inputs").drop("inputs"), 6)


@query("dirty_vs_clean_refit")
def dirty_vs_clean_refit(spark, sf):
    """The logistic model refitted out of fold on a dirty and on a clean label version: the orders that
    only one of the two flags, with both scores and thresholds (the stand-in's clean labels turn
    every tenth order)."""
    f = _frame(spark, sf)
    clean = f.withColumn("y", F.when(F.pmod(F.xxhash64("order_id"), F.lit(10)) == 0, 1 - F.col("y")).otherwise(F.col("y")))
    folds = SP.grouped_kfold(f, SPEC.group, SPEC.label, K, 1)
    dirty_scores, clean_scores = (Protocol(t, folds).scores("logistic", MAIN) for t in (f, cut_lineage(clean)))
    out = R.flagged_by_one(dirty_scores, clean_scores, "order_id")
    who = F.when(F.col("flagged_by") == "a", "dirty").otherwise("clean")
    out = out.withColumns({"flagged_by": who}).withColumnsRenamed({f"{c}_{x}": f"{c}_{n}" for c in ("p", "threshold") for x, n in (("a", "dirty"), ("b", "clean"))})
    return rnd(out, 6)


@query("soft_label_fit")
def soft_label_fit(spark, sf):
    """Logistic out-of-fold scores trained on soft labels (the mean of two raters, disagreement down to
    half weight) next to those trained on the first rater alone."""
    f = _frame(spark, sf)
    second = F.when(F.pmod(F.xxhash64("order_id"), F.lit(10)) == 0, 1 - F.col("y")).otherwise(F.col("y"))
    f = f.withColumns({"soft": (F.col("y") + second) / 2, "trust": F.when(F.col("y") == second, 1.0).otherwise(0.5)})
    assigned = SP.assign_folds(f, SP.grouped_kfold(f, SPEC.group, SPEC.label, K, 1), SPEC.group)
    cells = CE.prepare_cells(assigned, "order_id", "soft", NUMERIC, ["unit"], FEATURES, keep=["y"], weight="trust", soft=True)
    soft = CE.BlockLogistic(cells, MAIN).predict(cells.test()).select("order_id", "y", F.col("p").alias("p_soft"))
    hard = CE.prepare_cells(assigned, "order_id", "y", NUMERIC, ["unit"], FEATURES)
    plain = CE.BlockLogistic(hard, MAIN).predict(hard.test()).select("order_id", F.col("p").alias("p_hard"))
    return rnd(soft.join(plain, "order_id"), 6)


@query("knn_index_recall")
def knn_index_recall(spark, sf):
    """Recall at 5 of the coarse-cell index (a list for 64 vectors, 16 probed) against the exact
    neighbours, over all held-out vectors."""
    v = S.vectors(spark, sf).withColumn("label_d", F.col("y").cast("double"))
    j = cut_lineage(v.join(SP.group_split(v, "key", 0.2, SEED), "key"))
    train, test = j.where("is_test = 0"), j.where("is_test = 1")
    exact = ML.ExactKnn(5, key="key", vec="embedding").neighbours_of(train)(test).select("key", "_tkey")
    index = ML.CoarseKnn(5, key="key", vec="embedding", probes=16, rows=64).neighbours_of(train)(test).select("key", "_tkey", F.lit(1).alias("found"))
    met = exact.join(index, ["key", "_tkey"], "left")
    return rnd(met.agg(F.countDistinct("key").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("found") / F.count("*")).alias("recall")), 6)


_NUM = [*FEATURES, "hour"]
_ASSEMBLED_SQL = (
    f"""WITH f AS {_FRAME_SQL}, s AS {_SPLIT_SQL},
    tr AS (SELECT f.* FROM f JOIN s USING (subject_id) WHERE s.is_test = 0),
    m AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _NUM) + """ FROM tr),
    i AS (SELECT f.order_id, f.subject_id, f.unit, """
    + ", ".join(f"coalesce(CAST(f.{c} AS DOUBLE), m.{c}) AS {c}" for c in _NUM) + ", "
    + ", ".join(f"CAST(f.{c} IS NULL AS INTEGER) AS {c}_missing" for c in FEATURES)
    + """ FROM f, m),
    st AS (SELECT """ + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _NUM)
    + """ FROM i JOIN s USING (subject_id) WHERE s.is_test = 0),
    lv AS (SELECT DISTINCT unit FROM tr WHERE unit IS NOT NULL)
    """
    + " UNION ALL ".join(
        f"SELECT order_id, '{c}' AS feature, round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1.0 ELSE sd_{c} END, 6) AS value FROM i, st"
        for c in _NUM
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT order_id, '{c}_missing' AS feature, CAST({c}_missing AS DOUBLE) AS value FROM i" for c in FEATURES)
    + " UNION ALL SELECT i.order_id, 'unit_' || lv.unit AS feature, CAST(coalesce(i.unit = lv.unit, false) AS DOUBLE) AS value FROM i, lv"
)


@query("assembled_features", _ASSEMBLED_SQL)
def assembled_features(spark, sf):
    """The model input vector of every order (preparation fitted on the training
    patients: imputed and standardised numerics, missing flags, one-hot unit),
    exploded to (order_id, feature, value) with the assembler's feature names."""
    f = frame(spark, sf).withColumn("label_d", F.col("y").cast("double"))
    split = SP.group_split(f, "subject_id", 0.2, SEED)
    train = f.join(split.where("is_test = 0"), "subject_id")
    _, all_rows, names = ML.prepare(train, f, SPEC)
    arr = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), vector_to_array("features").alias("value"))
    long = all_rows.select("order_id", F.explode(arr).alias("z")).select("order_id", F.col("z.feature").alias("feature"),
                                                                        F.col("z.value").alias("value"))
    return long.withColumn("value", F.round("value", 6))
