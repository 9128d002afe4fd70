"""Splits, modelling-frame preparation and case-mix queries on the index orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import casemix as CM
from ..operators import cohort as C
from ..operators import lookback as L
from ..operators import prep as PR
from ..operators import splits as SP
from ..session import cut_lineage
from ..sources import standins as S
from .q_cohort import _ORDERS_SQL
from .q_lookback import _M, H24
from .q_metrics import D, SD, rnd
from .registry import query

ITEMS = ("click", "view", "purchase", "signup")
FEATURES = ["view_min", "view_max", "purchase_max", "click_max", "signup_min"]
K, REPS, SEED = 5, 20, 42


def frame(spark, sf):
    """Index orders + 24 h look-back features + hour of day: the modelling frame."""
    o = S.index_orders(spark, sf).select("order_id", "subject_id", "stay_id", "unit", "t0", "y")
    pairs = L.lookback_pairs(o, S.measurements(spark, sf), "stay_id", "t0", "ts", H24, items=ITEMS)
    wide = L.lookback_wide(o, pairs, ["order_id"], "itemid", "value", ITEMS)
    return o.join(wide, "order_id").select(
        "order_id", "subject_id", "unit", F.hour("t0").alias("hour"), "y", *FEATURES
    )


_FRAME_SQL = f"""(SELECT o.order_id, o.subject_id, o.unit, CAST(hour(o.t0) AS INTEGER) AS hour, o.y,
  min(CASE WHEN m.itemid = 'view' THEN m.value END) AS view_min, max(CASE WHEN m.itemid = 'view' THEN m.value END) AS view_max,
  max(CASE WHEN m.itemid = 'purchase' THEN m.value END) AS purchase_max, max(CASE WHEN m.itemid = 'click' THEN m.value END) AS click_max,
  min(CASE WHEN m.itemid = 'signup' THEN m.value END) AS signup_min
  FROM {_ORDERS_SQL} o LEFT JOIN {_M} m ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '24 hours' AND m.ts < o.t0
  GROUP BY o.order_id, o.subject_id, o.unit, o.t0, o.y)"""

_SPLIT_SQL = f"""(SELECT subject_id, CAST(r <= ceil(g * 0.2) AS INTEGER) AS is_test FROM (
  SELECT subject_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(subject_id AS VARCHAR)), subject_id) AS r,
    count(*) OVER () AS g FROM (SELECT DISTINCT subject_id FROM {_ORDERS_SQL} WHERE subject_id IS NOT NULL)))"""


def _folds_sql(src: str, group: str, reps: int, k: int = K) -> str:
    return f"""(SELECT CAST(rep AS INTEGER) AS rep, {group}, CAST((row_number() OVER (PARTITION BY rep, npos, n
      ORDER BY md5(CAST(rep AS VARCHAR) || ':' || CAST({group} AS VARCHAR)), {group}) - 1 + npos + n) % {k} AS INTEGER) AS fold
    FROM (SELECT {group}, CAST(sum(y) AS BIGINT) AS npos, count(*) AS n FROM {src} WHERE {group} IS NOT NULL GROUP BY {group}) gs,
      range(0, {reps}) r(rep))"""


def _split(spark, sf):
    return SP.group_split(S.index_orders(spark, sf), "subject_id", 0.2, SEED)


@query("group_split", f"SELECT * FROM {_SPLIT_SQL}")
def group_split(spark, sf):
    """Patient-grouped holdout: 20 % of patients (seeded hash order) are test."""
    return _split(spark, sf)


@query("grouped_kfold", f"SELECT * FROM {_folds_sql(_ORDERS_SQL, 'subject_id', REPS)}")
def grouped_kfold(spark, sf):
    """20 × 5 stratified group k-fold assignment of patients."""
    return SP.grouped_kfold(S.index_orders(spark, sf), "subject_id", "y", K, REPS)


@query(
    "leakage_check",
    f"""SELECT count(*) AS n_group_reps, count(*) FILTER (WHERE nf > 1) AS n_leaking FROM (
      SELECT f.rep, o.subject_id, count(DISTINCT f.fold) AS nf FROM {_ORDERS_SQL} o
      JOIN {_folds_sql(_ORDERS_SQL, 'subject_id', REPS)} f USING (subject_id) GROUP BY f.rep, o.subject_id)""",
)
def leakage_check(spark, sf):
    """Every patient in exactly one fold per repetition (n_leaking must be 0)."""
    o = S.index_orders(spark, sf)
    assigned = SP.assign_folds(o, SP.grouped_kfold(o, "subject_id", "y", K, REPS), "subject_id")
    return SP.leakage(assigned, "subject_id")


@query(
    "fold_balance",
    f"""SELECT f.rep, f.fold, count(*) AS n, round(avg(CAST(o.y AS DOUBLE)), {D}) AS positive_rate FROM {_ORDERS_SQL} o
      JOIN {_folds_sql(_ORDERS_SQL, 'subject_id', REPS)} f USING (subject_id) GROUP BY f.rep, f.fold""",
)
def fold_balance(spark, sf):
    """Rows and prevalence per (rep, fold) of the grouped assignment."""
    o = S.index_orders(spark, sf)
    assigned = SP.assign_folds(o, SP.grouped_kfold(o, "subject_id", "y", K, REPS), "subject_id")
    return rnd(SP.fold_balance(assigned, "y"))


@query(
    "stratified_row_split",
    f"""SELECT key, y, CAST(r <= ceil(nc * 0.2) AS INTEGER) AS is_test FROM (
      SELECT key, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || CAST(key AS VARCHAR)), key) AS r,
        count(*) OVER (PARTITION BY y) AS nc FROM {SD})""",
)
def stratified_row_split(spark, sf):
    """Row-level per-class split (leaky across patients; for comparison only)."""
    return SP.stratified_row_split(S.scored_docs(spark, sf), "key", "y", 0.2, SEED)


@query(
    "leave_one_out_strata",
    f"""SELECT unit, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(CAST(y AS DOUBLE)), {D}) AS positive_rate,
      CAST(count(*) >= 40 AND sum(y) > 0 AND sum(y) < count(*) AS INTEGER) AS eligible
    FROM {_ORDERS_SQL} WHERE unit IS NOT NULL GROUP BY unit""",
)
def leave_one_out_strata(spark, sf):
    """Strata eligible to be held out / scored alone (n ≥ 40, both classes)."""
    return rnd(SP.stratum_gate(S.index_orders(spark, sf), "unit", "y", 40))


@query(
    "prevalence_by_unit",
    f"SELECT unit, count(*) AS n, round(avg(CAST(y AS DOUBLE)), {D}) AS positive_rate FROM {_ORDERS_SQL} "
    "WHERE unit IS NOT NULL GROUP BY unit ORDER BY positive_rate DESC, unit",
)
def prevalence_by_unit(spark, sf):
    """Positive rate per stratum, highest first."""
    return rnd(CM.prevalence(S.index_orders(spark, sf), "unit", "y"))


_REPEAT_SQL = f"""(SELECT *, CASE WHEN row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY t0, order_id) > 1
  THEN 1 ELSE 0 END AS is_repeat FROM {_ORDERS_SQL})"""


@query(
    "prevalence_by_repeat",
    f"""SELECT is_repeat, count(*) AS n, round(avg(CAST(y AS DOUBLE)), {D}) AS positive_rate FROM {_REPEAT_SQL}
    GROUP BY is_repeat""",
)
def prevalence_by_repeat(spark, sf):
    """Positive rate of first vs repeat orders within an admission."""
    o = C.repeat_flag(S.index_orders(spark, sf), ["subject_id", "hadm_id"], "t0", "order_id")
    return rnd(CM.prevalence(o, "is_repeat", "y"))


@query(
    "repeat_rate_difference",
    f"""SELECT round(avg(CASE WHEN is_repeat = 0 THEN CAST(y AS DOUBLE) END), {D}) AS rate_a,
      round(avg(CASE WHEN is_repeat = 1 THEN CAST(y AS DOUBLE) END), {D}) AS rate_b,
      round(avg(CASE WHEN is_repeat = 1 THEN CAST(y AS DOUBLE) END) - avg(CASE WHEN is_repeat = 0 THEN CAST(y AS DOUBLE) END), {D})
        AS difference FROM {_REPEAT_SQL}""",
)
def repeat_rate_difference(spark, sf):
    """Repeat minus first-order positive rate."""
    o = C.repeat_flag(S.index_orders(spark, sf), ["subject_id", "hadm_id"], "t0", "order_id")
    return rnd(CM.rate_difference(o, "is_repeat", "y", 0, 1))


_OOF_REPS = 5


def _oof_sql(feature: str) -> str:
    return f"""(WITH a AS (SELECT f.rep, f.fold, o.* FROM {_ORDERS_SQL} o
        JOIN {_folds_sql(_ORDERS_SQL, 'subject_id', _OOF_REPS)} f USING (subject_id)),
      cell AS (SELECT rep, fold, {feature} AS lv, count(*) AS n, sum(y) AS pos FROM a GROUP BY rep, fold, {feature}),
      lvl AS (SELECT rep, lv, sum(n) AS nn, sum(pos) AS pp FROM cell GROUP BY rep, lv),
      fl AS (SELECT rep, fold, sum(n) AS nf, sum(pos) AS pf FROM cell GROUP BY rep, fold),
      rp AS (SELECT rep, sum(n) AS nr, sum(pos) AS pr FROM cell GROUP BY rep),
      fit AS (SELECT c.rep, c.fold, c.lv, CASE WHEN l.nn - c.n > 0 THEN (l.pp - c.pos) / (l.nn - c.n)
                ELSE (r.pr - f.pf) / (r.nr - f.nf) END AS p
              FROM cell c JOIN lvl l USING (rep, lv) JOIN fl f USING (rep, fold) JOIN rp r USING (rep))
    SELECT a.rep, a.order_id, a.fold, a.unit, a.y, fit.p FROM a JOIN fit ON a.rep = fit.rep AND a.fold = fit.fold
      AND a.{feature} = fit.lv)"""


def _oof(spark, sf, feature: str):
    """Stacked out-of-fold scores, written once: every metric reads them again."""
    o = S.index_orders(spark, sf).withColumn("hour", F.hour("t0"))
    assigned = SP.assign_folds(o, SP.grouped_kfold(o, "subject_id", "y", K, _OOF_REPS), "subject_id")
    return cut_lineage(CM.oof_target_mean(assigned, feature, "y"))


@query(
    "oof_unit_prevalence",
    f"SELECT rep, order_id, fold, y, round(p, {D}) AS p FROM {_oof_sql('unit')}",
)
def oof_unit_prevalence(spark, sf):
    """Out-of-fold "stratum only" baseline score (train-fold prevalence of the
    order's unit), 5 reps × 5 grouped folds; one score per (rep, order)."""
    return rnd(_oof(spark, sf, "unit").select("rep", "order_id", "fold", "y", "p"))


_WITHIN_SQL = f"""
WITH preds AS {_oof_sql('hour').replace('SELECT f.rep, f.fold, o.* FROM ' + _ORDERS_SQL + ' o', 'SELECT f.rep, f.fold, o.*, CAST(hour(o.t0) AS INTEGER) AS hour FROM ' + _ORDERS_SQL + ' o')},
pts AS (SELECT rep, unit, p, sum(y) AS tp, count(*) - sum(y) AS fp FROM preds GROUP BY rep, unit, p
        UNION ALL SELECT rep, '(pooled)' AS unit, p, sum(y), count(*) - sum(y) FROM preds GROUP BY rep, p),
c AS (SELECT *, sum(tp) OVER (PARTITION BY rep, unit ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ct,
                sum(fp) OVER (PARTITION BY rep, unit ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cf FROM pts),
m AS (SELECT rep, unit, max(ct) + max(cf) AS n, max(ct) AS npos,
        sum(fp * (ct - tp / 2.0)) / nullif(max(ct) * max(cf), 0) AS auroc FROM c GROUP BY rep, unit),
g AS (SELECT * FROM m WHERE unit = '(pooled)' OR (n >= 40 AND npos > 0 AND npos < n)),
sz AS (SELECT unit, CAST(count(*) / count(DISTINCT rep) AS BIGINT) AS n_rows, avg(CAST(y AS DOUBLE)) AS positive_rate
       FROM preds GROUP BY unit
       UNION ALL SELECT '(pooled)', CAST(count(*) / count(DISTINCT rep) AS BIGINT), avg(CAST(y AS DOUBLE)) FROM preds)
SELECT g.unit, sz.n_rows, round(sz.positive_rate, {D}) AS positive_rate, count(auroc) AS n_reps,
  round(avg(auroc), {D}) AS auroc_mean, round(quantile_cont(auroc, 0.025), {D}) AS auroc_lo,
  round(quantile_cont(auroc, 0.975), {D}) AS auroc_hi
FROM g JOIN sz USING (unit) GROUP BY g.unit, sz.n_rows, sz.positive_rate
"""


def _within(spark, sf):
    preds = _oof(spark, sf, "hour")
    return CM.within_stratum(preds, "unit", "y", "p", "rep", 40)


@query("within_unit_auroc", _WITHIN_SQL)
def within_unit_auroc(spark, sf):
    """Pooled out-of-fold hour-of-day scores, AUROC inside each unit per rep
    (n ≥ 40, both classes), mean and percentile range over reps; plus pooled."""
    return rnd(_within(spark, sf))


@query(
    "weighted_mean_gap",
    f"""WITH w AS ({_WITHIN_SQL})
    SELECT (SELECT count(*) FROM w WHERE unit <> '(pooled)') AS n_strata,
      round((SELECT sum(auroc_mean * n_rows) / sum(n_rows) FROM w WHERE unit <> '(pooled)'), 6) AS weighted_auroc,
      round((SELECT auroc_mean FROM w WHERE unit = '(pooled)'), 6) AS pooled_auroc,
      round((SELECT auroc_mean FROM w WHERE unit = '(pooled)') -
        (SELECT sum(auroc_mean * n_rows) / sum(n_rows) FROM w WHERE unit <> '(pooled)'), 6) AS gap""",
)
def weighted_mean_gap(spark, sf):
    """Size-weighted mean of within-unit AUROC and its gap to the pooled AUROC."""
    return rnd(CM.weighted_summary(rnd(_within(spark, sf)), "unit"), 6)


@query(
    "leave_one_out_metrics",
    f"""WITH o AS (SELECT *, CAST(hour(t0) AS INTEGER) AS hour FROM {_ORDERS_SQL}),
    cell AS (SELECT unit, hour, count(*) AS n, sum(y) AS pos FROM o GROUP BY unit, hour),
    lvl AS (SELECT hour, sum(n) AS nn, sum(pos) AS pp FROM cell GROUP BY hour),
    st AS (SELECT unit, sum(n) AS ns, sum(pos) AS ps FROM cell GROUP BY unit),
    tot AS (SELECT sum(n) AS nt, sum(pos) AS pt FROM cell),
    fit AS (SELECT c.unit, c.hour, CASE WHEN l.nn - c.n > 0 THEN (l.pp - c.pos) / (l.nn - c.n)
              ELSE (t.pt - s.ps) / (t.nt - s.ns) END AS p FROM cell c JOIN lvl l USING (hour) JOIN st s USING (unit), tot t),
    sc AS (SELECT o.unit, o.y, f.p FROM o JOIN fit f USING (unit, hour)),
    pts AS (SELECT unit, p, sum(y) AS tp, count(*) - sum(y) AS fp FROM sc GROUP BY unit, p),
    c AS (SELECT *, sum(tp) OVER (PARTITION BY unit ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ct,
                    sum(fp) OVER (PARTITION BY unit ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cf FROM pts),
    m AS (SELECT unit, CAST(max(ct) + max(cf) AS BIGINT) AS n, CAST(max(ct) AS BIGINT) AS n_pos,
      round(sum(fp * (ct - tp / 2.0)) / nullif(max(ct) * max(cf), 0), {D}) AS auroc,
      round(sum(tp * ct / (ct + cf)) / nullif(max(ct), 0), {D}) AS average_precision FROM c GROUP BY unit)
    SELECT *, round(n_pos / n, {D}) AS positive_rate FROM m WHERE n >= 40 AND n_pos > 0 AND n_pos < n""",
)
def leave_one_out_metrics(spark, sf):
    """Leave-one-unit-out transfer: each unit scored by hour-of-day rates learnt
    on the other units; AUROC / AP per held-out unit (gated)."""
    o = S.index_orders(spark, sf).withColumn("hour", F.hour("t0"))
    scored = CM.loso_target_mean(o, "unit", "hour", "y")
    return rnd(CM.holdout_metrics(scored, "unit", "y", "p", 40))


# --- preparation -------------------------------------------------------------

_TRAIN_SQL = f"(SELECT f.* FROM {_FRAME_SQL} f JOIN {_SPLIT_SQL} s USING (subject_id) WHERE s.is_test = 0)"


def _frame_split(spark, sf):
    f = frame(spark, sf)
    split = _split(spark, sf)
    train = f.join(split.where("is_test = 0"), "subject_id").drop("is_test")
    return f, train


_IMPUTED_SQL = f"""(SELECT f.order_id, f.subject_id, f.unit, f.y, """ + ", ".join(
    f"coalesce(f.{c}, m.{c}) AS {c}, CAST(f.{c} IS NULL AS INTEGER) AS {c}_missing" for c in FEATURES
) + f""" FROM {_FRAME_SQL} f, (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in FEATURES) + f" FROM {_TRAIN_SQL}) m)"


def _imputed(spark, sf):
    f, train = _frame_split(spark, sf)
    f = PR.missing_flags(f, FEATURES)
    return PR.impute(f, train, FEATURES, ["unit"]), train


@query(
    "impute_median_mode",
    f"SELECT order_id, unit, " + ", ".join(f"round({c}, {D}) AS {c}, {c}_missing" for c in FEATURES) + f" FROM {_IMPUTED_SQL}",
)
def impute_median_mode(spark, sf):
    """Missing flags, then medians (numeric) and mode (categorical) fitted on the
    training patients only, applied to every row."""
    imp, _ = _imputed(spark, sf)
    return rnd(imp.select("order_id", "unit", *[x for c in FEATURES for x in (c, f"{c}_missing")]))


@query(
    "standardize",
    f"""WITH i AS {_IMPUTED_SQL}, s AS (SELECT * FROM {_SPLIT_SQL}),
    st AS (SELECT """
    + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATURES)
    + """ FROM i JOIN s USING (subject_id) WHERE is_test = 0)
    SELECT order_id, """
    + ", ".join(f"round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1.0 ELSE sd_{c} END, 6) AS {c}" for c in FEATURES)
    + " FROM i, st",
)
def standardize(spark, sf):
    """Z-scores with training mean and population std of the imputed columns
    (zero variance → centred only)."""
    imp, _ = _imputed(spark, sf)
    train = imp.join(_split(spark, sf).where("is_test = 0"), "subject_id")
    z = PR.standardize(imp, train, FEATURES)
    return rnd(z.select("order_id", *FEATURES), 6)


@query(
    "one_hot",
    f"SELECT order_id, "
    + ", ".join(f"CAST(coalesce(unit = 'unit{i}', false) AS INTEGER) AS unit_unit{i}" for i in range(9))
    + f" FROM {_FRAME_SQL}",
)
def one_hot(spark, sf):
    """One 0/1 column per training level of the unit; unseen → all zeros."""
    f, train = _frame_split(spark, sf)
    return PR.one_hot(f.select("order_id", "unit"), train, ["unit"])


@query(
    "balanced_weights",
    f"""WITH t AS {_TRAIN_SQL}, c AS (SELECT y, count(*) AS nc FROM t GROUP BY y),
    k AS (SELECT count(*) AS nt, count(DISTINCT y) AS kk FROM t)
    SELECT f.order_id, f.y, round(k.nt / (k.kk * c.nc), {D}) AS weight FROM {_FRAME_SQL} f LEFT JOIN c USING (y), k""",
)
def balanced_weights(spark, sf):
    """Class weights n / (2 · n_class) from the training rows."""
    f, train = _frame_split(spark, sf)
    return rnd(PR.balanced_weights(f.select("order_id", "y"), train, "y"))


@query(
    "null_rates",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)), {D}) AS null_rate FROM {_FRAME_SQL}"
        for c in ["order_id", "subject_id", "unit", "hour", "y", *FEATURES]
    ) + ") ORDER BY null_rate DESC, \"column\"",
)
def null_rates(spark, sf):
    """Share of NULLs per column of the modelling frame, highest first."""
    return rnd(PR.null_rates(frame(spark, sf)))


@query(
    "missing_flags",
    f"SELECT order_id, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in FEATURES) + f" FROM {_FRAME_SQL}",
)
def missing_flags(spark, sf):
    """Missingness indicators of the look-back features."""
    return PR.missing_flags(frame(spark, sf), FEATURES).select("order_id", *[f"{c}_missing" for c in FEATURES])
