"""Reporting queries: counts, describe, demographics, repeat summaries, gates,
rule benchmark, dirty-vs-clean flags, confident joint, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STANDIN_WIDE
from ..operators import labeling as LB
from ..operators import metrics as M
from ..operators import quality as QC
from ..operators import report as R
from ..session import cut_lineage
from ..sources import standins as S
from .q_audit import _AUDIT_SQL, audit_base
from .q_cohort import _ORDERS_SQL
from .q_metrics import D, SD, rnd
from .q_model_frame import _FRAME_SQL, _oof, _oof_sql, frame
from .registry import query
from .sqltext import sql_label, sql_subtype


@query(
    "class_counts",
    f"SELECT label, count(*) AS n FROM (SELECT {sql_label('text', STANDIN_WIDE)} AS label FROM documents) "
    "WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label",
)
def class_counts(spark, sf):
    """value_counts of the rule labels."""
    return R.class_counts(LB.label_text(S.notes(spark, sf), STANDIN_WIDE, subtype_out=None), "label")


@query(
    "distinct_counts",
    f"""SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_subject_id, count(DISTINCT hadm_id) AS n_hadm_id,
      count(DISTINCT stay_id) AS n_stay_id FROM {_ORDERS_SQL}""",
)
def distinct_counts(spark, sf):
    """Rows and distinct patients / admissions / stays of the cohort."""
    return R.distinct_counts(S.index_orders(spark, sf), ["subject_id", "hadm_id", "stay_id"])


@query(
    "describe_by_class",
    f"""SELECT y, count(view_min) AS count, round(avg(view_min), {D}) AS mean, round(stddev_samp(view_min), {D}) AS std,
      min(view_min) AS min, max(view_min) AS max, round(quantile_cont(view_min, 0.25), {D}) AS q25,
      round(quantile_cont(view_min, 0.5), {D}) AS q50, round(quantile_cont(view_min, 0.75), {D}) AS q75
    FROM {_FRAME_SQL} GROUP BY y""",
)
def describe_by_class(spark, sf):
    """Per-class describe of a look-back feature (exact quantiles)."""
    return rnd(R.describe_by(frame(spark, sf), "view_min", ["y"]))


@query(
    "demographics_by_class",
    f"""SELECT y, count(*) AS n, round_even(quantile_cont(view_max, 0.5), 1) AS median,
      round_even(quantile_cont(view_max, 0.25), 1) AS iqr_low, round_even(quantile_cont(view_max, 0.75), 1) AS iqr_high,
      round_even(avg(CAST(hour >= 7 AND hour < 19 AS DOUBLE)) * 100, 1) AS pct
    FROM {_FRAME_SQL} GROUP BY y""",
)
def demographics_by_class(spark, sf):
    """n, median and IQR of a feature and % day-shift orders, per class (1 dp)."""
    f = frame(spark, sf)
    return R.demographics_by(f, "view_max", (F.col("hour") >= 7) & (F.col("hour") < 19), ["y"])


@query(
    "median_by_class",
    f"SELECT unit, round(quantile_cont(view_min, 0.5), {D}) AS median FROM {_FRAME_SQL} WHERE view_min IS NOT NULL GROUP BY unit",
)
def median_by_class(spark, sf):
    """Exact median of a feature per unit."""
    return rnd(R.median_by(frame(spark, sf), "view_min", ["unit"]))


def _fold_metrics_sql() -> str:
    return f"""(WITH pr AS {_oof_sql('unit')},
    pts AS (SELECT rep, fold, p, sum(y) AS tp, count(*) - sum(y) AS fp FROM pr GROUP BY rep, fold, p),
    c AS (SELECT *, sum(tp) OVER (PARTITION BY rep, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ct,
                    sum(fp) OVER (PARTITION BY rep, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cf FROM pts)
    SELECT rep, fold, sum(fp * (ct - tp / 2.0)) / nullif(max(ct) * max(cf), 0) AS auroc,
      sum(tp * ct / (ct + cf)) / nullif(max(ct), 0) AS average_precision FROM c GROUP BY rep, fold)"""


@query(
    "score_summary",
    f"""WITH m AS {_fold_metrics_sql()},
    l AS (SELECT 'auroc' AS metric, auroc AS value FROM m UNION ALL SELECT 'average_precision', average_precision FROM m)
    SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo,
      round(quantile_cont(value, 0.975), 6) AS hi FROM l GROUP BY metric""",
)
def score_summary(spark, sf):
    """Per-(rep, fold) AUROC and AP of the out-of-fold unit baseline, summarised
    as mean and 2.5/97.5 percentiles over the 25 fold scores."""
    preds = _oof(spark, sf, "unit")
    m = M.ranking_metrics(preds, "y", "p", ["rep", "fold"])
    long = m.select(
        F.explode(F.array(F.struct(F.lit("auroc").alias("metric"), F.col("auroc").alias("value")),
                          F.struct(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("value")))).alias("s")
    ).select("s.metric", "s.value")
    return rnd(M.mean_ci(long, "value", ["metric"]), 6)


@query(
    "seed_robustness",
    f"""WITH pr AS {_oof_sql('unit')},
    pts AS (SELECT rep, p, sum(y) AS tp, count(*) - sum(y) AS fp FROM pr GROUP BY rep, p),
    c AS (SELECT *, sum(tp) OVER (PARTITION BY rep ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ct,
                    sum(fp) OVER (PARTITION BY rep ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cf FROM pts),
    m AS (SELECT rep, sum(fp * (ct - tp / 2.0)) / nullif(max(ct) * max(cf), 0) AS auroc FROM c GROUP BY rep)
    SELECT count(auroc) AS n, round(avg(auroc), 6) AS mean, round(stddev_pop(auroc), 6) AS std, round(min(auroc), 6) AS min,
      round(max(auroc), 6) AS max FROM m""",
)
def seed_robustness(spark, sf):
    """Pooled out-of-fold AUROC per repetition: mean, population std, min, max."""
    m = M.ranking_metrics(_oof(spark, sf, "unit"), "y", "p", ["rep"])
    return rnd(R.seed_robustness(m, "auroc", []), 6)


# The stored reference table of the regression gate (group, value) of the stand-in
PUBLISHED_AUROC = [("en", 0.495), ("fr", 0.5), ("de", 0.52), ("es", 0.6)]


@query(
    "published_diff",
    f"""WITH sd AS {SD}, pub(model, published) AS (VALUES {", ".join(f"('{m}', {v}::DOUBLE)" for m, v in PUBLISHED_AUROC)}),
    pts AS (SELECT lang, p, sum(y) AS tp, count(*) - sum(y) AS fp FROM sd GROUP BY lang, p),
    c AS (SELECT *, sum(tp) OVER (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ct,
                    sum(fp) OVER (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cf FROM pts),
    m AS (SELECT lang AS model, sum(fp * (ct - tp / 2.0)) / nullif(max(ct) * max(cf), 0) AS computed FROM c GROUP BY lang),
    d AS (SELECT model, computed, published, computed - published AS delta, max(abs(computed - published)) OVER () AS worst FROM m JOIN pub USING (model))
    SELECT model, 'AUROC' AS metric, round(computed, 6) AS computed, published, round(delta, 6) AS delta, round(worst, 6) AS max_abs_delta,
      CASE WHEN abs(delta) < 0.005 THEN 'MATCH' WHEN abs(delta) < 0.02 THEN 'CLOSE' ELSE 'MISMATCH' END AS cell_verdict,
      CASE WHEN worst < 0.005 THEN 'MATCH' WHEN worst < 0.02 THEN 'CLOSE' ELSE 'MISMATCH' END AS verdict FROM d""",
)
def published_diff(spark, sf):
    """Regression gate: grouped AUROC (rank sum, one job) against the stored table, with a verdict per
    cell and overall."""
    ours = R.rank_sum_auroc(S.scored_docs(spark, sf), "y", "p", ["lang"])
    ours = ours.select(F.col("lang").alias("model"), F.lit("AUROC").alias("metric"), F.col("auroc").alias("computed"))
    pub = spark.createDataFrame([(m, "AUROC", v) for m, v in PUBLISHED_AUROC], "model string, metric string, published double")
    out = R.published_diff(ours, F.broadcast(pub), ["model", "metric"])
    return out.select(
        "model", "metric", F.round("computed", 6).alias("computed"), "published", F.round("delta", 6).alias("delta"),
        F.round("max_abs_delta", 6).alias("max_abs_delta"), "cell_verdict", "verdict",
    )


_RULES_SQL = {
    "view_high": "view_max >= 60",
    "purchase_high": "purchase_max >= 100",
    "click_low": "click_max < 5",
}


@query(
    "rule_predicates",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS rule, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), {D}) AS sensitivity,
          round(tn / nullif(tn + fp, 0), {D}) AS specificity, round(tp / nullif(tp + fp, 0), {D}) AS ppv,
          round(tn / nullif(tn + fn, 0), {D}) AS npv FROM (
          SELECT count(*) FILTER (WHERE y = 1 AND coalesce({cond}, false)) AS tp,
            count(*) FILTER (WHERE coalesce(y <> 1, true) AND coalesce({cond}, false)) AS fp,
            count(*) FILTER (WHERE y = 1 AND NOT coalesce({cond}, false)) AS fn,
            count(*) FILTER (WHERE coalesce(y <> 1, true) AND NOT coalesce({cond}, false)) AS tn FROM {_FRAME_SQL})"""
        for name, cond in _RULES_SQL.items()
    ),
)
def rule_predicates(spark, sf):
    """Fixed threshold rules benchmarked as classifiers; a rule whose input is
    missing does not flag (reported, never imputed)."""
    return rnd(R.rule_benchmark(frame(spark, sf), _rules(), "y"))


def _rules():
    return {"view_high": F.col("view_max") >= 60, "purchase_high": F.col("purchase_max") >= 100, "click_low": F.col("click_max") < 5}


_RULE_GRID = [0.05, 0.1, 0.15, 0.2, 0.3]


@query(
    "rule_net_benefit",
    f"""WITH f AS {_FRAME_SQL}, t(threshold) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in _RULE_GRID)}), c AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS rule, count(*) AS n, sum(y) AS pos, count(*) FILTER (WHERE y = 1 AND coalesce({cond}, false)) AS tp,
          count(*) FILTER (WHERE y <> 1 AND coalesce({cond}, false)) AS fp FROM f WHERE y IS NOT NULL"""
        for name, cond in _RULES_SQL.items()
    )
    + f""") SELECT rule, threshold, round(tp / n - fp / n * (threshold / (1 - threshold)), {D}) AS net_benefit,
      round(pos / n - (1 - pos / n) * (threshold / (1 - threshold)), {D}) AS net_benefit_all FROM c, t""",
)
def rule_net_benefit(spark, sf):
    """Net benefit of each fixed rule, and of scanning all, at the published thresholds."""
    return rnd(R.rule_net_benefit(frame(spark, sf), _rules(), "y", _RULE_GRID))


@query(
    "dirty_vs_clean",
    f"""WITH sd AS {SD},
    ta AS (SELECT max(thr) AS thr_a FROM (SELECT DISTINCT round_even(p, 3) AS thr FROM sd) c
           WHERE (SELECT count(*) FROM sd WHERE p >= c.thr AND y = 1) >= 0.95 * (SELECT sum(y) FROM sd)),
    tb AS (SELECT max(thr) AS thr_b FROM (SELECT DISTINCT round_even(p, 3) AS thr FROM sd) c
           WHERE (SELECT count(*) FROM sd WHERE p >= c.thr AND y2 = 1) >= 0.95 * (SELECT sum(y2) FROM sd))
    SELECT thr_a AS threshold_a, thr_b AS threshold_b, count(*) FILTER (WHERE p < thr_a) AS flagged_a,
      count(*) FILTER (WHERE p < thr_b) AS flagged_b, count(*) FILTER (WHERE p < thr_a AND NOT p < thr_b) AS only_a,
      count(*) FILTER (WHERE p < thr_b AND NOT p < thr_a) AS only_b, count(*) FILTER (WHERE p < thr_a AND p < thr_b) AS both
    FROM sd, ta, tb GROUP BY thr_a, thr_b""",
)
def dirty_vs_clean(spark, sf):
    """Flag tool under two label versions: thresholds at sensitivity ≥ .95 and the
    reports flagged by one version only (the 'wrong patients')."""
    return R.flag_comparison(S.scored_docs(spark, sf), "key", "p", "y", "y2")


@query(
    "confident_joint",
    f"""WITH sd AS {SD}, t AS (SELECT avg(CASE WHEN y = 1 THEN p END) AS t1, avg(CASE WHEN y = 0 THEN 1 - p END) AS t0 FROM sd),
    c AS (SELECT y AS given, CASE WHEN p >= t1 AND 1 - p >= t0 THEN CASE WHEN p >= 1 - p THEN 1 ELSE 0 END
        WHEN p >= t1 THEN 1 WHEN 1 - p >= t0 THEN 0 END AS confident FROM sd, t)
    SELECT given, confident, count(*) AS n, CAST(given <> confident AS INTEGER) AS likely_error FROM c
    WHERE confident IS NOT NULL GROUP BY given, confident""",
)
def confident_joint(spark, sf):
    """Confident-learning joint of given vs confidently predicted class."""
    return R.confident_joint(S.scored_docs(spark, sf), "y", "p")


@query(
    "disagreement_weights",
    f"""SELECT a.note_id, coalesce(g.gold, a.regex_label) AS train_label,
      CASE WHEN coalesce(a.regex_label = a.llm_label, false) OR g.gold IS NOT NULL THEN 1.0 ELSE 0.5 END AS weight
    FROM {_AUDIT_SQL} a LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS gold FROM labels) g
      ON a.note_id = g.doc_id""",
)
def disagreement_weights(spark, sf):
    """Training labels: gold where adjudicated, else the rule label; rows the two
    labellers disagree on (and no gold) get half weight."""
    base = audit_base(spark, sf)
    g = S.gold(spark, sf).select("note_id", F.col("gold_label").alias("gold"))
    return R.noise_weights(base.join(g, "note_id", "left"), "regex_label", "llm_label", 0.5, "gold").select(
        "note_id", "train_label", "weight"
    )


@query(
    "fairness_by_group",
    f"""WITH pr AS (SELECT *, CASE WHEN hour(t0) >= 7 AND hour(t0) < 19 THEN 'day' ELSE 'night' END AS shift FROM (
        SELECT p.*, o.t0 FROM {_oof_sql('unit')} p JOIN {_ORDERS_SQL} o USING (order_id))),
    pts AS (SELECT rep, shift, p, sum(y) AS tp, count(*) - sum(y) AS fp FROM pr GROUP BY rep, shift, p),
    c AS (SELECT *, sum(tp) OVER (PARTITION BY rep, shift ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ct,
                    sum(fp) OVER (PARTITION BY rep, shift ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cf FROM pts)
    SELECT rep, shift, CAST(max(ct) + max(cf) AS BIGINT) AS n, CAST(max(ct) AS BIGINT) AS n_pos,
      round(sum(fp * (ct - tp / 2.0)) / nullif(max(ct) * max(cf), 0), {D}) AS auroc,
      round(sum(tp * ct / (ct + cf)) / nullif(max(ct), 0), {D}) AS average_precision FROM c GROUP BY rep, shift""",
)
def fairness_by_group(spark, sf):
    """Out-of-fold baseline metrics by subgroup (shift of the order) and rep."""
    preds = _oof(spark, sf, "unit")
    sh = F.when((F.hour("t0") >= 7) & (F.hour("t0") < 19), "day").otherwise("night")
    return rnd(M.ranking_metrics(preds.withColumn("shift", sh), "y", "p", ["rep", "shift"]))


@query(
    "alignment_check",
    f"""SELECT count(*) FILTER (WHERE b.order_id IS NULL) AS only_left, count(*) FILTER (WHERE a.order_id IS NULL) AS only_right,
      count(*) FILTER (WHERE a.order_id IS NOT NULL AND b.order_id IS NOT NULL AND a.y IS DISTINCT FROM b.y) AS mismatch_y
    FROM {_FRAME_SQL} a FULL OUTER JOIN {_ORDERS_SQL} b ON a.order_id = b.order_id""",
)
def alignment_check(spark, sf):
    """Feature frame vs cohort: rows only on one side and label mismatches (all 0)."""
    return QC.alignment(frame(spark, sf), S.index_orders(spark, sf), ["order_id"], ["y"])


@query(
    "key_uniqueness",
    "SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1",
)
def key_uniqueness(spark, sf):
    """Keys occurring more than once (report copies share a text key)."""
    n = S.notes(spark, sf).select(F.md5("text").alias("text_key"))
    return QC.duplicate_keys(n, ["text_key"])


@query("display_sample", f"SELECT * FROM {_FRAME_SQL} ORDER BY order_id LIMIT 20")
def display_sample(spark, sf):
    """First 20 rows of the modelling frame by order id (a display sample)."""
    return frame(spark, sf).orderBy("order_id").limit(20)


@query(
    "impute_vs_drop",
    f"""WITH r AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, avg(CAST({c} IS NULL AS DOUBLE)) AS nr FROM {_FRAME_SQL}"
        for c in ['order_id', 'subject_id', 'unit', 'hour', 'y', 'view_min', 'view_max', 'purchase_max', 'click_max', 'signup_min'])}),
    t(threshold) AS (VALUES (0.1), (0.3), (0.5), (0.7), (0.9))
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE nr <= threshold) AS n_columns_kept FROM t, r GROUP BY threshold""",
)
def impute_vs_drop(spark, sf):
    """Columns kept when dropping those above each null-rate threshold."""
    from ..operators.prep import null_rates

    nr = null_rates(frame(spark, sf))
    th = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])).alias("threshold")
    return nr.select("*", th).groupBy("threshold").agg(F.count_if(F.col("null_rate") <= F.col("threshold")).alias("n_columns_kept"))


@query(
    "direction_check",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(CASE WHEN y = 0 THEN {c} END), {D}) AS mean_neg,
          round(avg(CASE WHEN y = 1 THEN {c} END), {D}) AS mean_pos,
          round(quantile_cont({c}, 0.5) FILTER (WHERE y = 0), {D}) AS median_neg,
          round(quantile_cont({c}, 0.5) FILTER (WHERE y = 1), {D}) AS median_pos,
          CAST(sign(avg(CASE WHEN y = 1 THEN {c} END) - avg(CASE WHEN y = 0 THEN {c} END)) AS INTEGER) AS direction
        FROM {_FRAME_SQL}""" for c in ["view_min", "view_max", "purchase_max", "click_max", "signup_min", "hour"]
    ) + ")",
)
def direction_check(spark, sf):
    """Mean / median of each feature by class and the direction of the difference."""
    f = frame(spark, sf)
    return rnd(R.direction_table(f, ["view_min", "view_max", "purchase_max", "click_max", "signup_min", "hour"], "y"))


@query(
    "stratum_flag_rates",
    f"""WITH sd AS {SD}, thr AS (SELECT max(c.t) AS t FROM (SELECT DISTINCT round_even(p, 3) AS t FROM sd) c
      WHERE (SELECT count(*) FROM sd WHERE p >= c.t AND y = 1) >= 0.95 * (SELECT sum(y) FROM sd))
    SELECT stratum, count(*) AS n, round(avg(CAST(p < thr.t AS DOUBLE)), {D}) AS flag_rate,
      round(count(*) FILTER (WHERE p < thr.t AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), {D}) AS missed_positive_rate,
      coalesce(CAST(count(*) FILTER (WHERE p < thr.t AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0) > 0.05 AS INTEGER), 0) AS violates
    FROM sd, thr GROUP BY stratum""",
)
def stratum_flag_rates(spark, sf):
    """The pooled operating threshold applied inside each stratum: flag rate,
    missed-positive rate and violations of the sensitivity target."""
    d = S.scored_docs(spark, sf)
    thr = M.operating_point(d, "y", "p", 0.95).select(F.col("threshold").alias("_thr"))
    j = M.join_groups(d, thr, [])
    return rnd(R.flag_rates_by(j, "y", "p", F.col("_thr"), ["stratum"], 0.95))


@query(
    "subtype_rates",
    f"""SELECT subtype, lang, level, tp, fp, fn, tn,
      round(tp / nullif(tp + fn, 0), {D}) AS sensitivity, round(tn / nullif(tn + fp, 0), {D}) AS specificity,
      round(tp / nullif(tp + fp, 0), {D}) AS ppv, round(tn / nullif(tn + fn, 0), {D}) AS npv FROM (
      SELECT subtype, lang, CAST(grouping(subtype, lang) AS INTEGER) AS level, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp,
        count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn
      FROM (SELECT coalesce(({sql_subtype('d.text', STANDIN_WIDE)}), '(none)') AS subtype,
              d.lang, l.quality = 1 AS t, ({sql_label('d.text', STANDIN_WIDE)}) = 'Positive' AS p
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
      GROUP BY ROLLUP (subtype, lang))""",
)
def subtype_rates(spark, sf):
    """Rule labeller vs gold per subtype, overall and by language group (rollup)."""
    lab = LB.label_text(S.notes(spark, sf), STANDIN_WIDE).withColumn("subtype", F.coalesce("subtype", F.lit("(none)")))
    j = lab.join(S.gold(spark, sf), "note_id").join(S.notes(spark, sf).select("note_id", F.col("hadm_id").alias("lang")), "note_id")
    return rnd(R.rates_rollup(j, F.col("gold_label") == "Positive", F.col("label") == "Positive", ["subtype", "lang"]))


# Published yields of head imaging in intensive care, as cited by the study's
# literature review (source, signal, positive rate; NULL where the review names no number)
PUBLISHED_YIELDS = [
    ("Chokshi", "overall", 0.228),
    ("Khan", "overall", 0.121),
    ("Khan", "focal", 0.30),
    ("Khan", "seizure", 0.162),
    ("Khan", "altered mental status", 0.074),
    ("Purmer", "overall", 0.51),
    ("Balachandran", "overall", None),
]


@query(
    "yield_vs_published",
    f"""WITH lit(source, signal, published_rate) AS (VALUES {", ".join(f"('{a}', '{b}', {'NULL' if v is None else v}::DOUBLE)" for a, b, v in PUBLISHED_YIELDS)}),
    ours AS (SELECT coalesce(unit, '(none)') AS unit, count(*) AS n, avg(CAST(y AS DOUBLE)) AS our_rate FROM {_ORDERS_SQL} GROUP BY 1
      UNION ALL SELECT '(all)', count(*), avg(CAST(y AS DOUBLE)) FROM {_ORDERS_SQL})
    SELECT source, signal, published_rate, unit, n, round(our_rate, {D}) AS our_rate, round(our_rate - published_rate, {D}) AS difference
    FROM lit, ours""",
)
def yield_vs_published(spark, sf):
    """Positive rate of the cohort and of each unit next to every published yield."""
    o = S.index_orders(spark, sf).select(F.explode(F.array(F.coalesce("unit", F.lit("(none)")), F.lit("(all)"))).alias("unit"), "y")
    ours = o.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("our_rate"))
    lit = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("signal"), F.lit(v).cast("double").alias("published_rate")) for a, b, v in PUBLISHED_YIELDS])
    j = ours.select("*", F.explode(lit).alias("l")).select("l.*", "unit", "n", "our_rate")
    return rnd(j.withColumn("difference", F.col("our_rate") - F.col("published_rate")))


_EXPECTED = [("view_min", 1), ("view_max", 1), ("purchase_max", -1), ("click_max", 1), ("signup_min", -1), ("hour", 1)]


@query(
    "direction_vs_literature",
    f"""WITH e(feature, expected_sign) AS (VALUES {", ".join(f"('{c}', {v})" for c, v in _EXPECTED)}), d AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(sign(avg(CASE WHEN y = 1 THEN {c} END) - avg(CASE WHEN y = 0 THEN {c} END)) AS INTEGER) AS direction
        FROM {_FRAME_SQL}""" for c, _ in _EXPECTED
    )
    + ") SELECT feature, direction, expected_sign, CAST(direction = expected_sign AS INTEGER) AS agrees FROM d JOIN e USING (feature)",
)
def direction_vs_literature(spark, sf):
    """Direction of each feature against the sign expected from the literature (stand-in signs)."""
    expected = spark.createDataFrame(_EXPECTED, "feature string, expected_sign int")
    return R.direction_table(frame(spark, sf), [c for c, _ in _EXPECTED], "y", F.broadcast(expected)).select("feature", "direction", "expected_sign", "agrees")


_POOLS_SQL = f"""WITH sd AS (SELECT lang, CAST(p AS DOUBLE) AS score, CAST(y AS DOUBLE) AS y FROM {SD} WHERE p IS NOT NULL AND y IS NOT NULL),
    v AS (SELECT lang, score, count(*) AS n, sum(y) AS s FROM sd GROUP BY lang, score),
    c AS (SELECT lang, score, n, sum(n) OVER w AS cn, sum(s) OVER w AS cs, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY lang ORDER BY score)),
    e AS (SELECT lang, i, cn, cs FROM c UNION ALL SELECT DISTINCT lang, 0, 0, 0 FROM c),
    g AS (SELECT a.lang, a.i AS a, b.i AS b, (b.cs - a.cs) / (b.cn - a.cn) AS mean FROM e a JOIN c b ON a.lang = b.lang AND a.i < b.i),
    low AS (SELECT c.lang, c.i, g.a, min(g.mean) AS m FROM c JOIN g ON g.lang = c.lang AND g.b >= c.i AND g.a < c.i GROUP BY c.lang, c.i, g.a)
    SELECT c.lang, c.score, c.n, round(max(low.m), 9) AS value FROM c JOIN low USING (lang, i) GROUP BY c.lang, c.score, c.n"""


@query("isotonic_values", _POOLS_SQL)
def isotonic_values(spark, sf):
    """Isotonic fit of the label on the score, per language: the fitted value of every distinct score
    (in SQL by the max-min formula over all intervals)."""
    from ..operators.isotonic import isotonic_apply, isotonic_fit

    d = cut_lineage(S.scored_docs(spark, sf).select("lang", "p", "y"))
    pools = isotonic_fit(d, "p", "y", ["lang"])
    scores = d.where("p IS NOT NULL AND y IS NOT NULL").groupBy("lang", F.col("p").cast("double").alias("score")).agg(F.count("*").alias("n"))
    return rnd(isotonic_apply(scores, pools, "score", ["lang"], "value"), 9)


@query(
    "likely_errors",
    f"""WITH sd AS {SD}, t AS (SELECT avg(CASE WHEN y = 1 THEN p END) AS t1, avg(CASE WHEN y = 0 THEN 1 - p END) AS t0 FROM sd)
    SELECT key, y AS given, round(CASE WHEN y = 1 THEN (1 - p) - t0 ELSE p - t1 END, {D}) AS margin FROM sd, t
    WHERE CASE WHEN y = 1 THEN 1 - p >= t0 ELSE p >= t1 END ORDER BY margin DESC, key""",
)
def likely_errors(spark, sf):
    """Labelled reports whose score confidently contradicts the label, by margin."""
    return rnd(R.likely_errors(S.scored_docs(spark, sf), "key", "y", "p"))

