"""Metric queries on scored, labelled reports (stand-in score: n_chars % 1000 / 1000)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STANDIN_WIDE
from ..operators import labeling as LB
from ..operators import metrics as M
from ..sources import standins as S
from .registry import query
from .sqltext import sql_label

D = 9  # decimals of every double in a metric output (both sides of the oracle check)

SD = """(SELECT d.doc_id AS key, d.source AS stratum, d.lang, l.quality AS y, l.toxic AS y2,
  CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# Decision-curve grids: 60 points from 0.01 to 0.60 (evenly spaced, as generated
# by numpy) and the five published points.
DCA_GRID = [float(x) for x in np.linspace(0.01, 0.60, 60)]
REPORT_GRID = [0.05, 0.1, 0.15, 0.2, 0.3]


def rnd(df: DataFrame, decimals: int = D) -> DataFrame:
    """Round every double column (sum order differs between engines)."""
    return df.withColumns({c: F.round(c, decimals) for c, t in df.dtypes if t == "double"})


def _rank_sql(g: str) -> str:
    gsel = f"{g}, " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    return f"""WITH sd AS {SD},
    pts AS (SELECT {gsel}p, CAST(sum(y) AS BIGINT) AS tp, CAST(count(*) - sum(y) AS BIGINT) AS fp FROM sd GROUP BY {gsel}p),
    c AS (SELECT *, sum(tp) OVER ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
                    sum(fp) OVER ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_fp FROM pts)
    SELECT {gsel}CAST(max(cum_tp) + max(cum_fp) AS BIGINT) AS n, CAST(max(cum_tp) AS BIGINT) AS n_pos,
      round(sum(fp * (cum_tp - tp / 2.0)) / nullif(max(cum_tp) * max(cum_fp), 0), {D}) AS auroc,
      round(sum(tp * cum_tp / (cum_tp + cum_fp)) / nullif(max(cum_tp), 0), {D}) AS average_precision
    FROM c {"GROUP BY " + g if g else ""}"""


@query("auroc", _rank_sql(""))
def auroc(spark, sf):
    """Pooled AUROC (ties ½) and average precision."""
    return rnd(M.ranking_metrics(S.scored_docs(spark, sf), "y", "p"))


@query("auroc_by_unit", _rank_sql("stratum"))
def auroc_by_unit(spark, sf):
    """The same metrics inside each stratum (one row per stratum)."""
    return rnd(M.ranking_metrics(S.scored_docs(spark, sf), "y", "p", ["stratum"]))


@query("average_precision", _rank_sql("lang"))
def average_precision(spark, sf):
    """Ranking metrics per language group."""
    return rnd(M.ranking_metrics(S.scored_docs(spark, sf), "y", "p", ["lang"]))


@query(
    "brier_accuracy",
    f"""SELECT lang, count(*) AS n, round(avg((p - y) * (p - y)), {D}) AS brier,
    round(avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS DOUBLE)), {D}) AS accuracy FROM {SD} GROUP BY lang""",
)
def brier_accuracy(spark, sf):
    """Brier score and accuracy at the p > 0.5 class cut, per group."""
    return rnd(M.brier_accuracy(S.scored_docs(spark, sf), "y", "p", ["lang"]))


def _conf_sql(truth: str, pred: str, g: str, src: str) -> str:
    return f"""SELECT {g + ', ' if g else ''}count(*) FILTER (WHERE {truth} AND {pred}) AS tp,
      count(*) FILTER (WHERE NOT {truth} AND {pred}) AS fp, count(*) FILTER (WHERE {truth} AND NOT {pred}) AS fn,
      count(*) FILTER (WHERE NOT {truth} AND NOT {pred}) AS tn FROM {src} {"GROUP BY " + g if g else ""}"""


@query("confusion_counts", _conf_sql("coalesce(y = 1, false)", "coalesce(p > 0.5, false)", "stratum", SD))
def confusion_counts(spark, sf):
    """2×2 counts per stratum (truth y = 1, prediction p > 0.5)."""
    d = S.scored_docs(spark, sf)
    return M.confusion(d, F.col("y") == 1, F.col("p") > 0.5, ["stratum"])


_CR_SQL = " UNION ALL ".join(
    f"""SELECT lang, {c} AS class, round(coalesce(tp / nullif(tp + fp, 0), 0.0), {D}) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0.0), {D}) AS recall,
      round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) /
        nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0), {D}) AS f1,
      CAST(tp + fn AS BIGINT) AS support
    FROM (SELECT lang, CAST(count(*) FILTER (WHERE y = {c} AND pred = {c}) AS DOUBLE) AS tp,
      count(*) FILTER (WHERE y <> {c} AND pred = {c}) AS fp, count(*) FILTER (WHERE y = {c} AND pred <> {c}) AS fn
      FROM (SELECT *, CAST(p > 0.5 AS INTEGER) AS pred FROM {SD}) GROUP BY lang)"""
    for c in (0, 1)
)


@query("class_report", _CR_SQL)
def class_report(spark, sf):
    """Precision / recall / F1 / support for both classes, per group."""
    d = S.scored_docs(spark, sf).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return rnd(M.class_report(d, "y", "pred", by=["lang"]))


@query(
    "roc_points",
    f"""WITH sd AS {SD}, pts AS (SELECT p, sum(y) AS tp, count(*) - sum(y) AS fp FROM sd GROUP BY p),
    c AS (SELECT p, sum(tp) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
                 sum(fp) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_fp FROM pts)
    SELECT p AS threshold, round(cum_tp / (SELECT sum(y) FROM sd), {D}) AS tpr,
      round(cum_fp / (SELECT count(*) - sum(y) FROM sd), {D}) AS fpr FROM c""",
)
def roc_points(spark, sf):
    """ROC curve points, one per distinct score."""
    return rnd(M.roc_points(S.scored_docs(spark, sf), "y", "p"))


@query(
    "reliability_bins",
    f"""SELECT CAST(least(greatest(ceil(p * 10) - 1, 0), 9) AS INTEGER) AS bin, count(*) AS n,
      round(avg(p), {D}) AS mean_p, round(avg(CAST(y AS DOUBLE)), {D}) AS frac_pos FROM {SD} GROUP BY 1""",
)
def reliability_bins(spark, sf):
    """Reliability table: ten right-closed bins, empty bins absent."""
    return rnd(M.reliability_bins(S.scored_docs(spark, sf), "y", "p"))


def _nb_sql(grid: list[float], g: str) -> str:
    vals = ", ".join(f"(CAST({repr(t)} AS DOUBLE))" for t in grid)
    gsel = f"s.{g}, " if g else ""
    join = f"AND d.{g} = s.{g}" if g else ""
    return f"""WITH sd AS {SD}, t(threshold) AS (VALUES {vals}),
    s AS (SELECT {g + ', ' if g else ''}count(*) AS n, sum(y) AS n_pos FROM sd {"GROUP BY " + g if g else ""})
    SELECT {gsel}round(t.threshold, {D}) AS threshold,
      CAST((SELECT count(*) FROM sd d WHERE d.p >= t.threshold AND d.y = 1 {join}) AS BIGINT) AS tp,
      CAST((SELECT count(*) FROM sd d WHERE d.p >= t.threshold AND d.y = 0 {join}) AS BIGINT) AS fp,
      CAST(s.n AS BIGINT) AS n,
      round((SELECT count(*) FROM sd d WHERE d.p >= t.threshold AND d.y = 1 {join}) / s.n
        - (SELECT count(*) FROM sd d WHERE d.p >= t.threshold AND d.y = 0 {join}) / s.n
          * CASE WHEN t.threshold < 1 THEN t.threshold / (1 - t.threshold) END, {D}) AS net_benefit,
      round(s.n_pos / s.n - (1 - s.n_pos / s.n) * CASE WHEN t.threshold < 1 THEN t.threshold / (1 - t.threshold) END, {D})
        AS net_benefit_all
    FROM t, s"""


@query("net_benefit", _nb_sql(DCA_GRID, "lang"))
def net_benefit(spark, sf):
    """Decision curve over the 60-point grid, per group; treat-all alongside."""
    return rnd(M.net_benefit(S.scored_docs(spark, sf), "y", "p", DCA_GRID, ["lang"]))


@query("threshold_grid", _nb_sql(REPORT_GRID, ""))
def threshold_grid(spark, sf):
    """Net benefit at the five reported threshold probabilities (pooled)."""
    return rnd(M.net_benefit(S.scored_docs(spark, sf), "y", "p", REPORT_GRID))


@query(
    "best_threshold",
    f"""WITH nb AS ({_nb_sql(DCA_GRID, "lang")})
    SELECT lang, arg_max(threshold, (net_benefit, -threshold)) AS best_threshold, max(net_benefit) AS best_net_benefit
    FROM nb WHERE net_benefit IS NOT NULL GROUP BY lang""",
)
def best_threshold(spark, sf):
    """Threshold of peak net benefit per group (smallest on ties)."""
    nb = rnd(M.net_benefit(S.scored_docs(spark, sf), "y", "p", DCA_GRID, ["lang"]))
    return M.best_threshold(nb, ["lang"])


def _op_sql(g: str, target: float = 0.95) -> str:
    gsel = f"{g}, " if g else ""
    jn = f"AND d.{g} = c.{g}" if g else ""
    gb = f"GROUP BY {g}" if g else ""
    return f"""WITH sd AS {SD},
    tot AS (SELECT {gsel}count(*) AS nn, sum(y) AS np FROM sd {gb}),
    cand AS (SELECT DISTINCT {gsel}round_even(p, 3) AS thr FROM sd),
    c AS (SELECT c.*, (SELECT count(*) FROM sd d WHERE d.p >= c.thr {jn}) AS n_ge,
                      (SELECT count(*) FROM sd d WHERE d.p >= c.thr AND d.y = 1 {jn}) AS pos_ge FROM cand c),
    k AS (SELECT c.*, t.nn, t.np, CASE WHEN t.np > 0 THEN pos_ge / t.np END AS sens
          FROM c JOIN tot t {"USING (" + g + ")" if g else "ON true"})
    SELECT {gsel}arg_max(thr, thr) AS threshold, round(arg_max(sens, thr), {D}) AS sensitivity,
      round(arg_max((nn - n_ge) / nn, thr), {D}) AS flag_rate,
      round(arg_max(CASE WHEN np > 0 THEN (np - pos_ge) / np END, thr), {D}) AS missed_positive_rate
    FROM k WHERE sens IS NULL OR sens >= {target} {gb}"""


@query("operating_point", _op_sql(""))
def operating_point(spark, sf):
    """Largest rounded-score threshold keeping sensitivity ≥ 0.95 (pooled)."""
    return rnd(M.operating_point(S.scored_docs(spark, sf), "y", "p", 0.95))


@query("operating_point_by_unit", _op_sql("stratum"))
def operating_point_by_unit(spark, sf):
    """The operating point chosen separately inside each stratum."""
    return rnd(M.operating_point(S.scored_docs(spark, sf), "y", "p", 0.95, by=["stratum"]))


_G = """(SELECT doc_id AS note_id, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS rater1,
  CASE WHEN toxic = 1 THEN 'Positive' ELSE 'Negative' END AS rater2 FROM labels)"""


@query(
    "cohen_kappa",
    f"""WITH g AS {_G}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE rater1 = rater2) AS n_agree FROM g),
    a AS (SELECT rater1 AS k, count(*) AS na FROM g GROUP BY 1), b AS (SELECT rater2 AS k, count(*) AS nb FROM g GROUP BY 1),
    e AS (SELECT sum(na * nb) AS s FROM a JOIN b USING (k))
    SELECT n, n_agree, round(n_agree / n, {D}) AS p_observed, round(coalesce(s, 0) / (n * n), {D}) AS p_expected,
      round((n_agree / n - coalesce(s, 0) / (n * n)) / nullif(1 - coalesce(s, 0) / (n * n), 0), {D}) AS kappa FROM t, e""",
)
def cohen_kappa(spark, sf):
    """Cohen's κ between two raters over all labelled reports."""
    return rnd(M.cohen_kappa(S.gold(spark, sf), "rater1", "rater2"))


_RATERS3 = f"""(SELECT l.doc_id AS item, r.rater, r.label FROM labels l JOIN documents d ON l.doc_id = d.doc_id,
  LATERAL (VALUES ('r1', CAST(l.quality AS VARCHAR)), ('r2', CAST(l.toxic AS VARCHAR)),
    ('r3', CAST(CAST({sql_label('d.text', STANDIN_WIDE)} = 'Positive' AS INTEGER) AS VARCHAR))) r(rater, label))"""


def _raters3(spark, sf):
    lab = LB.label_text(S.notes(spark, sf), STANDIN_WIDE, subtype_out=None).select("note_id", "label")
    g = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "note_id").join(lab, "note_id")
    return g.select(
        F.col("note_id").alias("item"),
        F.explode(
            F.array(
                F.struct(F.lit("r1").alias("rater"), F.col("quality").cast("string").alias("label")),
                F.struct(F.lit("r2").alias("rater"), F.col("toxic").cast("string").alias("label")),
                F.struct(F.lit("r3").alias("rater"), (F.col("label") == "Positive").cast("int").cast("string").alias("label")),
            )
        ).alias("r"),
    ).select("item", "r.rater", "r.label")


@query(
    "fleiss_kappa",
    f"""WITH l AS {_RATERS3}, nij AS (SELECT item, label, count(*) AS c FROM l GROUP BY item, label),
    m AS (SELECT item, count(*) AS m FROM l GROUP BY item),
    pi AS (SELECT item, (sum(c * c) - min(m.m)) / (min(m.m) * (min(m.m) - 1)) AS p FROM nij JOIN m USING (item) GROUP BY item),
    pj AS (SELECT label, sum(c) AS cj FROM nij GROUP BY label),
    pe AS (SELECT sum((cj / (SELECT sum(cj) FROM pj)) ^ 2) AS p_e FROM pj)
    SELECT (SELECT count(*) FROM pi) AS n_items, (SELECT CAST(max(m) AS BIGINT) FROM m) AS raters,
      CAST(0 AS BIGINT) AS n_items_skipped, round((SELECT avg(p) FROM pi), {D}) AS p_bar, round(p_e, {D}) AS p_e,
      round(((SELECT avg(p) FROM pi) - p_e) / (1 - p_e), {D}) AS kappa,
      coalesce(CAST(((SELECT avg(p) FROM pi) - p_e) / (1 - p_e) >= 0.8 AS INTEGER), 0) AS passes_gate FROM pe""",
)
def fleiss_kappa(spark, sf):
    """Fleiss' κ over three raters (two label columns and the rule labeller), with
    the acceptance gate κ ≥ 0.80."""
    return rnd(M.fleiss_kappa(_raters3(spark, sf), "item", "rater", "label", gate=0.8))


@query(
    "rater_rates",
    f"""WITH j AS (SELECT l.quality = 1 AS truth, ({sql_label('d.text', STANDIN_WIDE)}) = 'Positive' AS pred
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    c AS ({_conf_sql("truth", "pred", "", "j")})
    SELECT *, round(tp / nullif(tp + fn, 0), {D}) AS sensitivity, round(tn / nullif(tn + fp, 0), {D}) AS specificity,
      round(tp / nullif(tp + fp, 0), {D}) AS ppv, round(tn / nullif(tn + fn, 0), {D}) AS npv FROM c""",
)
def rater_rates(spark, sf):
    """Rule labeller vs gold (Positive vs rest): counts, sens, spec, PPV, NPV."""
    lab = LB.label_text(S.notes(spark, sf), STANDIN_WIDE, subtype_out=None)
    j = lab.join(S.gold(spark, sf), "note_id")
    return rnd(M.rates(M.confusion(j, F.col("gold_label") == "Positive", F.col("label") == "Positive")))


@query(
    "reliability_by_unit",
    f"""SELECT stratum, CAST(least(greatest(ceil(p * 10) - 1, 0), 9) AS INTEGER) AS bin, count(*) AS n,
      round(avg(p), {D}) AS mean_p, round(avg(CAST(y AS DOUBLE)), {D}) AS frac_pos FROM {SD} GROUP BY 1, 2""",
)
def reliability_by_unit(spark, sf):
    """Reliability table per stratum (calibration checked unit by unit, not only pooled)."""
    return rnd(M.reliability_bins(S.scored_docs(spark, sf), "y", "p", by=["stratum"]))
