"""Audit queries (C6, C7): external labeller, agreement, cross-tab, suspected
errors, triage sheet, gold sample with blinded sheet and hidden key, batches,
unblinding and scoring; section / reply / JSON / prompt helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import REPORT_PROMPT, STANDIN_REDUCED, STANDIN_WIDE, prompt, section, section_or_text
from ..operators import audit as A
from ..operators import labeling as LB
from ..operators import metrics as M
from ..session import cut_lineage, ensure_checkpoint_dir, table
from ..sources import standins as S
from .q_metrics import D, rnd
from .registry import q, query
from .sqltext import sql_label

ANCHOR = "that"  # section anchor of the stand-in reports
ACUTE, STABLE = "there|then", "license|erat"  # stand-in triage word lists
# The quotas of the published sampling plan
GOLD_PLAN = {("Negative", "Positive"): 150, ("Positive", "Negative"): 150, ("Negative", "Negative"): 100, ("Positive", "Positive"): 50}
BATCH1_PLAN = {("Negative", "Positive"): 30, ("Positive", "Negative"): 25, ("Negative", "Negative"): 15, ("Positive", "Positive"): 10}
SEED = 42


def stub_labeller(texts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a remote labeller (vectorised over a batch):
    replies 'Answer: Positive' when the text mentions 'there', else 'negative'."""
    hit = texts.fillna("").str.lower().str.contains("there", regex=False)
    return pd.Series(np.where(hit, "Answer: Positive", "negative"), index=texts.index)


def stub_reply(text: str) -> str:
    """The same for one text."""
    return "Answer: Positive" if "there" in text.lower() else "negative"


def audit_base(spark, sf):
    """(note_id, subject_id, regex_label, llm_label) for every report. The label
    table (no text) is written once: external labels are costly to recompute (a
    remote service in real use), and every audit step reads them several times."""
    n = S.notes(spark, sf)
    rx = LB.label_text(n, STANDIN_REDUCED, out="regex_label", subtype_out=None)
    ext = A.external_label(n, "note_id", "text", stub_labeller).select("note_id", F.col("ext_label").alias("llm_label"))
    return cut_lineage(rx.select("note_id", "subject_id", "regex_label").join(ext, "note_id"))


def with_text(spark, sf, rows):
    """Attach report text to selected rows (broadcast side when the selection is
    proven small, so the report table is not shuffled)."""
    return A.attach_text(rows, S.notes(spark, sf).select("note_id", "text"), "note_id")


_STUB_SQL = "CASE WHEN contains(lower(coalesce(text, '')), 'there') THEN 'Positive' ELSE 'Negative' END"
_AUDIT_SQL = f"""(SELECT doc_id AS note_id, source AS subject_id, {sql_label('text', STANDIN_REDUCED)} AS regex_label,
  {_STUB_SQL} AS llm_label, text FROM documents)"""


@query("external_label_stub", f"SELECT doc_id AS note_id, {_STUB_SQL} AS ext_label FROM documents")
def external_label_stub(spark, sf):
    """User labeller over every report through Arrow batches (mapInPandas), reply
    parsed to a label, per-row errors captured."""
    n = S.notes(spark, sf)
    return A.external_label(n, "note_id", "text", stub_labeller).select("note_id", "ext_label")


@query("resume_checkpoint", f"SELECT doc_id AS note_id, {_STUB_SQL} AS ext_label FROM documents")
def resume_checkpoint(spark, sf):
    """Resumable labelling: a first pass (the reports in `labels`) stores its labels as
    Parquet state in the shared folder; a second pass over all reports reads that state,
    skips its rows by an anti join, labels the rest and appends them. The result is the
    stored state, one label per report."""
    n = S.notes(spark, sf)
    state = f"{ensure_checkpoint_dir(spark).rstrip('/')}/label-state-{uuid.uuid4().hex[:8]}"
    first = n.join(table(spark, sf, "labels").select(F.col("doc_id").alias("note_id")), "note_id", "left_semi")
    stored = A.resume(state, A.external_label(first, "note_id", "text", stub_labeller).select("note_id", "ext_label"), "note_id")
    rest = A.external_label(n, "note_id", "text", stub_labeller, done=stored).select("note_id", "ext_label")
    return A.resume(state, rest, "note_id")


@query(
    "label_agreement",
    f"""SELECT count(*) AS n_total, count(*) FILTER (WHERE b) AS n_comparable, count(*) FILTER (WHERE b AND regex_label = llm_label)
      AS n_agree, round(count(*) FILTER (WHERE b AND regex_label = llm_label) / nullif(count(*) FILTER (WHERE b), 0), {D}) AS agree_rate
    FROM (SELECT *, coalesce(regex_label IN ('Positive', 'Negative') AND llm_label IN ('Positive', 'Negative'), false) AS b
      FROM {_AUDIT_SQL})""",
)
def label_agreement(spark, sf):
    """Agreement of the rule labeller and the external labeller where both decided."""
    return rnd(A.agreement(audit_base(spark, sf), "regex_label", "llm_label"))


@query(
    "label_crosstab",
    f"""SELECT regex_label, count(*) FILTER (WHERE llm_label = 'Negative') AS Negative,
      count(*) FILTER (WHERE llm_label = 'Positive') AS Positive FROM {_AUDIT_SQL}
    WHERE regex_label IN ('Positive', 'Negative') AND llm_label IN ('Positive', 'Negative') GROUP BY regex_label""",
)
def label_crosstab(spark, sf):
    """Cross-tab of decided rows: rule label × external label."""
    d = A.decided(audit_base(spark, sf), ["regex_label", "llm_label"])
    return LB.crosstab_wide(d, "regex_label", "llm_label", ["Negative", "Positive"])


@query(
    "suspected_errors",
    f"""SELECT count(*) FILTER (WHERE regex_label = 'Negative' AND llm_label = 'Positive') AS n_suspected,
      count(*) FILTER (WHERE regex_label = 'Negative') AS n_margin,
      round(count(*) FILTER (WHERE regex_label = 'Negative' AND llm_label = 'Positive')
        / nullif(count(*) FILTER (WHERE regex_label = 'Negative'), 0), {D}) AS share
    FROM {_AUDIT_SQL} WHERE regex_label IN ('Positive', 'Negative') AND llm_label IN ('Positive', 'Negative')""",
)
def suspected_errors(spark, sf):
    """Rule-Negative reports the external labeller calls Positive, as a share of
    all decided rule-Negative reports."""
    return rnd(A.suspected_errors(audit_base(spark, sf), "regex_label", "llm_label"))


_DIS_SQL = f"(SELECT * FROM {_AUDIT_SQL} WHERE regex_label = 'Negative' AND llm_label = 'Positive')"


@query("disagreement_list", f"SELECT note_id, subject_id, regex_label, llm_label FROM {_DIS_SQL}")
def disagreement_list(spark, sf):
    """The suspected false negatives, for review."""
    return A.disagreement_list(audit_base(spark, sf), "regex_label", "llm_label")


def _excerpt_sql(text: str, n: int, anchor: str) -> str:
    pat = q(f"(?i){anchor}[:\\s]*([\\s\\S]+)")
    sec = f"CASE WHEN regexp_matches({text}, {pat}) THEN regexp_replace(regexp_extract({text}, {pat}, 1), '^\\s+|\\s+$', '', 'g') END"
    body = f"coalesce({sec}, regexp_replace({text}, '^\\s+|\\s+$', '', 'g'))"
    return f"substring(regexp_replace({body}, '\\s+', ' ', 'g'), 1, {n})"


def _hint_sql(x: str) -> str:
    a, s = f"regexp_matches({x}, '(?i)({ACUTE})')", f"regexp_matches({x}, '(?i)({STABLE})')"
    from ..functions.text import TRIAGE_LABELS as L

    return f"CASE WHEN {a} AND {s} THEN {q(L[0])} WHEN {a} THEN {q(L[1])} ELSE {q(L[2])} END"


_TRIAGE_SQL = f"""(SELECT note_id, subject_id, regex_label, llm_label, excerpt, {_hint_sql('excerpt')} AS auto_hint,
  '' AS true_label, '' AS finding_type, '' AS reviewer_notes
  FROM (SELECT *, {_excerpt_sql('text', 500, ANCHOR)} AS excerpt FROM {_DIS_SQL}))"""


def _triage(spark, sf):
    from ..functions.text import TRIAGE_LABELS

    dis = with_text(spark, sf, A.disagreement_list(audit_base(spark, sf), "regex_label", "llm_label"))
    return A.triage_sheet(dis, "text", ACUTE, STABLE, TRIAGE_LABELS, 500, ANCHOR)


@query("triage_sheet", f"SELECT * FROM {_TRIAGE_SQL}")
def triage_sheet(spark, sf):
    """Review sheet of the disagreements: excerpt, keyword hint, blank answers."""
    return _triage(spark, sf)


@query("triage_breakdown", f"SELECT auto_hint, count(*) AS n FROM {_TRIAGE_SQL} GROUP BY auto_hint")
def triage_breakdown(spark, sf):
    """How many disagreements carry each hint."""
    return _triage(spark, sf).groupBy("auto_hint").agg(F.count(F.lit(1)).alias("n"))


@query(
    "triage_hint",
    f"SELECT doc_id AS note_id, {_hint_sql(_excerpt_sql('text', 500, ANCHOR))} AS auto_hint FROM documents",
)
def triage_hint(spark, sf):
    """Keyword hint over every report's excerpt."""
    from ..functions.text import TRIAGE_LABELS, keyword_hint

    n = S.notes(spark, sf)
    exc = section_or_text(F.col("text"), 500, ANCHOR)
    return n.select("note_id", keyword_hint(exc, ACUTE, STABLE, TRIAGE_LABELS).alias("auto_hint"))


@query(
    "section_extract",
    f"""SELECT doc_id AS note_id, CASE WHEN regexp_matches(text, '(?i){ANCHOR}[:\\s]*([\\s\\S]+)')
      THEN regexp_replace(regexp_extract(text, '(?i){ANCHOR}[:\\s]*([\\s\\S]+)', 1), '^\\s+|\\s+$', '', 'g') END AS section
    FROM documents""",
)
def section_extract(spark, sf):
    """Text after the section anchor, whitespace-trimmed; NULL without anchor."""
    return S.notes(spark, sf).select("note_id", section(F.col("text"), ANCHOR).alias("section"))


@query("section_clean_truncate", f"SELECT doc_id AS note_id, {_excerpt_sql('text', 600, ANCHOR)} AS excerpt FROM documents")
def section_clean_truncate(spark, sf):
    """Section (or whole text), whitespace collapsed, first 600 characters."""
    return S.notes(spark, sf).select("note_id", section_or_text(F.col("text"), 600, ANCHOR).alias("excerpt"))


_REPLY_SQL = """CASE WHEN contains(t, 'positive') THEN 'Positive' WHEN contains(t, 'negative') THEN 'Negative'
  ELSE '?' || substring(t, 1, 15) END"""


@query(
    "reply_parse",
    f"""SELECT conv_id, turn, {_REPLY_SQL} AS ext_label FROM (SELECT conv_id, turn,
      lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS t FROM conversations WHERE role = 'assistant')""",
)
def reply_parse(spark, sf):
    """Free-text replies → label ('positive' wins, else 'negative', else '?'+15 chars)."""
    return A.reply_labels(S.replies(spark, sf)).select("conv_id", "turn", "ext_label")


@query(
    "json_path",
    f"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, {_REPLY_SQL} AS ext_label FROM (
      SELECT event_id, props, lower(regexp_replace(coalesce(json_extract_string(props, '$.k'), ''), '^\\s+|\\s+$', '', 'g')) AS t
      FROM events)""",
)
def json_path(spark, sf):
    """JSON path extraction from a reply column, then the reply parser."""
    ev = table(spark, sf, "events").select("event_id", "props")
    out = A.reply_labels(ev, "props", "$.k")
    return out.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "ext_label")


@query("prompt_table", f"SELECT doc_id AS note_id, {q(REPORT_PROMPT)} || coalesce(text, '') AS request FROM documents")
def prompt_table(spark, sf):
    """Request table: fixed instruction followed by each report."""
    return S.notes(spark, sf).select("note_id", prompt(REPORT_PROMPT, F.col("text")).alias("request"))


# --- gold sample, batches, unblinding -----------------------------------------


def _plan_sql(plan: dict) -> str:
    return ", ".join(f"('{a}', '{b}', {n})" for (a, b), n in plan.items())


def _sample_sql(plan: dict, seed: int, fmt: str, exclude: str = "") -> str:
    return f"""(WITH a AS (SELECT * FROM {_AUDIT_SQL} {exclude}), qt(regex_label, llm_label, quota) AS (VALUES {_plan_sql(plan)}),
    s AS (SELECT a.*, qt.quota, row_number() OVER (PARTITION BY a.regex_label, a.llm_label
            ORDER BY md5('{seed}:' || CAST(a.note_id AS VARCHAR)), a.note_id) AS cr FROM a JOIN qt USING (regex_label, llm_label)),
    p AS (SELECT * FROM s WHERE cr <= quota),
    r AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || CAST(note_id AS VARCHAR)), note_id) AS seq FROM p)
    SELECT printf('{fmt}', seq) AS review_id, note_id, regex_label, llm_label,
      substring(regex_label, 1, 3) || '/' || substring(llm_label, 1, 3) AS stratum, text FROM r)"""


def _gold(spark, sf, plan=GOLD_PLAN, seed=SEED, fmt="R%03d", base=None):
    base = base if base is not None else audit_base(spark, sf)
    smp, report = A.quota_sample(base, ["regex_label", "llm_label"], plan, "note_id", seed)
    return A.review_ids(smp, "note_id", seed, fmt, small=True), report


@query("gold_sample", f"SELECT review_id, note_id, regex_label, llm_label, stratum FROM {_sample_sql(GOLD_PLAN, SEED, 'R%03d')}")
def gold_sample(spark, sf):
    """Hidden key of the stratified gold sample (150/150/100/50 per cell, seeded)."""
    s, _ = _gold(spark, sf)
    return A.blind_key(s, "note_id", "regex_label", "llm_label")


@query(
    "gold_sample_shortage",
    f"""WITH a AS {_AUDIT_SQL}, qt(regex_label, llm_label, quota) AS (VALUES {_plan_sql(GOLD_PLAN)})
    SELECT qt.regex_label, qt.llm_label, qt.quota, coalesce(c.n, 0) AS available, CAST(least(qt.quota, coalesce(c.n, 0)) AS BIGINT) AS taken
    FROM qt LEFT JOIN (SELECT regex_label, llm_label, count(*) AS n FROM a GROUP BY 1, 2) c USING (regex_label, llm_label)""",
)
def gold_sample_shortage(spark, sf):
    """Per cell: quota, available rows and rows taken (shortage when taken < quota)."""
    _, report = _gold(spark, sf)
    return report.withColumn("taken", F.col("taken").cast("long")).withColumn("quota", F.col("quota").cast("int"))


@query(
    "blind_sheet",
    f"""SELECT review_id, {_excerpt_sql('text', 600, ANCHOR)} AS excerpt, '' AS true_label, '' AS finding_type,
      '' AS confidence, '' AS notes FROM {_sample_sql(GOLD_PLAN, SEED, 'R%03d')}""",
)
def blind_sheet(spark, sf):
    """Blinded sheet of the gold sample: review id, excerpt, blanks; no ids/labels."""
    s, _ = _gold(spark, sf)
    return A.blind_sheet(with_text(spark, sf, s), "text", 600, ANCHOR)


def _batch2(spark, sf):
    """Batch one is drawn and its ids stored; batch two is drawn from the reports that the stored
    state does not hold, and stored too. Returns (key of batch two, the stored ids)."""
    state = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batch-state-{uuid.uuid4().hex[:8]}"
    base = audit_base(spark, sf)
    b1, _ = _gold(spark, sf, BATCH1_PLAN, SEED + 1, "B1-%03d", base)
    A.store_batch(b1, state, "B1", "note_id")
    rest = base.join(A.stored_ids(spark, state, "note_id"), "note_id", "left_anti")
    b2, _ = _gold(spark, sf, A.scale_quota(BATCH1_PLAN, 100), SEED + 2, "B2-%03d", rest)
    b2 = cut_lineage(b2)
    A.store_batch(b2, state, "B2", "note_id")
    return b2, A.stored_ids(spark, state, "note_id")


_B1 = _sample_sql(BATCH1_PLAN, SEED + 1, "B1-%03d")
_B2 = _sample_sql(A.scale_quota(BATCH1_PLAN, 100), SEED + 2, "B2-%03d", f"WHERE note_id NOT IN (SELECT note_id FROM {_B1})")


@query("batch_two", f"SELECT review_id, note_id, regex_label, llm_label, stratum FROM {_B2}")
def batch_two(spark, sf):
    """Second annotation batch (template scaled to 100 → 38/31/19/12), disjoint
    from batch one through the sampled-id state."""
    b2, _ = _batch2(spark, sf)
    return A.blind_key(b2, "note_id", "regex_label", "llm_label")


@query("batch_state_union", f"SELECT note_id FROM {_B1} UNION SELECT note_id FROM {_B2}")
def batch_state_union(spark, sf):
    """Accumulated sampled-id state after two batches (set union)."""
    return _batch2(spark, sf)[1]


_UNBLIND_SQL = f"""(SELECT k.review_id, k.note_id, k.regex_label, k.llm_label, k.stratum,
    CASE WHEN l.quality = 1 THEN 'Positive' ELSE 'Negative' END AS gold_label
  FROM {_sample_sql(GOLD_PLAN, SEED, 'R%03d')} k JOIN labels l ON k.note_id = l.doc_id)"""


def _unblinded(spark, sf, base=None):
    """Sheet ⋈ hidden key on the review id (checked to be 1:1), then ⋈ gold on the report id."""
    s, _ = _gold(spark, sf, base=base)
    s = cut_lineage(s)
    sheet = A.blind_sheet(with_text(spark, sf, s), "text", 600, ANCHOR)
    key = A.blind_key(s, "note_id", "regex_label", "llm_label")
    return A.unblind(sheet, key).join(S.gold(spark, sf).select("note_id", "gold_label"), "note_id")


@query(
    "unblind_and_score",
    f"""WITH j AS {_UNBLIND_SQL}, c AS (SELECT count(*) FILTER (WHERE gold_label = 'Positive' AND regex_label = 'Positive') AS tp,
      count(*) FILTER (WHERE gold_label <> 'Positive' AND regex_label = 'Positive') AS fp,
      count(*) FILTER (WHERE gold_label = 'Positive' AND regex_label <> 'Positive') AS fn,
      count(*) FILTER (WHERE gold_label <> 'Positive' AND regex_label <> 'Positive') AS tn FROM j)
    SELECT *, round(tp / nullif(tp + fn, 0), {D}) AS sensitivity, round(tn / nullif(tn + fp, 0), {D}) AS specificity,
      round(tp / nullif(tp + fp, 0), {D}) AS ppv, round(tn / nullif(tn + fn, 0), {D}) AS npv FROM c""",
)
def unblind_and_score(spark, sf):
    """Sheet ⋈ key on the review id (1:1), ⋈ gold labels on the report id, then the rule labeller's
    sensitivity / specificity / PPV / NPV on the sample."""
    j = _unblinded(spark, sf)
    return rnd(M.rates(M.confusion(j, F.col("gold_label") == "Positive", F.col("regex_label") == "Positive")))


@query(
    "weighted_rates",
    f"""WITH j AS {_UNBLIND_SQL}, pop AS (SELECT regex_label, llm_label, count(*) AS nn FROM {_AUDIT_SQL} GROUP BY 1, 2),
    smp AS (SELECT regex_label, llm_label, count(*) AS ns FROM j GROUP BY 1, 2),
    w AS (SELECT j.*, CAST(pop.nn AS DOUBLE) / smp.ns AS w, gold_label = 'Positive' AS t, regex_label = 'Positive' AS p
          FROM j JOIN pop USING (regex_label, llm_label) JOIN smp USING (regex_label, llm_label)),
    a AS (SELECT sum(CASE WHEN t AND p THEN w ELSE 0 END) AS w_tp, sum(CASE WHEN NOT t AND p THEN w ELSE 0 END) AS w_fp,
                 sum(CASE WHEN t AND NOT p THEN w ELSE 0 END) AS w_fn, sum(CASE WHEN NOT t AND NOT p THEN w ELSE 0 END) AS w_tn FROM w)
    SELECT round(w_tp, 6) AS w_tp, round(w_fp, 6) AS w_fp, round(w_fn, 6) AS w_fn, round(w_tn, 6) AS w_tn,
      round(w_tp / nullif(w_tp + w_fn, 0), 6) AS sensitivity, round(w_tn / nullif(w_tn + w_fp, 0), 6) AS specificity FROM a""",
)
def weighted_rates(spark, sf):
    """Sensitivity / specificity re-weighted from the over-sampled gold cells to the
    whole labelled population (weight N_cell / n_cell)."""
    pop = audit_base(spark, sf)  # labelled once: the sample and the population read it
    j = _unblinded(spark, sf, pop)
    j = j.withColumn("t", (F.col("gold_label") == "Positive").cast("int")).withColumn("pp", (F.col("regex_label") == "Positive").cast("int"))
    return rnd(A.weighted_rates(j, ["regex_label", "llm_label"], pop, "t", "pp"), 6)


@query(
    "adjudicate",
    f"""SELECT note_id, CASE WHEN r1 = r2 THEN r1 ELSE r3 END AS final_label,
      CASE WHEN r1 = r2 THEN 'agreement' WHEN r3 IS NOT NULL THEN 'third rater' ELSE 'unresolved' END AS resolved_by
    FROM (SELECT l.doc_id AS note_id, CASE WHEN l.quality = 1 THEN 'Positive' ELSE 'Negative' END AS r1,
      CASE WHEN l.toxic = 1 THEN 'Positive' ELSE 'Negative' END AS r2,
      CASE WHEN ({sql_label('d.text', STANDIN_WIDE)}) = 'Positive' THEN 'Positive' ELSE 'Negative' END AS r3
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
)
def adjudicate(spark, sf):
    """Two raters; a third decides their disagreements."""
    g = S.gold(spark, sf)
    lab = LB.label_text(S.notes(spark, sf), STANDIN_WIDE, subtype_out=None)
    r3 = F.when(F.col("label") == "Positive", F.lit("Positive")).otherwise(F.lit("Negative"))
    j = g.join(lab.select("note_id", r3.alias("rater3")), "note_id")
    return A.adjudicate(j, "rater1", "rater2", "rater3").select("note_id", "final_label", "resolved_by")
