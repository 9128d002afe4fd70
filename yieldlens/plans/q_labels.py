"""Labelling queries (C1): rule cascades, distribution, version drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import RULES_A, RULES_B, RULES_C, STANDIN_NARROW, STANDIN_REDUCED, STANDIN_WIDE
from ..operators.labeling import class_distribution, label_exam_notes, label_text, label_versions
from ..session import cut_lineage
from ..sources import standins as S
from .registry import q, query
from .sqltext import sql_label, sql_subtype

EXAMS = ("en", "fr", "de")
PUBLISHED = {"label_a": (RULES_A, "subtype_a"), "label_b": (RULES_B, None), "label_c": (RULES_C, None)}

_NOTES_SQL = "(SELECT doc_id AS note_id, source AS subject_id, lang AS hadm_id, n_chars AS chart_order, text FROM documents)"


@query(
    "label_wide",
    f"SELECT doc_id AS note_id, {sql_label('text', STANDIN_WIDE)} AS label, "
    f"{sql_subtype('text', STANDIN_WIDE)} AS subtype FROM documents",
)
def label_wide(spark, sf):
    """Wide rule set over every report: (note_id, label, subtype)."""
    return label_text(S.notes(spark, sf), STANDIN_WIDE).select("note_id", "label", "subtype")


@query(
    "label_narrow",
    f"SELECT doc_id AS note_id, {sql_label('text', STANDIN_NARROW)} AS label, "
    f"{sql_subtype('text', STANDIN_NARROW)} AS subtype FROM documents",
)
def label_narrow(spark, sf):
    """Narrow rule set (one anchor, shorter window) over every report."""
    return label_text(S.notes(spark, sf), STANDIN_NARROW).select("note_id", "label", "subtype")


@query(
    "label_reduced",
    f"SELECT doc_id AS note_id, {sql_label('text', STANDIN_REDUCED)} AS label FROM documents",
)
def label_reduced(spark, sf):
    """Reduced two-class labeller: Positive terms and no Negative terms → Positive."""
    return label_text(S.notes(spark, sf), STANDIN_REDUCED, subtype_out=None).select("note_id", "label")


@query(
    "label_published_rules",
    f"SELECT doc_id AS note_id, {sql_label('text', RULES_A)} AS label_a, {sql_subtype('text', RULES_A)} AS subtype_a, "
    f"{sql_label('text', RULES_B)} AS label_b, {sql_label('text', RULES_C)} AS label_c FROM documents",
)
def label_published_rules(spark, sf):
    """The three published rule sets over every report in one pass."""
    return label_versions(S.notes(spark, sf), PUBLISHED).select("note_id", "label_a", "subtype_a", "label_b", "label_c")


def _reports_sql() -> str:
    text = "text"
    for word, term in S.REPORT_WORDS:
        text = f"replace({text}, {q(word)}, {q(term)})"
    return f"(SELECT doc_id AS note_id, {text} AS text FROM documents)"


@query(
    "label_anchored_reports",
    f"SELECT note_id, {sql_label('text', RULES_A)} AS label_a, {sql_subtype('text', RULES_A)} AS subtype_a, "
    f"{sql_label('text', RULES_B)} AS label_b, {sql_label('text', RULES_C)} AS label_c FROM {_reports_sql()}",
)
def label_anchored_reports(spark, sf):
    """The three published rule sets over reports that hold their anchors and terms."""
    return label_versions(S.reports(spark, sf), PUBLISHED).select("note_id", "label_a", "subtype_a", "label_b", "label_c")


_DIST_SQL = f"""
WITH lab AS (
  SELECT {sql_label('n.text', STANDIN_WIDE)} AS label
  FROM documents n JOIN (SELECT doc_id AS note_id, lang AS field_value FROM documents) d ON n.doc_id = d.note_id
  WHERE d.field_value IN ('en', 'fr', 'de') AND n.lang IS NOT NULL)
SELECT label, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS percent
FROM lab GROUP BY label ORDER BY n DESC, label
"""


@query("label_distribution", _DIST_SQL)
def label_distribution(spark, sf):
    """The published final query: notes ⋈ exam details (exam IN list, admission not
    NULL) → rule labels → class counts and percent of total, by count desc."""
    lab = label_exam_notes(S.notes(spark, sf), S.note_details(spark, sf), EXAMS, STANDIN_WIDE, require_admission=True)
    return class_distribution(lab)


@query(
    "label_subtype",
    f"""SELECT label, subtype, count(*) AS n FROM (
      SELECT {sql_label('text', STANDIN_WIDE)} AS label, {sql_subtype('text', STANDIN_WIDE)} AS subtype
      FROM documents) GROUP BY label, subtype""",
)
def label_subtype(spark, sf):
    """Counts per (label, subtype) — subtypes are assigned to every row."""
    lab = label_text(S.notes(spark, sf), STANDIN_WIDE)
    return lab.groupBy("label", "subtype").agg(F.count(F.lit(1)).alias("n"))


_VERSION_SQL = f"""
WITH a AS (SELECT doc_id, source, lang, n_chars, {sql_label('text', STANDIN_WIDE)} AS label_a FROM documents),
     b AS (SELECT doc_id, source, lang, n_chars, {sql_label('text', STANDIN_NARROW)} AS label_b FROM documents)
SELECT label_a, label_b, count(*) AS n, CAST(label_a <> label_b AS INTEGER) AS differs
FROM a JOIN b USING (doc_id, source, lang, n_chars)
GROUP BY label_a, label_b
"""


@query("label_version_disagreement", _VERSION_SQL)
def label_version_disagreement(spark, sf):
    """Two label versions joined on the four-column order key; counts per
    (old, new) cell with a differs flag."""
    from ..operators.audit import version_drift

    key = ["note_id", "subject_id", "hadm_id", "chart_order"]
    # both versions from one pass over the texts; the tables that are joined are narrow
    both = label_versions(S.notes(spark, sf), {"label_a": (STANDIN_WIDE, None), "label_b": (STANDIN_NARROW, None)})
    both = cut_lineage(both.select(*key, "label_a", "label_b"))
    return version_drift(both, both, key, "label_a", "label_b")


@query(
    "label_with_sequence",
    f"""SELECT n.source AS subject_id, n.lang AS hadm_id, n.doc_id AS note_id, n.n_chars AS chart_order, d.lang AS exam,
      CASE WHEN regexp_matches(n.text, '(?i)that[:\\s]*([\\s\\S]+)')
        THEN regexp_replace(regexp_extract(n.text, '(?i)that[:\\s]*([\\s\\S]+)', 1), '^\\s+|\\s+$', '', 'g') END AS impression,
      {sql_label('n.text', STANDIN_NARROW)} AS label, {sql_subtype('n.text', STANDIN_NARROW)} AS subtype,
      row_number() OVER (PARTITION BY n.source, n.lang ORDER BY n.n_chars, n.doc_id) AS seq
    FROM documents n JOIN documents d ON n.doc_id = d.doc_id WHERE d.lang IN ('en', 'fr', 'de')""",
)
def label_with_sequence(spark, sf):
    """The published row-level query: exam-filtered reports with the section
    excerpt, narrow-rule label and subtype and the sequence number per (patient,
    admission), ordered by patient, admission, sequence."""
    from ..functions.text import section
    from ..operators.cohort import exam_notes, scan_sequence

    n = S.notes(spark, sf).withColumn("impression", section(F.col("text"), "that"))
    lab = label_text(n, STANDIN_NARROW)  # text dropped after labelling
    j = exam_notes(lab, S.note_details(spark, sf), EXAMS)
    seq = scan_sequence(j, ["subject_id", "hadm_id"], ["chart_order", "note_id"], "seq")
    return seq.select("subject_id", "hadm_id", "note_id", "chart_order", "exam", "impression", "label", "subtype", "seq").orderBy(
        "subject_id", "hadm_id", "seq"
    )
