"""Rule-cascade labelling of report text and the class-distribution report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    AnchorIndex, RuleSet, ascii_fold, bodies_of, check_rules, label_column, longest_match, normalize_ws, subtype_column,
)
from .cohort import exam_notes


def label_text(
    df: DataFrame,
    rules: RuleSet,
    text_col: str = "text",
    out: str = "label",
    subtype_out: str | None = "subtype",
    normalize_whitespace: bool = False,
    subtype_only_for: str | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Add ``out`` (and ``subtype_out``) from ``rules``; map-only, no shuffle.

    The text column is dropped afterwards unless ``keep_text``: report bodies
    should not travel through later shuffles. ``subtype_only_for`` gates the
    subtype on one label (the published SQL subtypes every row).
    """
    return label_versions(df, {out: (rules, subtype_out)}, text_col, normalize_whitespace, subtype_only_for, keep_text)


def label_versions(
    df: DataFrame,
    versions: Mapping[str, tuple[RuleSet, str | None]],
    text_col: str = "text",
    normalize_whitespace: bool = False,
    subtype_only_for: str | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Several label columns in one pass: ``versions`` maps each to its rules and the name of its
    subtype column (or None). The text is folded once, and cut after its anchors once for each
    pair of anchors and window."""
    text = F.col(text_col)
    if normalize_whitespace:
        text = normalize_ws(text)
    res = df.withColumn("_folded", ascii_fold(text))
    indexes: dict[tuple[str, int], AnchorIndex] = {}
    for rules, _ in versions.values():
        check_rules(rules)
        at = (rules.anchors.lower(), rules.window)
        if at not in indexes:
            same = [r for r, _ in versions.values() if (r.anchors.lower(), r.window) == at]
            indexes[at] = AnchorIndex(rules, f"_a{len(indexes)}")
            res = indexes[at].add(res, "_folded", max(longest_match(b) for r in same for b in bodies_of(r)))
    cols = {}
    for out, (rules, subtype_out) in versions.items():
        index = indexes[rules.anchors.lower(), rules.window]
        cols[out] = label_column(F.col("_folded"), index, rules)
        if subtype_out:
            st = subtype_column(F.col("_folded"), index, rules)
            if subtype_only_for is not None:
                st = F.when(cols[out] == subtype_only_for, st)
            cols[subtype_out] = st
    res = res.withColumns(cols).select(*[c for c in df.columns if c not in cols], *cols)
    return res if keep_text else res.drop(text_col)


def class_distribution(df: DataFrame, label_col: str = "label", decimals: int = 2) -> DataFrame:
    """``label, n, percent`` ordered by n desc (tie: label). Percent of all rows,
    rounded half-up. The window runs over the aggregate (one row per class)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(F.col("n") * F.lit(100.0) / total, decimals).cast("double")).orderBy(
        F.desc("n"), F.asc(label_col)
    )


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tab ``(a, b, n)`` of two label columns (NULL labels kept)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, levels: list[str]) -> DataFrame:
    """Row label ``a`` × fixed column levels of ``b``; zero-filled counts."""
    return df.groupBy(a).pivot(b, levels).agg(F.count(F.lit(1))).fillna(0, subset=levels)


def label_exam_notes(
    notes: DataFrame,
    details: DataFrame,
    exams: list[str] | tuple[str, ...],
    rules: RuleSet,
    require_admission: bool = False,
    subtype_out: str | None = None,
) -> DataFrame:
    """notes ⋈ exam details → labels, without moving report text through a shuffle.

    Only notes whose exam is asked for are labelled (semi join on the note id; AQE
    chooses a broadcast by measured bytes), and the text is dropped before the
    (fan-out preserving) join with the details.
    """
    sel = details.where(F.col("field_value").isin(list(exams))).select("note_id").distinct()
    labelled = label_text(notes.join(sel, "note_id", "left_semi"), rules, subtype_out=subtype_out)
    return exam_notes(labelled, details, exams, require_admission)
