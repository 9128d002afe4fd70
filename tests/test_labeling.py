"""Rule-cascade labelling on invented reports, checked against a brute-force
Python evaluation of the same rules (anchor end within N chars of a term start)."""

import random
import re

import pytest

from yieldlens.functions.text import RULES_A, RULES_B, RULES_C, STANDIN_WIDE, ClassRule, RuleSet
from yieldlens.operators.labeling import class_distribution, label_text, label_versions


def brute_match(text, rules: RuleSet, body: str) -> bool:
    if text is None:
        return False
    ends = [m.start() + len(a) for a in rules.anchors.split("|") for m in re.finditer(f"(?i)(?={re.escape(a)})", text)]
    starts = [m.start() for m in re.finditer(f"(?i)(?=(?:{body}))", text)]
    return any(0 <= s - e <= rules.window for e in ends for s in starts)


def brute_label(text, rules: RuleSet):
    for c in rules.classes:
        ok = brute_match(text, rules, c.include)
        if ok and c.exclude is not None and brute_match(text, rules, c.exclude):
            ok = False
        if ok:
            return c.label
    return rules.default


REPORTS = [
    "FINDINGS: There is an acute subdural hematoma along the left convexity.\nIMPRESSION: Acute subdural hematoma.",
    "IMPRESSION: No acute intracranial abnormality.",
    "FINDINGS: Chronic small vessel disease. IMPRESSION: no hemorrhage. Old infarct in the right occipital lobe.",
    "History: fall. FINDINGS: Status post craniotomy with expected post-surgical changes.",
    "The findings were discussed with the team. Large hemorrhage noted.",  # lower-case anchor in prose
    "IMPRESSION:" + " " * 795 + "edema",  # term starts 800 chars after the anchor end? (with ':')
    "IMPRESSION" + "x" * 800 + "edema",  # exactly N characters between anchor and term
    "IMPRESSION" + "x" * 801 + "edema",  # N + 1: out of the window
    "IMPRESSION: mass\neffect on the ventricle",  # line break inside a term defeats it
    "IMPRESSION: no acute\nintracranial hemorrhage. Fracture of the skull.",
    "No anchor at all, just a hematoma.",
    "",
    None,
    "FINDINGS: edema. IMPRESSION: without evidence of acute infarct.",
    "IMPRESSION: small bleed; no fracture",
    "IMPRESSION" * 400 + "x" * 800 + "edema",  # many anchors; the last one is just near enough
    "IMPRESSION" * 400 + "x" * 801 + "edema",
    "IMPRESSION" + "x" * 900 + "FINDINGSedema",  # a term right after the second anchor's end
]


@pytest.mark.parametrize("rules", [RULES_A, RULES_B, RULES_C, STANDIN_WIDE], ids=lambda r: r.name)
def test_cascade_matches_brute_force(spark, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(REPORTS)], "note_id int, text string")
    got = {r.note_id: r.label for r in label_text(df, rules, subtype_out=None).collect()}
    want = {i: brute_label(t, rules) for i, t in enumerate(REPORTS)}
    assert got == want


def test_window_edges(spark):
    df = spark.createDataFrame([(6, REPORTS[6]), (7, REPORTS[7]), (8, REPORTS[8])], "note_id int, text string")
    got = {r.note_id: r.label for r in label_text(df, RULES_A, subtype_out=None).collect()}
    assert got[6] == "Positive" and got[7] == "Unclear"
    assert got[8] == "Unclear"  # 'mass\neffect' is not 'mass effect'


def test_null_text_is_default_and_subtype_not_gated(spark):
    df = spark.createDataFrame([(1, None), (2, "IMPRESSION: no hemorrhage.")], "note_id int, text string")
    rows = {r.note_id: r for r in label_text(df, RULES_A).collect()}
    assert rows[1].label == "Unclear" and rows[1].subtype is None
    assert rows[2].label == "Negative" and rows[2].subtype == "Hemorrhage"  # subtypes every row
    gated = {r.note_id: r for r in label_text(df, RULES_A, subtype_only_for="Positive").collect()}
    assert gated[2].subtype is None


def test_distribution_percent(spark):
    df = spark.createDataFrame([("Negative",)] * 3383 + [("Positive",)] * 1004 + [("Unclear",)] * 169 + [("Post-surgical/Unchanged",)] * 82, "label string")
    got = {r.label: (r.n, r.percent) for r in class_distribution(df).collect()}
    assert got["Negative"] == (3383, 72.94) and got["Positive"] == (1004, 21.65)
    assert got["Unclear"] == (169, 3.64) and got["Post-surgical/Unchanged"] == (82, 1.77)
    assert [r.label for r in class_distribution(df).collect()][0] == "Negative"


def test_exam_filter_paths_agree(spark):
    from yieldlens.operators.labeling import label_exam_notes

    notes = spark.createDataFrame([(i, 1, 10 if i % 4 else None, t) for i, t in enumerate(REPORTS)], "note_id int, subject_id int, hadm_id int, text string")
    details = spark.createDataFrame(
        [(i, "CT HEAD W/O CONTRAST") for i in range(len(REPORTS))] + [(1, "CT HEAD W/ CONTRAST"), (2, "MR HEAD")],
        "note_id int, field_value string",
    )
    exams = ["CT HEAD W/O CONTRAST", "CT HEAD W/ CONTRAST"]
    a = label_exam_notes(notes, details, exams, RULES_A, require_admission=True)
    b = label_exam_notes(notes, details, exams, RULES_A, require_admission=True)
    assert "text" not in a.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.where("note_id = 1").count() == 2  # two matching detail rows: fan-out kept


def test_term_inside_the_next_anchor(spark):
    """A term may begin within an anchor: only anchors that end before it count."""
    rules = RuleSet("t", "seen|seedema", 6, (ClassRule("Hit", "edema|dem"),), "None")
    texts = ["seenxxseedema", "seen" + "x" * 5 + "seedema", "seen" + "x" * 3 + "seedema", "seedema", "seedemaedema", "seen" * 50 + "edema"]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string")
    got = {r.note_id: r.label for r in label_text(df, rules, subtype_out=None).collect()}
    assert got == {i: brute_label(t, rules) for i, t in enumerate(texts)}
    assert set(got.values()) == {"Hit", "None"}


def test_random_reports_match_brute_force(spark):
    """Terms, anchors and fillers in random order with small windows: ends of windows, gaps, terms over gaps."""
    rng = random.Random(9)
    rules = [
        RuleSet("r1", "seen|enda", 7, (ClassRule("One", "abc|cab"), ClassRule("Two", "bb", "(no |ab)?(cd|bb)a"), ClassRule("Three", "a.c|dd")), "None", (("s", "dab"), ("t", "c"))),
        RuleSet("r2", "seen", 0, (ClassRule("One", "abc"), ClassRule("Two", "b")), "None"),
        RuleSet("r3", "SEEN|enda", 7, (ClassRule("One", "b[^x]a"), ClassRule("Two", "a+d")), "None"),
    ]
    parts = ["seen", "enda", "SeEn", "abc", "cab", "bb", "dd", "a", "b", "c", "d", "no ", "xxxxxx", "x", "\n", "\u0000", "é", "\U0001f600", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string")
    got = label_versions(df, {"l1": (rules[0], "s1"), "l2": (rules[1], None), "l3": (rules[2], None)}).collect()
    for r in got:
        t = texts[r.note_id]
        assert (r.l1, r.l2, r.l3) == tuple(brute_label(t, x) for x in rules), t
        assert r.s1 == next((n for n, b in rules[0].subtypes if brute_match(t, rules[0], b)), None)
    assert {r.l1 for r in got} == {"One", "Two", "Three", "None"}
