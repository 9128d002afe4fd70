"""Quota scaling, gold sample cells, blind sheets, batch disjointness, external
labeller error capture, CSV source with embedded newlines."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldlens.operators import audit as A
from yieldlens.sources.io import read_reports_csv

CELLS = ["regex_label", "llm_label"]


def test_scale_quota():
    t = {("N", "P"): 30, ("P", "N"): 25, ("N", "N"): 15, ("P", "P"): 10}
    assert list(A.scale_quota(t, 100).values()) == [38, 31, 19, 12]
    assert sum({("a", "b"): 150, ("b", "a"): 150, ("a", "a"): 100, ("b", "b"): 50}.values()) == 450


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, ["Negative", "Positive"][i % 2], ["Negative", "Positive"][(i // 2) % 2], f"IMPRESSION: report {i}") for i in range(200)]
    return spark.createDataFrame(rows, "note_id long, regex_label string, llm_label string, text string")


def test_quota_sample_shortage_and_blindness(labelled):
    plan = {("Negative", "Positive"): 10, ("Positive", "Negative"): 80, ("Negative", "Negative"): 5, ("Positive", "Positive"): 0}
    smp, report = A.quota_sample(labelled, CELLS, plan, "note_id", 42)
    rep = {(r.regex_label, r.llm_label): (r.quota, r.available, r.taken) for r in report.collect()}
    assert rep[("Positive", "Negative")] == (80, 50, 50)  # shortage: all 50 taken
    assert smp.count() == 10 + 50 + 5
    ids = A.review_ids(smp, "note_id", 42)
    sheet = A.blind_sheet(ids, "text")
    assert not {"note_id", "regex_label", "llm_label"} & set(sheet.columns)
    key = A.blind_key(ids, "note_id", "regex_label", "llm_label")
    assert key.select("review_id").distinct().count() == 65
    assert set(r.stratum for r in key.collect()) == {"Neg/Pos", "Pos/Neg", "Neg/Neg"}


def test_second_batch_disjoint(labelled):
    plan = {("Negative", "Positive"): 10, ("Positive", "Negative"): 10}
    b1, _ = A.quota_sample(labelled, CELLS, plan, "note_id", 43)
    rest = labelled.join(b1.select("note_id"), "note_id", "left_anti")
    b2, _ = A.quota_sample(rest, CELLS, plan, "note_id", 44)
    assert b1.join(b2, "note_id").count() == 0


def test_external_label_captures_errors_and_resumes(spark):
    def _flaky(texts: pd.Series) -> pd.Series:
        if texts.str.contains("boom").any():
            if len(texts) > 1:
                raise RuntimeError("batch failed")
            raise ValueError("bad row")
        return texts.str.upper()

    df = spark.createDataFrame([(1, "positive finding"), (2, "boom"), (3, "negative")], "note_id long, text string")
    out = {r.note_id: r for r in A.external_label(df, "note_id", "text", _flaky).collect()}
    assert out[1].ext_label == "Positive" and out[3].ext_label == "Negative"
    assert out[2].ext_label == "ERR" and out[2].error.startswith("ValueError")
    done = spark.createDataFrame([(1, "Positive")], "note_id long, ext_label string")
    assert {r.note_id for r in A.external_label(df, "note_id", "text", _flaky, done).collect()} == {2, 3}


def test_multiline_csv(spark, tmp_path):
    p = tmp_path / "reports.csv"
    p.write_text(
        'note_id,subject_id,hadm_id,charttime,exam_name,text\n'
        '1,10,100,2024-01-01 10:00:00,CT HEAD W/O CONTRAST,"FINDINGS: line one\nline ""two""\nIMPRESSION: none"\n'
        '2,11,,2024-01-02 11:00:00,CT HEAD W/ CONTRAST,"short"\n'
    )
    df = read_reports_csv(spark, str(p))
    rows = df.orderBy("note_id").collect()
    assert len(rows) == 2 and rows[0].text.count("\n") == 2 and '"two"' in rows[0].text
    assert rows[1].hadm_id is None


def test_agreement_counts(spark):
    df = spark.createDataFrame([("Positive", "Positive"), ("Negative", "Positive"), ("Unclear", "Negative"), (None, "Negative")], "a string, b string")
    r = A.agreement(df, "a", "b").first()
    assert (r.n_total, r.n_comparable, r.n_agree) == (4, 2, 1)


def test_input_guard_and_export_gate(spark, tmp_path):
    from yieldlens.operators.quality import MissingInputError, assert_aggregate_only
    from yieldlens.sources.io import require_input, write_result

    with pytest.raises(MissingInputError):
        require_input(spark, str(tmp_path / "absent.parquet"), ["note_id"], "gold labels")
    agg = spark.createDataFrame([("Positive", 12), ("Negative", 3)], "label string, n long")
    with pytest.raises(AssertionError):
        assert_aggregate_only(agg, ["note_id", "text"], min_cell=5)  # a cell below 5
    rows = spark.createDataFrame([("1", "x")], "note_id string, text string")
    with pytest.raises(AssertionError):
        write_result(rows, str(tmp_path / "out"), forbidden=["note_id", "text"])
    write_result(agg.where("n >= 5"), str(tmp_path / "ok"), forbidden=["note_id", "text"])
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    with pytest.raises(Exception):
        require_input(spark, str(tmp_path / "ok"), ["note_id"], "export")  # lacks the column


def test_version_drift_and_keep_first(spark):
    from yieldlens.operators.cohort import keep_first

    a = spark.createDataFrame([(1, "s", "Negative"), (2, "s", "Positive"), (3, "t", "Negative")], "note_id long, subj string, label_a string")
    b = spark.createDataFrame([(1, "s", "Positive"), (2, "s", "Positive"), (4, "t", "Negative")], "note_id long, subj string, label_b string")
    cells = {(r.label_a, r.label_b): (r.n, r.differs) for r in A.version_drift(a, b, ["note_id", "subj"], "label_a", "label_b").collect()}
    assert cells == {("Negative", "Positive"): (1, 1), ("Positive", "Positive"): (1, 0)}  # note 3/4 unmatched
    dup = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("k", 2, "b"), ("j", 5, "z")], "key string, ord int, v string")
    got = {r.key: (r.ord, r.v) for r in keep_first(dup, ["key"], ["ord"]).collect()}
    assert got == {"k": (1, "a"), "j": (5, "z")}


def test_external_labeller_gets_bounded_slices(spark):
    """One Arrow batch of 3,000 texts reaches the labeller in slices (in one piece before)."""
    df = spark.range(3000).selectExpr("id AS note_id", "if(id % 7 = 0, null, concat('t', id)) AS text").coalesce(1)
    out = A.external_label(df, "note_id", "text", lambda t: pd.Series([f"{len(t)}:{x}" for x in t], index=t.index)).collect()
    assert {r.note_id: r.reply.split(":")[1] for r in out} == {i: "" if i % 7 == 0 else f"t{i}" for i in range(3000)}
    assert max(int(r.reply.split(":")[0]) for r in out) <= 512
