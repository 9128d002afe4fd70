"""Cohort queries: exam join, scan sequence, repeat flag, de-duplication, joins,
code exclusion, stratum exclusion, attrition flow, time context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators.context import hours_and_shift
from ..session import table
from ..sources import standins as S
from .registry import query

_ORDERS_SQL = """(SELECT event_id AS order_id, user_id AS subject_id, date_trunc('day', ts) AS hadm_id,
  user_id AS stay_id, ts AS t0, 'unit' || CAST(user_id % 9 AS VARCHAR) AS unit,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS code, CAST(value >= 50 AS INTEGER) AS y
  FROM events WHERE event_type = 'error')"""


@query(
    "note_detail_join",
    """SELECT n.doc_id AS note_id, n.source AS subject_id, d.lang AS exam
    FROM documents n JOIN documents d ON n.doc_id = d.doc_id WHERE d.lang IN ('en', 'de')""",
)
def note_detail_join(spark, sf):
    """notes ⋈ details on note_id, exam value IN list (filter pushed to the scan)."""
    j = C.exam_notes(S.notes(spark, sf), S.note_details(spark, sf), ["en", "de"])
    return j.select("note_id", "subject_id", "exam")


@query(
    "scan_sequence",
    """SELECT doc_id AS note_id, source AS subject_id, lang AS hadm_id,
    row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS seq FROM documents""",
)
def scan_sequence(spark, sf):
    """Sequence number per (patient, admission) by chart order then note id."""
    n = S.notes(spark, sf).select("note_id", "subject_id", "hadm_id", "chart_order")
    return C.scan_sequence(n, ["subject_id", "hadm_id"], ["chart_order", "note_id"]).select(
        "note_id", "subject_id", "hadm_id", "seq"
    )


@query(
    "repeat_flag",
    f"""SELECT order_id, CASE WHEN row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY t0, order_id) > 1
    THEN 1 ELSE 0 END AS is_repeat FROM {_ORDERS_SQL}""",
)
def repeat_flag(spark, sf):
    """First vs repeat order inside an admission (by time, then order id)."""
    o = S.index_orders(spark, sf)
    return C.repeat_flag(o, ["subject_id", "hadm_id"], "t0", "order_id").select("order_id", "is_repeat")


@query(
    "keep_first_by_key",
    """SELECT md5(text) AS text_key, doc_id AS note_id, source AS subject_id FROM (
      SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def keep_first_by_key(spark, sf):
    """One report per duplicate key (exact copies share the key), first by note id."""
    n = S.notes(spark, sf).select(F.md5("text").alias("text_key"), "note_id", "subject_id")
    return C.keep_first(n, ["text_key"], ["note_id"])


@query(
    "semi_flagged",
    "SELECT doc_id AS note_id, source AS subject_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def semi_flagged(spark, sf):
    """Reports present in the flagged list (left semi join)."""
    flagged = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("note_id"))
    return C.semi(S.notes(spark, sf).select("note_id", "subject_id"), flagged, "note_id")


@query(
    "anti_done",
    "SELECT doc_id AS note_id, source AS subject_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def anti_done(spark, sf):
    """Reports not yet labelled (left anti join against the done list)."""
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("note_id"))
    return C.anti(S.notes(spark, sf).select("note_id", "subject_id"), done, "note_id")


@query(
    "lookup_left",
    "SELECT d.doc_id AS note_id, l.quality AS gold FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def lookup_left(spark, sf):
    """Dictionary lookup: label per report, NULL when absent."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("note_id"), "quality")
    return C.lookup(S.notes(spark, sf).select("note_id"), lab, "note_id", "quality", "gold")


@query(
    "merge_on_order_key",
    """SELECT o.o_orderkey, o.o_totalprice, c.c_mktsegment, c.c_acctbal
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def merge_on_order_key(spark, sf):
    """Left merge of attributes onto every order row, with key uniqueness asserted on
    the attribute side (a duplicate key would silently fan rows out)."""
    from ..operators.quality import assert_unique

    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    assert_unique(cust, ["o_custkey"])
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(cust, "o_custkey", "left").drop("o_custkey")


@query(
    "exclude_by_code",
    f"""SELECT order_id, subject_id FROM {_ORDERS_SQL} o
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.subject_id AND date_trunc('day', e.ts) = o.hadm_id
      AND CAST(json_extract_string(e.props, '$.k') AS INTEGER) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))""",
)
def exclude_by_code(spark, sf):
    """Drop index events whose admission (patient, day) carries any listed code."""
    ev = table(spark, sf, "events")
    dx = ev.select(
        F.col("user_id").alias("subject_id"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("hadm_id"),
        F.get_json_object("props", "$.k").cast("int").alias("code"),
    )
    codes = table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("code"))
    o = S.index_orders(spark, sf).select("order_id", "subject_id", "hadm_id")
    return C.exclude_by_codes(o, dx, codes, ["subject_id", "hadm_id"]).select("order_id", "subject_id")


@query(
    "exclude_strata",
    f"SELECT order_id, unit FROM {_ORDERS_SQL} WHERE unit NOT IN ('unit0', 'unit1', 'unit2')",
)
def exclude_strata(spark, sf):
    """Row mask removing listed strata (cohort-sensitivity subset)."""
    o = S.index_orders(spark, sf)
    return o.where(~F.coalesce(F.col("unit").isin("unit0", "unit1", "unit2"), F.lit(False))).select("order_id", "unit")


_ATTR_SQL = f"""
WITH o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY t0, order_id) > 1
             THEN 1 ELSE 0 END AS is_repeat FROM {_ORDERS_SQL}),
c AS (SELECT subject_id, hadm_id, stay_id,
       coalesce(y IS NOT NULL, false) AS c1, coalesce(is_repeat = 0, false) AS c2,
       coalesce(unit NOT IN ('unit0', 'unit1', 'unit2'), false) AS c3 FROM o),
t AS (SELECT subject_id, hadm_id, stay_id,
       CAST(c1 AS INTEGER) + CAST(c1 AND c2 AS INTEGER) + CAST(c1 AND c2 AND c3 AS INTEGER) AS k FROM c),
s AS (SELECT * FROM (VALUES (0, 'all'), (1, 'outcome recorded'), (2, 'first order of admission'),
       (3, 'outside excluded units')) v(step, step_name))
SELECT CAST(step AS INTEGER) AS step, step_name,
  (SELECT count(*) FROM t WHERE k >= s.step) AS n_rows,
  (SELECT count(DISTINCT subject_id) FROM t WHERE k >= s.step) AS n_subject_id,
  (SELECT count(DISTINCT hadm_id) FROM t WHERE k >= s.step) AS n_hadm_id,
  (SELECT count(DISTINCT stay_id) FROM t WHERE k >= s.step) AS n_stay_id
FROM s
"""


@query("attrition_flow", _ATTR_SQL)
def attrition_flow(spark, sf):
    """Rows, patients, admissions and stays left after each cumulative step."""
    o = C.repeat_flag(S.index_orders(spark, sf), ["subject_id", "hadm_id"], "t0", "order_id")
    steps = [
        ("outcome recorded", F.col("y").isNotNull()),
        ("first order of admission", F.col("is_repeat") == 0),
        ("outside excluded units", ~F.col("unit").isin("unit0", "unit1", "unit2")),
    ]
    return C.attrition_flow(o, steps, ["subject_id", "hadm_id", "stay_id"])


@query(
    "hours_and_shift",
    f"""SELECT order_id,
      round((epoch_us(t0) - epoch_us(hadm_id)) / 3600000000.0, 6) AS hours_since_admit,
      CASE WHEN hour(t0) >= 7 AND hour(t0) < 19 THEN 'day' ELSE 'night' END AS shift
    FROM {_ORDERS_SQL}""",
)
def hours_and_shift_q(spark, sf):
    """Hours from admission start to the order and day/night shift (07–19)."""
    o = S.index_orders(spark, sf)
    return hours_and_shift(o, "t0", "hadm_id", day_start=7, day_end=19).select(
        "order_id", "hours_since_admit", "shift"
    )
