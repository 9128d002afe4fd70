"""Basic filters and schema roles, the CSV round trip of report text, and the
seeded shuffle with sequential ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit as A
from ..operators.prep import measured_roles
from ..session import ensure_checkpoint_dir, table
from ..sources import io as IO
from ..sources import standins as S
from .q_cohort import _ORDERS_SQL
from .registry import query


@query(
    "filters_basic",
    """SELECT doc_id AS note_id, source AS subject_id, lang AS exam, n_chars AS length,
      CAST(n_chars > 1000 AS INTEGER) AS is_long FROM documents
    WHERE lang IN ('en', 'de', 'es') AND source IS NOT NULL AND coalesce(lang NOT IN ('es'), true)""",
)
def filters_basic(spark, sf):
    """Projection with aliases, IN list, NOT NULL, a NULL-keeping negated IN
    (pandas ``~isin`` keeps missing values) and a derived column."""
    d = table(spark, sf, "documents")
    keep = d.where(F.col("lang").isin("en", "de", "es") & F.col("source").isNotNull())
    keep = keep.where(~F.coalesce(F.col("lang").isin("es"), F.lit(False)))
    return keep.select(
        F.col("doc_id").alias("note_id"), F.col("source").alias("subject_id"), F.col("lang").alias("exam"),
        F.col("n_chars").alias("length"), (F.col("n_chars") > 1000).cast("int").alias("is_long"),
    )


_ROLE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    "columns_by_type",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n_values, CASE WHEN count({c}) = 0 THEN 'empty'
          WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) = 0 THEN 'numeric' ELSE 'categorical' END AS role
        FROM documents""" for c in _ROLE_COLUMNS
    ),
)
def columns_by_type(spark, sf):
    """Feature roles decided from the values of every row (numbers or not), in one pass."""
    return measured_roles(table(spark, sf, "documents").select(*_ROLE_COLUMNS))


@query("parsed_times", "SELECT event_id, date_trunc('second', ts) AS t, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def parsed_times(spark, sf):
    """Time strings parsed to wall-clock timestamps, and their hour."""
    ev = table(spark, sf, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("t"))
    return IO.parse_time(ev, "t", "dd/MM/yyyy HH:mm:ss").withColumn("hour", F.hour("t"))


@query("csv_roundtrip", "SELECT doc_id AS note_id, source AS subject_id, text FROM documents")
def csv_roundtrip(spark, sf):
    """Reports written as quoted CSV (line breaks and quotes inside fields) to the
    shared folder and read back with an explicit schema: text survives unchanged."""
    n = S.notes(spark, sf).select("note_id", "subject_id", "text")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-roundtrip-{uuid.uuid4().hex[:8]}"
    IO.write_reports_csv(n, path)
    schema = T.StructType([T.StructField("note_id", T.LongType()), T.StructField("subject_id", T.StringType()),
                           T.StructField("text", T.StringType())])
    return IO.read_reports_csv(spark, path, schema)


@query(
    "shuffled_ids",
    f"""SELECT order_id, row_number() OVER (ORDER BY md5('42:' || CAST(order_id AS VARCHAR)), order_id) AS seq,
      printf('O%05d', row_number() OVER (ORDER BY md5('42:' || CAST(order_id AS VARCHAR)), order_id)) AS review_id
    FROM {_ORDERS_SQL}""",
)
def shuffled_ids(spark, sf):
    """Seeded shuffle of every index order and sequential ids (a global numbering,
    computed without one task holding all rows when the table is large)."""
    o = S.index_orders(spark, sf).select("order_id")
    r = A.review_ids(o, "order_id", 42, "O%05d")
    return r.select("order_id", F.col("_seq").alias("seq"), "review_id")
