"""Domain views over the generated test tables.

The clinical tables of the study are credentialed and absent, so the library's
jobs run on the generated tables through these projections. Each function only
renames/derives columns into the schema a job expects; no job work happens here.

| role                 | source                                                        |
|----------------------|---------------------------------------------------------------|
| report (note)        | ``documents``: note_id=doc_id, subject_id=source, hadm_id=lang,|
|                      | chart_order=n_chars (time proxy), exam type=lang               |
| gold / raters        | ``labels``: quality, toxic                                     |
| index event (order)  | ``events`` with event_type='error'; patient=user_id;           |
|                      | admission=day of ts; care unit='unit'||user_id%9; y=value>=50  |
| measurements         | the other ``events`` rows: item=event_type, value              |
| diagnosis code       | ``props.k`` of the event                                       |
| replies              | ``conversations`` with role='assistant'                        |
| vectors              | ``embeddings``: y = label < 3                                  |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("note_id"),
        F.col("source").alias("subject_id"),
        F.col("lang").alias("hadm_id"),
        F.col("n_chars").alias("chart_order"),
        "text",
    )


def note_details(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.col("lang").alias("field_value"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(note_id, gold_label, rater1, rater2) — quality is the adjudicated label."""
    lab = table(spark, sf, "labels")
    name = lambda c: F.when(F.col(c) == 1, F.lit("Positive")).otherwise(F.lit("Negative"))
    return lab.select(
        F.col("doc_id").alias("note_id"),
        name("quality").alias("gold_label"),
        name("quality").alias("rater1"),
        name("toxic").alias("rater2"),
    )


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a deterministic score: (key, stratum, lang, y, p)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("key"),
        F.col("source").alias("stratum"),
        "lang",
        F.col("quality").alias("y"),
        F.col("toxic").alias("y2"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p"),
    )


def index_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Index events: (order_id, subject_id, hadm_id, stay_id, t0, unit, code, y)."""
    ev = table(spark, sf, "events")
    return ev.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("order_id"),
        F.col("user_id").alias("subject_id"),
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("hadm_id"),
        F.col("user_id").alias("stay_id"),
        F.col("ts").alias("t0"),
        F.concat(F.lit("unit"), (F.col("user_id") % 9).cast("string")).alias("unit"),
        F.get_json_object("props", "$.k").cast("int").alias("code"),
        (F.col("value") >= 50).cast("int").alias("y"),
    )


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Long measurement table: (event_id, stay_id, itemid, ts, value)."""
    ev = table(spark, sf, "events")
    return ev.where(F.col("event_type") != "error").select(
        "event_id", F.col("user_id").alias("stay_id"), F.col("event_type").alias("itemid"), "ts", "value"
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("key"), "embedding", (F.col("label") < 3).cast("int").alias("y"))


#: invented words of ``documents`` and what stands for them in ``reports`` (our own choice), in order
REPORT_WORDS = (
    ("released", "FINDINGS"),
    (" that ", " IMPRESSION: "),
    (" there ", " no acute hemorrhage "),
    (" then ", " hematoma "),
    (" have ", " Infarct "),
    (" with ", " status post "),
    (" this ", " unremarkable "),
    (" from ", " edema "),
    ("tion ", " mass effect "),
)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """``notes`` whose text holds the published anchors and terms in place of common words."""
    text = F.col("text")
    for word, term in REPORT_WORDS:
        text = F.replace(text, F.lit(word), F.lit(term))
    return notes(spark, sf).withColumn("text", text)
