"""Corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, BPE ids.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it
kept; ``run`` writes each result as Parquet in the shared folder and reads it again. All but
the last return the columns of ``docs``.

Edge cases: each operator's docstring states its own. Documents are judged row by row: rows that
share a doc_id, or have none, stay or go each for itself, and one row of each group of
near-duplicates stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldlens.llm import bytebpe, decontam, langid, minhash, passages
from yieldlens.llm.common import shared_path, written
from yieldlens.session import table

#: a document without letters, or whose best language is less likely than this, is rejected
MIN_CONFIDENCE = 0.5
#: near-duplicates: percent of shared five-word shingles
NEAR_PERCENT = 80
#: repeated passages: the fewest words
PASSAGE_WORDS = 51


#: name of the row key that a stage uses inside
ROW = "pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of 128 bits that is equal for equal rows only; nothing is written for it."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    halves = [F.hex(F.xxhash64(F.lit(k), *[c.isNull() for c in cols], *cols)) for k in (1, 2)]
    return docs.withColumn(ROW, F.concat(*[F.lpad(h, 16, "0") for h in halves]))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` without those of ``gone`` (row keys, written first, so that their size is known to the planner)."""
    return rows.join(written(gone.select(ROW).distinct(), "pipeline-gone"), ROW, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: declared language, source and text are fused."""
    rows = _keyed(docs)
    found = langid.identify(langid.document_evidence(rows.withColumn("doc_id", F.col(ROW))), docs.select("text", "lang"))
    rejected = F.col("language").isNull() | (F.col("n_grams") == 0) | (F.col("confidence") < MIN_CONFIDENCE)
    return _without(rows, found.where(rejected).select(F.col("key").alias(ROW))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    rows = _keyed(docs)
    marks = written(minhash.near_duplicate_rows(rows, ROW, NEAR_PERCENT), "pipeline-marks")
    left = _without(rows, marks.where("NOT stays"))
    # of equal rows that stay one is taken; only those are grouped, with one row a task after the map side
    twice = marks.where("stays AND copies > 1").select(ROW)
    one = left.join(twice, ROW, "left_semi").groupBy(ROW).agg(F.first(F.struct(*docs.columns)).alias("one")).select("one.*")
    return left.join(twice, ROW, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than fifty words that occur more than once."""
    rows, kept = passages.remove_passages(docs, PASSAGE_WORDS)
    kept = kept.select("id", F.col("kept_text").alias("text"))
    joined = rows.drop("text").join(kept, "id").withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.contamination(docs, items).where("NOT contaminated").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every document, with their digest and that of the decoded text."""
    return bytebpe.round_trip(docs, bytebpe.ranks_file(), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("token_ids", token_ids),
]

#: no SQL expresses language scores, suffix order or BPE merges; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
