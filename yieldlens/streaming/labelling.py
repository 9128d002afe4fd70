"""Durable labelling: the request table as a file stream, a micro-batch as the commit.

``stage_requests`` writes the reports to label as files of at most ``commit_rows`` rows. Each
run of ``label_requests`` (trigger ``availableNow``) takes the files that no earlier run
committed, some at a time, sends every row of a micro-batch to the labeller and stores the
replies in the folder of the batch; then Spark commits the batch. A run that is stopped loses
at most the batch it was in: that batch is delivered again and its folder replaced, while
committed reports are never sent again. New request files are picked up by the next run.

The labeller is called once a row: a failure is that row's own (``error``, label 'ERR') and
re-sends nothing. Calls in flight are bounded by ``tasks`` (partitions of a batch) times
``threads`` (calls in flight of a task).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_reply


def commit_rows(requests: DataFrame, least: int, files: int = 256) -> int:
    """Rows of a request file: ``least``, or as many as leave about ``files`` files, as each commit
    costs a batch's start however few its rows are."""
    return max(least, -(-requests.count() // files))


def stage_requests(requests: DataFrame, path: str, commit_rows: int = 200) -> str:
    """Write (or add) request files of at most ``commit_rows`` rows, sized by Spark before."""
    requests.hint("rebalance").write.option("maxRecordsPerFile", commit_rows).mode("append").parquet(path)
    return path


def send_rows(batch: DataFrame, key: str, text: str, send: Callable[[str], str], tasks: int, threads: int) -> DataFrame:
    """(key, reply, error) of every row, ``threads`` calls of ``send`` at a time in each of ``tasks`` tasks."""

    def one(t: str) -> tuple:
        try:
            return send(t), None
        except Exception as e:  # noqa: BLE001 - any failure belongs to its row
            return None, f"{type(e).__name__}:{e}"

    def run(it):
        with ThreadPoolExecutor(threads) as pool:
            for pdf in it:
                out = list(pool.map(one, pdf[text].fillna("")))
                yield pd.DataFrame({key: pdf[key], "reply": [r for r, _ in out], "error": [e for _, e in out]})

    schema = f"`{key}` {dict(batch.dtypes)[key]}, reply string, error string"
    return batch.select(key, text).repartition(tasks).mapInPandas(run, schema)


def label_requests(
    spark: SparkSession,
    requests: str,
    schema: str,
    key: str,
    text: str,
    send: Callable[[str], str],
    out: str,
    files_per_commit: int = 8,
    tasks: int = 8,
    threads: int = 1,
    on_batch: Callable[[int], None] | None = None,
) -> DataFrame:
    """Label all request files that are not committed yet; return the stored replies
    (key, reply, ext_label, error, _batch). ``on_batch`` is called with each batch's number
    before it is sent (a place for progress reports; an exception in it stops the run)."""

    def commit(batch: DataFrame, number: int) -> None:
        if on_batch is not None:
            on_batch(number)
        sent = send_rows(batch, key, text, send, tasks, threads)
        label = F.when(F.col("error").isNotNull(), F.lit("ERR")).otherwise(parse_reply(F.col("reply")))
        sent.withColumn("ext_label", label).write.mode("overwrite").parquet(f"{out}/replies/_batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_commit).parquet(requests)
    q = stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{out}/commits").trigger(availableNow=True).start()
    q.awaitTermination()
    return stored_replies(spark, out, key, schema)


def stored_replies(spark: SparkSession, out: str, key: str, schema: str) -> DataFrame:
    """All stored replies of committed and running batches."""
    kind = dict(spark.createDataFrame([], schema).dtypes)[key]
    return spark.read.schema(f"`{key}` {kind}, reply string, error string, ext_label string, _batch int").parquet(f"{out}/replies")
