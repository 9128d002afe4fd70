"""Structured Streaming versions of the order-time jobs.

* ``interval_join`` — order stream ⋈ measurement stream on the stay with the
  look-back interval, both sides watermarked (state is bounded by the window).
* ``score_stream`` — stateless: score arriving rows and apply the threshold.
* ``lookback_counts`` — per order, orders without events included, aggregated in state.
* ``score_with_model`` — a saved pipeline, preparation included, applied to a stream.
* ``rolling_rate``, ``session_rate`` — tumbling, sliding and session windows of counts /
  positive rate per stratum, late data bounded by a watermark.
* ``dedupe_label_stream`` — label arriving reports, dropping copies of a report
  key within the watermark.

Runs use ``trigger(availableNow=True)`` into a parquet sink with its own
checkpoint under the shared checkpoint folder, so a restarted job resumes from
the committed offsets; the returned DataFrame reads the sink.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RuleSet
from ..operators.labeling import label_text
from ..session import cut_lineage, ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def files_for(df: DataFrame, least: int = 4, rows: int = 10_000) -> int:
    """Files to stage ``df`` in: a file, which one task writes and reads, does not grow with the table."""
    return max(least, -(-df.count() // rows))


def stage_files(df: DataFrame, path: str, files: int = 4, time_col: str | None = None) -> str:
    """Write a derived table as a folder of parquet files for a file stream. With ``time_col``
    the rows are dealt by range of time once, and the ranges are written one after another, so
    the stream sees them in order of time, as arriving data would be."""
    if time_col is None:
        df.repartition(files).write.mode("overwrite").parquet(path)
        return path
    dealt = cut_lineage(df.repartitionByRange(files, time_col))
    for i in range(dealt.rdd.getNumPartitions()):
        dealt.where(F.spark_partition_id() == i).write.mode("append").parquet(path)
    return path


def add_rows(df: DataFrame, path: str) -> str:
    """Add late or closing rows to a staged folder as one more file."""
    df.coalesce(1).write.mode("append").parquet(path)  # a stated handful of rows
    return path


def file_stream(spark: SparkSession, path: str, like: DataFrame, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available_now(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/data")


def run_partials(stream: DataFrame, out: str, keys: list[str], partial: dict, final: dict) -> DataFrame:
    """Append-only stream whose micro-batches are folded into mergeable partial
    aggregates (``partial``: name -> agg over the batch) written per batch; the
    result merges the partials (``final``: name -> agg over partial columns).
    Exact for count / sum / min / max, and each batch's work is bounded. A batch that is
    delivered again after a restart replaces its own folder, so it counts once."""

    def write(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy(*keys).agg(*[e.alias(n) for n, e in partial.items()])
        part.write.mode("overwrite").parquet(f"{out}/partials/_batch={epoch}")

    q = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    parts = stream.sparkSession.read.parquet(f"{out}/partials")
    return parts.groupBy(*keys).agg(*[e.alias(n) for n, e in final.items()])


def run_update(stream: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """Update-mode aggregate: every micro-batch writes the groups it changed to the folder
    of its batch id (replaced when the batch is delivered again); the result keeps the
    latest version of each group."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/updates/_batch={epoch}")

    q = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    ups = stream.sparkSession.read.parquet(f"{out}/updates")
    others = [c for c in ups.columns if c not in keys and c != "_batch"]
    latest = ups.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])


def interval_join(
    orders: DataFrame, events: DataFrame, stay: str, t0: str, ts: str, window_hours: int, lateness: str, how: str = "inner"
) -> DataFrame:
    """Stream-stream join of each order with its stay's events in [t0 − w, t0); both sides
    watermarked so join state is dropped once no later match is possible. With
    ``how="leftOuter"`` an order without any event is emitted too, once the watermark has
    passed it. Wall-clock (NTZ) times are read as UTC for watermarks."""
    o = _as_event_time(orders, t0).withWatermark(t0, lateness).alias("o")
    e = _as_event_time(events, ts).withWatermark(ts, lateness).alias("e")
    cond = (
        (F.col(f"o.{stay}") == F.col(f"e.{stay}"))
        & (F.col(f"e.{ts}") >= F.col(f"o.{t0}") - F.expr(f"INTERVAL {window_hours} HOURS"))
        & (F.col(f"e.{ts}") < F.col(f"o.{t0}"))
    )
    return o.join(e, cond, how).select("o.*", *[F.col(f"e.{c}") for c in events.columns if c != stay])


def lookback_counts(
    orders: DataFrame, events: DataFrame, key: str, stay: str, t0: str, ts: str, value: str, window_hours: int, lateness: str
) -> DataFrame:
    """Per order, in state: number, least and greatest value of the events in its window, 0 events
    included; a row is emitted when the watermark has passed the order."""
    pairs = interval_join(orders, events, stay, t0, ts, window_hours, lateness, "leftOuter")
    return pairs.groupBy(key, t0).agg(F.count(ts).alias("n_events"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def _as_event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def score_stream(rows: DataFrame, score: str, threshold: float) -> DataFrame:
    """Flag rows whose score is below the operating threshold."""
    return rows.withColumn("flag_low_yield", (F.col(score) < threshold).cast("int"))


def score_with_model(rows: DataFrame, model_path: str, threshold: float | None = None) -> DataFrame:
    """Rows of a stream scored by a saved ``PipelineModel`` (preparation included), with p and, if a
    threshold is given, the low-yield flag."""
    out = PipelineModel.load(model_path).transform(rows).withColumn("p", vector_to_array("probability")[1])
    return out if threshold is None else score_stream(out, "p", threshold)


def rolling_rate(rows: DataFrame, ts: str, stratum: str, label: str, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Count and positive rate per stratum in tumbling windows, or sliding ones with ``slide``
    (rows later than the watermark are dropped)."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _rates(_as_event_time(rows, ts).withWatermark(ts, lateness), window, stratum, label)


def session_rate(rows: DataFrame, ts: str, stratum: str, label: str, gap: str, lateness: str) -> DataFrame:
    """Count and positive rate of each session: rows of a stratum with gaps under ``gap``. The state
    of a session lives until the watermark has passed its end."""
    return _rates(_as_event_time(rows, ts).withWatermark(ts, lateness), F.session_window(ts, gap), stratum, label, end=True)


def _rates(rows: DataFrame, window, stratum: str, label: str, end: bool = False) -> DataFrame:
    agg = rows.groupBy(window.alias("w"), stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    bounds = [F.col("w.start").alias("window_start"), *([F.col("w.end").alias("window_end")] if end else [])]
    return agg.select(*bounds, stratum, "n", "positive_rate")


def dedupe_label_stream(reports: DataFrame, key: str, text: str, rules: RuleSet, lateness: str) -> DataFrame:
    """Arrival-time watermark, drop copies of a key within it, then label."""
    r = reports.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", lateness)
    d = r.dropDuplicatesWithinWatermark([key])
    return label_text(d.select(key, text), rules, text, subtype_out=None)
