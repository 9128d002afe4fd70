"""Streaming queries, each checked against the SQL of its batch equivalent."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.text import STANDIN_WIDE
from ..operators import metrics as M
from ..operators import prep as PR
from ..session import cut_lineage
from ..sources import standins as S
from ..streaming import labelling as DL
from ..streaming import live as LV
from .q_audit import _STUB_SQL, stub_reply
from .q_cohort import _ORDERS_SQL
from .q_lookback import _M
from .q_metrics import D, SD, rnd
from .q_model_frame import FEATURES, frame
from .registry import query
from .sqltext import sql_label


#: micro-batches that a staged table is cut into at most, about
BATCHES = 16


def _closing(df, ts: str, days: int):
    """A row ``days`` after the last one of ``df`` that moves the watermark past the rest: of a stay
    that no other row has (a NULL would be dropped before the watermark sees it), all else NULL."""
    last = df.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr(f"INTERVAL {days} DAYS")).alias(ts))
    fixed = {ts: F.col(ts), "stay_id": F.lit(-1)}
    return last.select(*[fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])


def _staged(df, path: str, ts: str, files: int = 4) -> str:
    """Staged by time, and closed by files with a late row each, as many as the other side may lag behind."""
    LV.stage_files(df, path, files, ts)
    for days in (30, 60, 90, 120):
        LV.add_rows(_closing(df, ts, days), path)
    return path


@query(
    "stream_lookback",
    f"""SELECT o.order_id, o.t0, count(*) AS n_events, min(m.value) AS min_value, max(m.value) AS max_value
    FROM {_ORDERS_SQL} o JOIN {_M} m ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '4 hours' AND m.ts < o.t0
    GROUP BY o.order_id, o.t0""",
)
def stream_lookback(spark, sf):
    """Order stream ⋈ measurement stream (4 h interval, watermarks), per-order aggregate."""
    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0")
    m = S.measurements(spark, sf).select("stay_id", "ts", "value")
    base = LV.scratch(spark, "lookback")
    po, pm = LV.stage_files(o, f"{base}/orders", 4, "t0"), LV.stage_files(m, f"{base}/events", 4, "ts")
    so, sm = LV.file_stream(spark, po, o, 1), LV.file_stream(spark, pm, m, 1)
    pairs = LV.interval_join(so, sm, "stay_id", "t0", "ts", 4, "6 hours")
    partial = {"_n": F.count(F.lit(1)), "_min": F.min("value"), "_max": F.max("value")}
    final = {"n_events": F.sum("_n"), "min_value": F.min("_min"), "max_value": F.max("_max")}
    out = LV.run_partials(pairs, f"{base}/out", ["order_id", "t0"], partial, final)
    return out.withColumn("t0", F.col("t0").cast("timestamp_ntz"))


@query(
    "stream_lookback_all",
    f"""SELECT o.order_id, o.t0, count(m.ts) AS n_events, min(m.value) AS min_value, max(m.value) AS max_value
    FROM {_ORDERS_SQL} o LEFT JOIN {_M} m ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '4 hours' AND m.ts < o.t0
    GROUP BY o.order_id, o.t0""",
)
def stream_lookback_all(spark, sf):
    """The same with a left outer stream-stream join and the aggregate in state: orders without a
    measurement appear with n_events = 0 once the watermark has passed them."""
    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0")
    m = S.measurements(spark, sf).select("stay_id", "ts", "value")
    base = LV.scratch(spark, "lookback-all")
    so = LV.file_stream(spark, _staged(o, f"{base}/orders", "t0"), o, 1)
    sm = LV.file_stream(spark, _staged(m, f"{base}/events", "ts"), m, 1)
    out = LV.run_available_now(LV.lookback_counts(so, sm, "order_id", "stay_id", "t0", "ts", "value", 4, "6 hours"), f"{base}/out")
    return out.where("order_id IS NOT NULL").withColumn("t0", F.col("t0").cast("timestamp_ntz"))


@query(
    "stream_score",
    f"""WITH sd AS {SD}, thr AS (SELECT max(c.t) AS t FROM (SELECT DISTINCT round_even(p, 3) AS t FROM sd) c
      WHERE (SELECT count(*) FROM sd WHERE p >= c.t AND y = 1) >= 0.95 * (SELECT sum(y) FROM sd))
    SELECT key, round(p, {D}) AS p, CAST(p < thr.t AS INTEGER) AS flag_low_yield FROM sd, thr""",
)
def stream_score(spark, sf):
    """Arriving scored rows flagged against the batch operating threshold."""
    d = S.scored_docs(spark, sf).select("key", "y", "p")
    thr = M.operating_point(d, "y", "p", 0.95).first()["threshold"]  # one number
    base = LV.scratch(spark, "score")
    src = LV.file_stream(spark, LV.stage_files(d, f"{base}/in"), d, 2)
    out = LV.run_available_now(LV.score_stream(src, "p", thr).select("key", "p", "flag_low_yield"), f"{base}/out")
    return rnd(out)


@query(
    "stream_rolling_rate",
    f"""SELECT date_trunc('day', t0) AS window_start, unit, count(*) AS n, round(avg(CAST(y AS DOUBLE)), {D}) AS positive_rate
    FROM {_ORDERS_SQL} GROUP BY 1, 2""",
)
def stream_rolling_rate(spark, sf):
    """Daily tumbling windows of order count and positive rate per unit."""
    o = S.index_orders(spark, sf).select("t0", "unit", "y")
    base = LV.scratch(spark, "rolling")
    src = LV.file_stream(spark, LV.stage_files(o, f"{base}/in", 4, "t0"), o, 1)
    out = LV.run_update(LV.rolling_rate(src, "t0", "unit", "y", "1 day", "2 hours"), f"{base}/out", ["window_start", "unit"])
    return rnd(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query(
    "stream_dedupe",
    f"SELECT DISTINCT md5(text) AS text_key, {sql_label('text', STANDIN_WIDE)} AS label FROM documents",
)
def stream_dedupe(spark, sf):
    """Arriving reports: copies (same text key) dropped within the watermark, the
    rest labelled as they arrive."""
    n = S.notes(spark, sf).select(F.md5("text").alias("text_key"), "text")
    base = LV.scratch(spark, "dedupe")
    files = LV.files_for(n)
    src = LV.file_stream(spark, LV.stage_files(n, f"{base}/in", files), n, max(2, files // BATCHES))
    return LV.run_available_now(LV.dedupe_label_stream(src, "text_key", "text", STANDIN_WIDE, "1 hour"), f"{base}/out")


@query(
    "stream_sliding_rate",
    f"""SELECT w AS window_start, unit, count(*) AS n, round(avg(CAST(y AS DOUBLE)), {D}) AS positive_rate FROM (
      SELECT o.*, unnest([time_bucket(INTERVAL '6 hours', t0) - k * INTERVAL '6 hours' for k in range(0, 4)]) AS w FROM {_ORDERS_SQL} o)
    GROUP BY 1, 2""",
)
def stream_sliding_rate(spark, sf):
    """Windows of a day that start every 6 hours: order count and positive rate per unit."""
    o = S.index_orders(spark, sf).select("t0", "unit", "y")
    base = LV.scratch(spark, "sliding")
    src = LV.file_stream(spark, _staged(o, f"{base}/in", "t0"), o, 1)
    rate = LV.rolling_rate(src, "t0", "unit", "y", "1 day", "2 hours", "6 hours")
    out = LV.run_available_now(rate, f"{base}/out").where("unit IS NOT NULL")
    return rnd(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query(
    "stream_sessions",
    f"""SELECT unit, min(t0) AS window_start, max(t0) + INTERVAL '3 hours' AS window_end, count(*) AS n,
      round(avg(CAST(y AS DOUBLE)), {D}) AS positive_rate FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR t0 >= prev + INTERVAL '3 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY t0, order_id) AS island FROM (
        SELECT *, lag(t0) OVER (PARTITION BY unit ORDER BY t0, order_id) AS prev FROM {_ORDERS_SQL} WHERE unit IS NOT NULL))
    GROUP BY unit, island""",
)
def stream_sessions(spark, sf):
    """Sessions of orders in a unit with gaps under 3 hours: bounds, count and positive rate."""
    o = S.index_orders(spark, sf).select("t0", "unit", "y")
    base = LV.scratch(spark, "sessions")
    src = LV.file_stream(spark, _staged(o, f"{base}/in", "t0"), o, 1)
    out = LV.run_available_now(LV.session_rate(src, "t0", "unit", "y", "3 hours", "2 hours"), f"{base}/out").where("unit IS NOT NULL")
    return rnd(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}))


def scoring_pipeline() -> Pipeline:
    """Median imputation, scaling and a balanced logistic model, as one pipeline to store."""
    cols = [*FEATURES, "hour"]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=cols, outputCols=[f"{c}_i" for c in cols], relativeError=1e-6),
        VectorAssembler(inputCols=[f"{c}_i" for c in cols], outputCol="x"),
        StandardScaler(withMean=True, withStd=True, inputCol="x", outputCol="features"),
        LogisticRegression(labelCol="label_d", weightCol="weight", regParam=0.01),
    ])


@query("stream_model_score")
def stream_model_score(spark, sf):
    """A fitted pipeline, stored and loaded again, scores arriving orders: p and the flag below the
    batch operating point (the batch scores are those of the test)."""
    f = frame(spark, sf).withColumn("hour", F.col("hour").cast("double")).withColumns({c: F.col(c).cast("double") for c in FEATURES})
    f = cut_lineage(f)
    train = PR.balanced_weights(f.withColumn("label_d", F.col("y").cast("double")), f.withColumn("label_d", F.col("y").cast("double")), "label_d")
    base = LV.scratch(spark, "model")
    model = scoring_pipeline().fit(train)
    model.write().overwrite().save(f"{base}/model")
    batch = model.transform(f).withColumn("p", vector_to_array("probability")[1])
    thr = M.operating_point(batch.select("order_id", "y", "p"), "y", "p", 0.95).first()["threshold"]  # one number
    rows = f.select("order_id", "hour", *FEATURES)
    src = LV.file_stream(spark, LV.stage_files(rows, f"{base}/in"), rows, 2)
    out = LV.run_available_now(LV.score_with_model(src, f"{base}/model", thr).select("order_id", "p", "flag_low_yield"), f"{base}/out")
    return rnd(out, 6)


@query("durable_labelling", f"SELECT doc_id AS note_id, {_STUB_SQL} AS ext_label, 1 AS n_sent FROM documents")
def durable_labelling(spark, sf):
    """Labelling as a stream of request files that is stopped after three commits and started again:
    one label per report, each report sent once by a committed batch."""
    n = S.notes(spark, sf).select("note_id", "text")
    base = LV.scratch(spark, "labelling")
    requests = DL.stage_requests(n, f"{base}/requests", DL.commit_rows(n, 50))

    def stop(number: int) -> None:
        if number == 3:
            raise RuntimeError("stopped before the fourth commit")

    args = (spark, requests, "note_id bigint, text string", "note_id", "text", stub_reply, f"{base}/out")
    try:
        DL.label_requests(*args, files_per_commit=2, on_batch=stop)
    except StreamingQueryException:
        pass  # the first run ends there; tables of fewer commits end by themselves
    out = DL.label_requests(*args, files_per_commit=2)
    return out.groupBy("note_id").agg(F.max("ext_label").alias("ext_label"), F.count("*").cast("int").alias("n_sent"))
