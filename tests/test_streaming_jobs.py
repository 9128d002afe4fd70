"""Durable labelling, outer look-back, windows with late rows and a stored model in a stream."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from yieldlens.operators import audit as A
from yieldlens.streaming import labelling as DL
from yieldlens.streaming import live as LV

T0 = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def test_labelling_goes_on_after_a_stop(spark, tmp_path):
    log = str(tmp_path / "sent")
    (tmp_path / "sent").mkdir()

    def send(text: str) -> str:
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(text)
        if "bad" in text:
            raise ValueError("no reply")
        return "Positive" if "there" in text else "negative"

    rows = [(i, f"{i} there" if i % 3 else f"{i} bad" if i == 30 else f"{i} none") for i in range(60)] + [(60, None)]
    req = DL.stage_requests(spark.createDataFrame(rows, "id long, text string").coalesce(1), str(tmp_path / "requests"), 7)

    def stop(number):
        if number == 4:
            raise RuntimeError("stopped")

    args = (spark, req, "id long, text string", "id", "text", send, str(tmp_path / "out"))
    with pytest.raises(StreamingQueryException):
        DL.label_requests(*args, files_per_commit=1, tasks=2, threads=2, on_batch=stop)
    first = {f.read_text() for f in (tmp_path / "sent").iterdir()}
    assert 0 < len(first) < 61
    out = DL.label_requests(*args, files_per_commit=1, tasks=2, threads=2).collect()
    sent = sorted(f.read_text() for f in (tmp_path / "sent").iterdir())
    assert len(sent) == len(set(sent)) == 61  # no report, committed or not, went out twice
    got = {r["id"]: (r["ext_label"], r["error"]) for r in out}
    assert len(out) == 61 and got[30] == ("ERR", "ValueError:no reply")
    assert all(got[i][0] == ("Positive" if i % 3 else "Negative") for i in range(60) if i != 30)
    # new requests are taken by the next run, old ones not again
    DL.stage_requests(spark.createDataFrame([(100, "there")], "id long, text string"), req, 7)
    assert len(DL.label_requests(*args).collect()) == 62
    assert len(list((tmp_path / "sent").iterdir())) == 62


def test_stored_batches_and_unblinding(spark, tmp_path):
    state = str(tmp_path / "state")
    A.store_batch(spark.createDataFrame([(1,), (2,)], "note_id int"), state, "B1", "note_id")
    A.store_batch(spark.createDataFrame([(2,), (3,)], "note_id int"), state, "B2", "note_id")
    A.store_batch(spark.createDataFrame([(1,), (2,)], "note_id int"), state, "B1", "note_id")
    assert sorted(r[0] for r in A.stored_ids(spark, state, "note_id").collect()) == [1, 2, 3]
    sheet = spark.createDataFrame([("R1", "x"), ("R2", "y")], "review_id string, true_label string")
    key = spark.createDataFrame([("R1", 7), ("R2", 8)], "review_id string, note_id int")
    assert {r["review_id"]: r["note_id"] for r in A.unblind(sheet, key).collect()} == {"R1": 7, "R2": 8}
    for other in (key.where("note_id = 7"), key.unionByName(key.limit(1)), key.unionByName(spark.createDataFrame([("R9", 9)], key.schema))):
        with pytest.raises(ValueError, match="one to one"):
            A.unblind(sheet, other)


def test_outer_lookback_keeps_empty_orders_and_drops_late_events(spark, tmp_path):
    orders = [(1, 10, at(5)), (2, 10, at(30)), (3, 20, at(6)), (4, 30, at(50))]
    events = [(10, at(2), 1.0), (10, at(4.5), 3.0), (10, at(5), 9.0), (20, at(1), 5.0), (30, at(49), 2.0)]
    o = spark.createDataFrame(orders, "order_id long, stay long, t0 timestamp")
    e = spark.createDataFrame(events, "stay long, ts timestamp, value double")
    po, pe = LV.stage_files(o, str(tmp_path / "o"), 2, "t0"), LV.stage_files(e, str(tmp_path / "e"), 2, "ts")
    for days in (30, 60, 90, 120):  # the watermark passes everything else
        LV.add_rows(spark.createDataFrame([(None, -1, at(24 * days))], o.schema), po)
        LV.add_rows(spark.createDataFrame([(-1, at(24 * days), None)], e.schema), pe)
    # an event of the first order's window that comes after the watermark has passed it
    LV.add_rows(spark.createDataFrame([(10, at(4), 100.0)], e.schema), pe)
    stream = LV.lookback_counts(LV.file_stream(spark, po, o), LV.file_stream(spark, pe, e), "order_id", "stay", "t0", "ts", "value", 4, "1 hour")
    out = LV.run_available_now(stream, str(tmp_path / "out")).where("order_id IS NOT NULL")
    got = {r["order_id"]: (r["n_events"], r["min_value"], r["max_value"]) for r in out.collect()}
    assert got == {1: (2, 1.0, 3.0), 2: (0, None, None), 3: (0, None, None), 4: (1, 2.0, 2.0)}


def test_sessions_and_sliding_windows_with_late_rows(spark, tmp_path):
    rows = [("u", at(h), y) for h, y in ((0, 1), (1, 0), (2.5, 1), (6, 1), (6.5, 0))] + [("v", at(3), 0)]
    df = spark.createDataFrame(rows, "unit string, t timestamp, y int")
    path = LV.stage_files(df, str(tmp_path / "in"), 3, "t")
    for days in (30, 60, 90, 120):
        LV.add_rows(spark.createDataFrame([(None, at(24 * days), None)], df.schema), path)
    LV.add_rows(spark.createDataFrame([("u", at(3), 1)], df.schema), path)  # too late to count
    read = lambda: LV.file_stream(spark, path, df)
    s = LV.run_available_now(LV.session_rate(read(), "t", "unit", "y", "2 hours", "1 hour"), str(tmp_path / "s")).where("unit IS NOT NULL")
    got = sorted((r["unit"], r["window_start"], r["window_end"], r["n"], round(r["positive_rate"], 6)) for r in s.collect())
    assert got == [("u", at(0), at(4.5), 3, 0.666667), ("u", at(6), at(8.5), 2, 0.5), ("v", at(3), at(5), 1, 0.0)]
    w = LV.run_available_now(LV.rolling_rate(read(), "t", "unit", "y", "4 hours", "1 hour", "2 hours"), str(tmp_path / "w")).where("unit = 'u'")
    got = {r["window_start"]: r["n"] for r in w.collect()}
    assert got == {at(-2): 2, at(0): 3, at(2): 1, at(4): 2, at(6): 2}


def test_stored_model_in_a_stream_equals_batch(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array

    from yieldlens.plans.q_model_frame import FEATURES
    from yieldlens.plans.q_stream import scoring_pipeline

    rows = [(i, *[None if (i + k) % 7 == 0 else float((i * (k + 3)) % 11) for k in range(len(FEATURES))], float(i % 24), float(i % 3 == 0), 1.0) for i in range(120)]
    cols = ", ".join(f"{c} double" for c in FEATURES)
    df = spark.createDataFrame(rows, f"order_id long, {cols}, hour double, label_d double, weight double")
    model = scoring_pipeline().fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    src = LV.file_stream(spark, LV.stage_files(df, str(tmp_path / "in"), 3), df, 1)
    out = LV.run_available_now(LV.score_with_model(src, str(tmp_path / "model"), 0.5).select("order_id", "p", "flag_low_yield"), str(tmp_path / "out"))
    want = {r["order_id"]: r["p"] for r in model.transform(df).withColumn("p", vector_to_array("probability")[1]).collect()}
    got = {r["order_id"]: (r["p"], r["flag_low_yield"]) for r in out.collect()}
    assert len(got) == 120
    assert all(got[k][0] == pytest.approx(want[k], abs=1e-12) and got[k][1] == int(want[k] < 0.5) for k in want)


def test_files_follow_the_rows(spark, tmp_path):
    """Request files grow with the table (of 50 rows before, so commits grew with it); staged files
    grow in number (four before)."""
    assert DL.commit_rows(spark.range(1000), 50) == 50
    assert DL.commit_rows(spark.range(1_000_000), 50) == 3907
    assert (LV.files_for(spark.range(10)), LV.files_for(spark.range(105_000))) == (4, 11)
    path = LV.stage_files(spark.range(105_000), str(tmp_path / "in"), LV.files_for(spark.range(105_000)))
    per = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(per) == 11 and max(r["count"] for r in per) <= 10_000
