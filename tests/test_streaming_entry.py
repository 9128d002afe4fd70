"""Streaming parity with batch and the driver contract on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables absent")
def test_entry_runs(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert rows and {"label", "n", "percent"} <= set(rows[0].asDict())
    assert abs(sum(r.percent for r in rows) - 100.0) < 0.05


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables absent")
def test_stream_lookback_equals_batch(spark):
    from pyspark.sql import functions as F

    from __spark_entry__ import queries

    s = queries()["stream_lookback"](spark, SMOKE)
    b = queries()["lookback_4h"](spark, SMOKE).where("n_events > 0").select("order_id", "n_events", "min_value", "max_value")
    s = s.select("order_id", F.col("n_events").cast("long"), "min_value", "max_value")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables absent")
def test_every_sql_query_builds(spark):
    from __spark_entry__ import oracle_sql, queries

    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    for name in ["label_wide", "scan_sequence", "auroc_by_unit", "gold_sample", "within_unit_auroc"]:
        assert q[name](spark, SMOKE).count() >= 0

