"""Look-back window edges and bucketed = plain parity."""

import datetime as dt

from yieldlens.operators.lookback import baseline_delta, lookback_last, lookback_pairs, lookback_summary

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
H = dt.timedelta(hours=1)


def _data(spark):
    orders = spark.createDataFrame(
        [(1, 10, T0), (2, 10, T0 + 10 * H), (3, 20, T0)], "order_id long, stay_id long, t0 timestamp_ntz"
    )
    ev = spark.createDataFrame(
        [
            (100, 10, "hr", T0 - 4 * H, 1.0),  # exactly t0 - w: inside
            (101, 10, "hr", T0, 2.0),  # exactly t0: outside
            (102, 10, "hr", T0 - H, 3.0),
            (103, 10, "hr", T0 - H, 4.0),  # same time as 102: tie broken by id
            (104, 30, "hr", T0 - H, 9.0),  # another stay
            (105, 10, "hr", T0 - 2 * H, None),  # null value
        ],
        "event_id long, stay_id long, itemid string, ts timestamp_ntz, value double",
    )
    return orders, ev


def test_edges_and_orders_without_events(spark):
    o, e = _data(spark)
    pairs = lookback_pairs(o, e, "stay_id", "t0", "ts", 4 * 3600)
    s = {r.order_id: r for r in lookback_summary(o, pairs, ["order_id"], "ts", "value", "event_id").collect()}
    assert s[1].n_events == 4 and s[1].min_value == 1.0 and s[1].max_value == 4.0 and s[1].last_value == 4.0
    assert s[2].n_events == 0 and s[2].min_value is None  # survives with NULLs
    assert s[3].n_events == 0


def test_bucketed_equals_plain(spark):
    o, e = _data(spark)
    a = lookback_pairs(o, e, "stay_id", "t0", "ts", 4 * 3600, bucketed=True).select("order_id", "event_id")
    b = lookback_pairs(o, e, "stay_id", "t0", "ts", 4 * 3600, bucketed=False).select("order_id", "event_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_last_and_delta(spark):
    o, e = _data(spark)
    pairs = lookback_pairs(o, e.where("value is not null"), "stay_id", "t0", "ts", 4 * 3600)
    last = lookback_last(pairs, ["order_id"], "itemid", "ts", "value", "event_id").collect()
    assert [(r.order_id, r.last_value) for r in last] == [(1, 4.0)]
    d = baseline_delta(pairs, ["order_id"], "ts", "value", "event_id").collect()[0]
    assert (d.baseline, d.last_value, d.delta) == (1.0, 4.0, 3.0)


def test_repeat_flag_nulls_and_ties(spark):
    from yieldlens.operators.cohort import repeat_flag

    rows = [
        (1, 10, 100, T0), (2, 10, 100, T0 + H), (3, 10, 100, T0),  # tie at T0 broken by id: 1 first
        (4, 10, 100, None),  # no time → never a repeat
        (5, 11, None, T0), (6, 11, None, T0 + H),  # no admission key → never a repeat
    ]
    df = spark.createDataFrame(rows, "id long, subject long, adm long, t timestamp_ntz")
    got = {r.id: r.is_repeat for r in repeat_flag(df, ["subject", "adm"], "t", "id").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
