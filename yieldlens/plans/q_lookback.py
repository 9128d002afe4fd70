"""Look-back feature queries (C2): 4 h summary, 24 h wide, as-of last value,
baseline delta, and the plain (unbucketed) range join for parity."""

from __future__ import annotations

from ..operators import lookback as L
from ..sources import standins as S
from .q_cohort import _ORDERS_SQL
from .registry import query

_M = "(SELECT event_id, user_id AS stay_id, event_type AS itemid, ts, value FROM events WHERE event_type <> 'error')"
ITEMS = ("click", "view", "purchase", "signup")
H4, H24 = 4 * 3600, 24 * 3600


def _summary_sql(hours: int) -> str:
    return f"""SELECT o.order_id, count(m.event_id) AS n_events, min(m.value) AS min_value, max(m.value) AS max_value,
      arg_max(m.value, (m.ts, m.event_id)) AS last_value
    FROM {_ORDERS_SQL} o LEFT JOIN {_M} m
      ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '{hours} hours' AND m.ts < o.t0
    GROUP BY o.order_id"""


def _summary(spark, sf, bucketed: bool):
    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0")
    pairs = L.lookback_pairs(o, S.measurements(spark, sf), "stay_id", "t0", "ts", H4, bucketed=bucketed)
    return L.lookback_summary(o, pairs, ["order_id"], "ts", "value", "event_id")


@query("lookback_4h", _summary_sql(4))
def lookback_4h(spark, sf):
    """Per index order: count, min, max and last reading in [t0 − 4 h, t0),
    bucketed range join (join key = stay, 4 h time bucket)."""
    return _summary(spark, sf, bucketed=True)


@query("lookback_plain", _summary_sql(4))
def lookback_plain(spark, sf):
    """Same result as ``lookback_4h`` through the plain stay equi-join + filter."""
    return _summary(spark, sf, bucketed=False)


_WIDE_SQL = (
    f"""SELECT o.order_id, """
    + ", ".join(
        f"min(CASE WHEN m.itemid = '{i}' THEN m.value END) AS {i}_min, "
        f"max(CASE WHEN m.itemid = '{i}' THEN m.value END) AS {i}_max, "
        f"count(CASE WHEN m.itemid = '{i}' THEN m.value END) AS {i}_n"
        for i in ITEMS
    )
    + """, max(CAST(CASE WHEN m.itemid = 'purchase' THEN m.value END > 100.0 AS INTEGER)) AS flag_purchase_high,
      max(CAST(CASE WHEN m.itemid = 'view' THEN m.value END < 5.0 AS INTEGER)) AS flag_view_low"""
    + f"""
    FROM {_ORDERS_SQL} o LEFT JOIN {_M} m
      ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '24 hours' AND m.ts < o.t0
    GROUP BY o.order_id"""
)


@query("lookback_24h_wide", _WIDE_SQL)
def lookback_24h_wide(spark, sf):
    """Per order, per item min/max/count over 24 h plus two threshold flags
    (thresholds are parameters of the query, not clinical defaults)."""
    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0")
    pairs = L.lookback_pairs(o, S.measurements(spark, sf), "stay_id", "t0", "ts", H24, items=ITEMS)
    flags = {"flag_purchase_high": ("purchase", ">", 100.0), "flag_view_low": ("view", "<", 5.0)}
    return L.lookback_wide(o, pairs, ["order_id"], "itemid", "value", ITEMS, flags)


@query(
    "lookback_last",
    f"""SELECT o.order_id, m.itemid, arg_max(m.value, (m.ts, m.event_id)) AS last_value, max(m.ts) AS last_ts
    FROM {_ORDERS_SQL} o JOIN {_M} m
      ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '24 hours' AND m.ts < o.t0
    GROUP BY o.order_id, m.itemid""",
)
def lookback_last(spark, sf):
    """As-of: last reading of each item before the order (24 h window)."""
    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0")
    pairs = L.lookback_pairs(o, S.measurements(spark, sf), "stay_id", "t0", "ts", H24)
    return L.lookback_last(pairs, ["order_id"], "itemid", "ts", "value", "event_id")


@query(
    "lookback_baseline_delta",
    f"""SELECT o.order_id, arg_min(m.value, (m.ts, m.event_id)) AS baseline,
      arg_max(m.value, (m.ts, m.event_id)) AS last_value,
      arg_max(m.value, (m.ts, m.event_id)) - arg_min(m.value, (m.ts, m.event_id)) AS delta
    FROM {_ORDERS_SQL} o JOIN {_M} m
      ON m.stay_id = o.stay_id AND m.ts >= o.hadm_id AND m.ts < o.t0 AND m.itemid = 'view'
    GROUP BY o.order_id""",
)
def lookback_baseline_delta(spark, sf):
    """Change of one item from its first reading since admission start to its
    last reading before the order (window start = admission start)."""
    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0", "hadm_id")
    pairs = L.lookback_pairs(
        o, S.measurements(spark, sf), "stay_id", "t0", "ts", H24, bucket_seconds=H24, start_col="hadm_id", items=["view"]
    )
    return L.baseline_delta(pairs, ["order_id"], "ts", "value", "event_id")


@query(
    "prescan_only_check",
    f"""SELECT count(*) AS n_orders_with_late_features FROM (
      SELECT o.order_id FROM {_ORDERS_SQL} o JOIN {_M} m
        ON m.stay_id = o.stay_id AND m.ts >= o.t0 - INTERVAL '4 hours' AND m.ts < o.t0
      GROUP BY o.order_id HAVING max(m.ts) >= min(o.t0))""",
)
def prescan_only_check(spark, sf):
    """Leakage guard: orders whose joined features reach the order time (must be 0)."""
    from ..operators.quality import prescan_violations

    o = S.index_orders(spark, sf).select("order_id", "stay_id", "t0")
    pairs = L.lookback_pairs(o, S.measurements(spark, sf), "stay_id", "t0", "ts", H4)
    v = prescan_violations(pairs, ["order_id"], "t0", "ts")
    from pyspark.sql import functions as F

    return v.agg(F.count(F.lit(1)).alias("n_orders_with_late_features"))
