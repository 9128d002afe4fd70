"""Look-back window features (C2): events in ``[t0 - w, t0)`` of each index order.

Plain form: equi join on the stay, then the time filter — cost grows with
orders × events per stay, and a long stay is one hot join key.

Bucketed form (default): time is cut into buckets of width ``bucket`` (≥ the
window); an event sits in one bucket, an order is copied to the few buckets its
window touches, and the join key becomes (stay, bucket). A long or hot stay is
thereby spread over many keys; the exact time filter follows the join, and the
per-order aggregation is partial (map-side) before its shuffle. Orders without
any event in the window survive with NULL features (left join at the end).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import epoch_micros


def _bucket(c: Column, width_us: int) -> Column:
    return F.floor(epoch_micros(c) / F.lit(width_us)).cast("long")


def lookback_pairs(
    orders: DataFrame,
    events: DataFrame,
    stay: str,
    t0: str,
    ts: str,
    window_seconds: int,
    bucket_seconds: int | None = None,
    start_col: str | None = None,
    bucketed: bool = True,
    items: Sequence[str] | None = None,
    item_col: str = "itemid",
    prune_by_time: bool = True,
) -> DataFrame:
    """Inner (order, event) pairs with ``t0 - w <= ts < t0`` on the same stay.

    ``start_col`` replaces the fixed window start by a per-order start time
    (e.g. admission start); then ``bucket_seconds`` must cover the longest
    window. ``items`` prefilters events (pushed to the scan). With
    ``prune_by_time`` the earliest window start and the latest order time (one
    small aggregate) bound the event scan, so parquet row groups outside the
    cohort's time span are skipped; no event outside those bounds can match.
    """
    ev = events.where(F.col(item_col).isin(list(items))) if items else events
    w = F.expr(f"INTERVAL {int(window_seconds)} SECONDS")
    lo = F.col(start_col) if start_col else F.col(t0) - w
    o = orders.withColumn("_lo", lo)
    if prune_by_time:
        # bounds travel as Spark-rendered strings and are cast back by the same
        # session, so no Python time-zone conversion can shift them
        first, last = o.agg(F.min("_lo").cast("string"), F.max(t0).cast("string")).first()
        tt = dict(ev.dtypes)[ts]
        if first is None:  # no orders: no pairs
            ev = ev.limit(0)
        else:
            ev = ev.where((F.col(ts) >= F.lit(first).cast(tt)) & (F.col(ts) < F.lit(last).cast(tt)))
    cond_time = (F.col(ts) >= F.col("_lo")) & (F.col(ts) < F.col(t0))
    ev_cols = [c for c in ev.columns if c != stay]
    if not bucketed:
        return o.join(ev, stay).where(cond_time).drop("_lo")
    width_us = int((bucket_seconds or window_seconds) * 1_000_000)
    ob = o.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_lo"), width_us), _bucket(F.col(t0), width_us))))
    eb = ev.withColumn("_b", _bucket(F.col(ts), width_us))
    return ob.join(eb, [stay, "_b"]).where(cond_time).drop("_lo", "_b").select(*orders.columns, *ev_cols)


def lookback_summary(
    orders: DataFrame,
    pairs: DataFrame,
    key: Sequence[str],
    ts: str,
    value: str,
    tiebreak: str,
) -> DataFrame:
    """Per order: n_events, min_value, max_value, last_value (latest by ts, then
    tie-break). Left join from all orders: no events → n 0, NULL values."""
    agg = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.max_by(F.col(value), F.struct(F.col(ts), F.col(tiebreak))).alias("last_value"),
    )
    return (
        orders.select(*key)
        .join(agg, list(key), "left")
        .withColumn("n_events", F.coalesce(F.col("n_events"), F.lit(0)).cast("long"))
    )


def lookback_wide(
    orders: DataFrame,
    pairs: DataFrame,
    key: Sequence[str],
    item_col: str,
    value: str,
    items: Sequence[str],
    flags: dict[str, tuple[str, str, float]] | None = None,
) -> DataFrame:
    """One row per order; for each item ``<item>_min``, ``<item>_max``, ``<item>_n``
    via conditional aggregation (fixed item list, no pivot discovery pass).
    ``flags``: name -> (item, op, threshold) gives a 0/1 any-reading flag, e.g.
    ('temp', '>', t). Thresholds are required parameters (none are published)."""
    aggs = []
    for it in items:
        v = F.when(F.col(item_col) == it, F.col(value))
        aggs += [F.min(v).alias(f"{it}_min"), F.max(v).alias(f"{it}_max"), F.count(v).alias(f"{it}_n")]
    for name, (it, op, thr) in (flags or {}).items():
        v = F.when(F.col(item_col) == it, F.col(value))
        hit = {">": v > thr, ">=": v >= thr, "<": v < thr, "<=": v <= thr}[op]
        aggs.append(F.max(hit.cast("int")).alias(name))
    agg = pairs.groupBy(*key).agg(*aggs)
    out = orders.select(*key).join(agg, list(key), "left")
    return out.fillna(0, subset=[f"{it}_n" for it in items])


def lookback_last(pairs: DataFrame, key: Sequence[str], item_col: str, ts: str, value: str, tiebreak: str) -> DataFrame:
    """As-of value: the latest reading per (order, item) before the order time."""
    return pairs.groupBy(*key, item_col).agg(
        F.max_by(F.col(value), F.struct(F.col(ts), F.col(tiebreak))).alias("last_value"),
        F.max(ts).alias("last_ts"),
    )


def baseline_delta(pairs: DataFrame, key: Sequence[str], ts: str, value: str, tiebreak: str) -> DataFrame:
    """First (baseline) and last reading per order inside its window and their
    difference ``delta = last - baseline``."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    return (
        pairs.groupBy(*key)
        .agg(F.min_by(F.col(value), order).alias("baseline"), F.max_by(F.col(value), order).alias("last_value"))
        .withColumn("delta", F.col("last_value") - F.col("baseline"))
    )
