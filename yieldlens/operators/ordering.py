"""Skew-safe ordered operators: running sums, sequence numbers, first-n per group.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task; a key holding a third of the data would then sit in a single task, and a
global window (no key) always does. These helpers compute the same exact values
with two bounded steps instead:

1. ``repartitionByRange`` on (key, order): a hot key is split over several range
   partitions because the range bounds are sampled on the full sort key.
2. Inside each (range partition, key) slice a local window gives partial running
   values; the per-slice totals (at most #keys + #partitions rows) are turned
   into offsets with a tiny window and joined back on (partition, key).

The range bounds are sampled when the exchange runs, and the totals branch and
the row branch would each run (and sample) their own exchange, so the slice ids
could disagree. The locally numbered slices are therefore written once as a
reliable checkpoint (the shared ``spark.checkpoint.dir``) and both branches read
that copy; it also cuts the lineage, so a lost executor never re-samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions


def _as_cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``sum(expr) over (partition by by order by order rows
    unbounded preceding)`` for each ``name -> expr``. ``order`` must be a total order
    inside each ``by`` group (add a unique tie-break), as for any row frame.
    Starts one job, the checkpoint of the locally numbered slices."""
    n = partitions or shuffle_partitions(df.sparkSession)
    order_cols = _as_cols(order)
    vals = {f"_v_{k}": v for k, v in sums.items()}
    group = F.struct(*[F.col(b) for b in by]) if by else F.lit(0)
    ranged = (
        df.withColumns(vals)
        .withColumn("_g", group)
        .repartitionByRange(n, *[F.col(b) for b in by], *order_cols)
        .withColumn("_pid", F.spark_partition_id())
    )
    w = Window.partitionBy("_pid", "_g").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut_lineage(ranged.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(w) for k in sums}))
    totals = local.groupBy("_pid", "_g").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    wo = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", "_g", *[F.coalesce(F.sum(f"_t_{k}").over(wo), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    out = local.join(offsets, ["_pid", "_g"])
    out = out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in sums})
    drop = ["_pid", "_g"] + [c for k in sums for c in (f"_v_{k}", f"_l_{k}", f"_o_{k}")]
    return out.drop(*drop)


def sequence_number(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str = "rn",
    partitions: int | None = None,
) -> DataFrame:
    """Exact ``row_number() over (partition by by order by order)``, skew-safe."""
    return running_sums(df, by, order, {out: F.lit(1).cast("long")}, partitions)


def first_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    n: int | str | Column,
    out: str = "rn",
    small: bool = False,
) -> DataFrame:
    """Rows whose row number inside ``by`` (by ``order``) is <= n, with the number.

    ``n`` may be a per-row column (a quota joined in). Each group is split into as many
    hash slices as there are shuffle partitions; stage one keeps the first n of every
    slice and the exact numbering then runs on at most ``slices · n`` rows per group:
    skew-safe for any n, or, where the caller states that n is ``small`` (a sampling quota, not
    a share of the data), by a plain window without a job of its own.
    """
    order_cols = _as_cols(order)
    ncol = F.lit(n) if isinstance(n, int) else (F.col(n) if isinstance(n, str) else n)
    salt = F.pmod(F.xxhash64(*order_cols), F.lit(shuffle_partitions(df.sparkSession)))
    w = Window.partitionBy(*[F.col(b) for b in by], F.col("_salt")).orderBy(*order_cols)
    pre = (
        df.withColumn("_salt", salt)
        .withColumn("_n", ncol)
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= F.col("_n"))
        .drop("_r", "_salt")
    )
    if small:
        ranked = pre.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order_cols)).cast("long"))
    else:
        ranked = sequence_number(pre, by, order, out)
    return ranked.where(F.col(out) <= F.col("_n")).drop("_n")
