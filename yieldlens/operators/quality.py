"""Data-quality checks: required columns, key uniqueness, alignment, pre-scan-only,
and the aggregate-only export gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingInputError(RuntimeError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingInputError(f"{what} lacks required columns {missing}; has {df.columns}")
    return df


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: Sequence[str]) -> None:
    dup = duplicate_keys(df, key).limit(5).collect()
    if dup:
        raise AssertionError(f"key {list(key)} is not unique, e.g. {dup}")


def alignment(a: DataFrame, b: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full outer join on ``key``: rows only left, only right, and value mismatches
    per compared column (NULL-safe). All zero = aligned."""
    la = a.select(*key, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(1).alias("_ina"))
    lb = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_inb"))
    j = la.join(lb, list(key), "full")
    aggs = [
        F.count_if(F.col("_inb").isNull()).alias("only_left"),
        F.count_if(F.col("_ina").isNull()).alias("only_right"),
    ]
    both = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    aggs += [F.count_if(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"mismatch_{c}") for c in cols]
    return j.agg(*aggs)


def prescan_violations(pairs: DataFrame, order_key: Sequence[str], t0: str, ts: str) -> DataFrame:
    """Orders whose joined features include a time at or after the order time."""
    return pairs.groupBy(*order_key).agg(F.max(ts).alias("max_ts"), F.first(t0).alias("t0")).where(
        F.col("max_ts") >= F.col("t0")
    )


def assert_aggregate_only(df: DataFrame, forbidden: Sequence[str], min_cell: int | None = None, count_col: str = "n") -> DataFrame:
    """Export gate: refuse frames carrying identifier or text columns, and (when
    ``min_cell``) any row whose count is below the minimum cell size."""
    bad = [c for c in df.columns if c in set(forbidden)]
    if bad:
        raise AssertionError(f"export blocked: identifier/text columns {bad}")
    if min_cell is not None:
        small = df.where(F.col(count_col) < min_cell).limit(1).count()
        if small:
            raise AssertionError(f"export blocked: a cell has {count_col} < {min_cell}")
    return df
