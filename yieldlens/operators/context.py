"""Time context of an order: hours since admission, shift of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_micros(c: str | Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a wall-clock (NTZ) timestamp; no time
    zone is involved, so results do not depend on the session time zone."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col.cast("timestamp_ntz"))


def hours_and_shift(
    df: DataFrame, time_col: str, start_col: str, day_start: int, day_end: int, decimals: int = 6
) -> DataFrame:
    """``hours_since_admit`` (time − start, hours, rounded) and ``shift`` ('day' when
    the hour is in [day_start, day_end), else 'night'). Shift bounds are parameters:
    the study never states them."""
    hours = (epoch_micros(time_col) - epoch_micros(start_col)) / F.lit(3_600_000_000.0)
    h = F.hour(F.col(time_col))
    shift = F.when((h >= day_start) & (h < day_end), F.lit("day")).otherwise(F.lit("night"))
    return df.withColumn("hours_since_admit", F.round(hours, decimals)).withColumn("shift", shift)
