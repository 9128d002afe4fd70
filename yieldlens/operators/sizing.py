"""Attaching one-row aggregates."""


from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a global aggregate: totals, a
    threshold, a count) to every row of ``df``. The right side holds exactly one
    row by construction, so it is broadcast and no row pairs are formed."""
    return df.crossJoin(F.broadcast(one_row))
