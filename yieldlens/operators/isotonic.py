"""Isotonic regression over any number of rows, as a convex hull.

The pools of the fit are the edges of the greatest convex minorant of the points (cumulated
weight, cumulated weighted label) in order of score; a pool's value is its edge's slope. So:

1. rows are counted per distinct score, and skew-safe running sums give the points;
2. the lower hull of each range partition is found alone, and the hull of all those vertices
   is the hull of all points. With counts as weights the points lie on a grid of n by n, a
   convex chain on which has O(n ** (2/3)) vertices, so the last step is far smaller than the
   rows; everything before it is spread over range partitions;
3. each score takes the value of its pool by an equi-join on the pool's number.

NULL scores or labels train nothing; a row with a NULL score, or of a group without a fit,
gets NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions
from .ordering import running_sums


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the vertices of the lower convex hull of points in ascending x (ties in slope drop the middle one)."""
    out: list[int] = []
    for i in range(len(x)):
        while len(out) > 1:
            a, b = out[-2], out[-1]
            if (y[b] - y[a]) * (x[i] - x[b]) < (y[i] - y[b]) * (x[b] - x[a]):
                break
            out.pop()
        out.append(i)
    return np.array(out, np.int64)


def points(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, score, n, cw, cy): weight of each distinct score, and cumulated weight and weighted label."""
    w = F.lit(1).cast("double") if weight is None else F.col(weight).cast("double")
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & (w > 0))
    per = base.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label).cast("double")).alias("_y"))
    return running_sums(per, list(by), ["score"], {"cw": F.col("n"), "cy": F.col("_y")})


def isotonic_fit(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, pool, lo, hi, n, value): the pools in order of score, numbered from 1, from the lowest to
    the highest score in each."""
    by = list(by)
    pts = cut_lineage(points(df, score, label, by, weight).select(*by, "score", "cw", "cy"))
    group = F.hash(*by) if by else F.lit(0)
    dealt = pts.withColumn("_g", group).repartitionByRange(shuffle_partitions(df.sparkSession), *by, "cw").sortWithinPartitions(*by, "cw")
    fields = [f"`{n}` {t}" for n, t in dealt.dtypes]

    def keys(pdf: pd.DataFrame) -> np.ndarray:
        if not by:
            return np.zeros(len(pdf), np.int64)
        return pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            parts = [pdf[keys(pdf) == g] for g in pd.unique(keys(pdf))]
            hulls = [p.iloc[lower_hull(p["cw"].to_numpy(), p["cy"].to_numpy())] for p in parts]
            yield from hulls[:-1]
            held = hulls[-1] if hulls else None  # its group may go on in the next batch
        if held is not None:
            yield held

    chains = dealt.mapInPandas(local, ", ".join(fields))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cw", kind="stable")
        x, y = np.append(0.0, pdf["cw"]), np.append(0.0, pdf["cy"])
        at = lower_hull(x, y)
        at = at[at > 0]
        v = pdf.iloc[at - 1].copy()
        edge_x, edge_y = np.diff(np.append(0.0, x[at])), np.diff(np.append(0.0, y[at]))
        v["pool"], v["n"], v["value"] = np.arange(1, len(at) + 1), edge_x, edge_y / edge_x
        return v

    hull = cut_lineage(chains.groupBy(*by, "_g").applyInPandas(whole, ", ".join([*fields, "pool bigint", "n double", "value double"])))
    # a pool's lowest score is the first one after the pool before it
    numbered = _numbered(pts, hull.select(*by, F.col("score").alias("at"), "pool"), by)
    low = numbered.groupBy(*by, "pool").agg(F.min("score").alias("lo"))
    out = _join(hull.select(*by, "pool", F.col("score").alias("hi"), "n", "value"), low, [*by, "pool"])
    return out.select(*by, "pool", "lo", "hi", "n", "value")


def _join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys are equal."""
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in on})
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in on], how).drop(*[f"_b_{c}" for c in on])


def _numbered(pts: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """``pts`` with the number of the pool that holds each score: one more than the pools that end before it."""
    marked = _join(pts, ends.select(*by, F.col("at").alias("score"), F.lit(1).alias("_end")), [*by, "score"], "left")
    marked = marked.withColumn("_end", F.coalesce("_end", F.lit(0)))
    run = running_sums(marked, by, ["score"], {"_k": F.col("_end")})
    return run.withColumn("pool", (F.col("_k") - F.col("_end") + 1).cast("bigint")).drop("_k", "_end")


def isotonic_apply(df: DataFrame, pools: DataFrame, score: str, by: Sequence[str] = (), out: str = "p_cal") -> DataFrame:
    """``df`` with ``out``: the value of the pool that holds the score, on a line between the pools
    on either side, the end pools' value beyond them."""
    by = list(by)
    pools = cut_lineage(pools)
    after = pools.select(*by, (F.col("pool") - 1).alias("pool"), F.col("lo").alias("_lo2"), F.col("value").alias("_v2"))
    both = _join(pools.select(*by, "pool", "hi", "value"), after, [*by, "pool"], "left")
    # the number of pools that begin at or below each distinct score
    scores = df.where(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("_s")).distinct()
    marks = scores.select(*by, "_s", F.lit(0).alias("_begin")).unionByName(pools.select(*by, F.col("lo").alias("_s"), F.lit(1).alias("_begin")))
    run = running_sums(marks, by, ["_s", F.desc("_begin")], {"_k": F.col("_begin")}).where("_begin = 0")
    at = run.select(*by, "_s", F.greatest(F.col("_k"), F.lit(1)).cast("bigint").alias("pool"))
    found = _join(at, both, [*by, "pool"])
    share = (F.col("_s") - F.col("hi")) / (F.col("_lo2") - F.col("hi"))
    between = (F.col("_s") > F.col("hi")) & F.col("_lo2").isNotNull()
    value = F.when(between, F.col("value") + share * (F.col("_v2") - F.col("value"))).otherwise(F.col("value"))
    found = found.select(*by, "_s", value.alias(out))
    rows = df.withColumn("_s", F.col(score).cast("double"))
    return _join(rows, found, [*by, "_s"], "left").drop("_s")
