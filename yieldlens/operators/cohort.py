"""Cohort construction: exam filter join, scan sequence, repeat flag, de-duplication,
lookup/semi/anti joins, code-list exclusion and the attrition flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import sequence_number


def exam_notes(
    notes: DataFrame,
    details: DataFrame,
    exams: Sequence[str],
    require_admission: bool = False,
    admission_col: str = "hadm_id",
    dedupe_details: bool = False,
) -> DataFrame:
    """notes ⋈ details on note_id where the detail value is in ``exams``.

    A note with two matching detail rows appears twice (as in the published SQL);
    ``dedupe_details`` keeps one row per (note, exam value) instead. The IN filter
    is pushed into the detail scan by Catalyst.
    """
    d = details.where(F.col("field_value").isin(list(exams))).withColumnRenamed("field_value", "exam")
    if dedupe_details:
        d = d.dropDuplicates(["note_id", "exam"])
    n = notes.where(F.col(admission_col).isNotNull()) if require_admission else notes
    return n.join(d, "note_id")


def scan_sequence(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "seq") -> DataFrame:
    """``row_number() over (partition by by order by order)``; ``order`` should end in
    a unique tie-break (the published query is nondeterministic on equal times).
    NULL keys form their own group, as in SQL. Skew-safe (see ordering)."""
    return sequence_number(df, by, [F.col(c).asc_nulls_last() for c in order], out)


def repeat_flag(df: DataFrame, by: Sequence[str], time_col: str, tiebreak: str, out: str = "is_repeat") -> DataFrame:
    """1 when the row is not the first (by time, then tie-break) of its group.

    Rows with a NULL time or NULL group key are never repeats (they get no rank).
    Computed as a grouped minimum joined back, so a hot group is pre-aggregated
    map-side and the join is split by AQE's skew handling, never one window task.
    """
    keyed = F.struct(F.col(time_col), F.col(tiebreak))
    valid = F.col(time_col).isNotNull()
    for b in by:
        valid = valid & F.col(b).isNotNull()
    firsts = df.where(valid).groupBy(*by).agg(F.min(keyed).alias("_first"))
    j = df.join(firsts, list(by), "left")
    flag = F.when(valid & (keyed > F.col("_first")), 1).otherwise(0)
    return j.withColumn(out, flag).drop("_first")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order`` (explicit, deterministic). A grouped
    ``min_by`` keeps it a partial aggregate (no window over a hot key)."""
    others = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in others])
    ordkey = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*key).agg(F.min_by(packed, ordkey).alias("_row"))
    return agg.select(*key, *[F.col("_row")[c].alias(c) for c in others])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Dictionary lookup (value NULL when absent) as a left join; the planner
    broadcasts the table by its measured bytes."""
    t = table.select(key, F.col(value).alias(out or value))
    return df.join(t, key, "left")


def semi(df: DataFrame, other: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(other, key, "left_semi")


def anti(df: DataFrame, other: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(other, key, "left_anti")


def exclude_by_codes(
    orders: DataFrame,
    diagnoses: DataFrame,
    codes: DataFrame,
    admission_key: Sequence[str],
    code_col: str = "code",
    prefix: bool = False,
) -> DataFrame:
    """Drop orders whose admission carries any listed code. ``codes`` has one column
    ``code_col``; with ``prefix`` a diagnosis matches when it starts with a listed
    code (string codes)."""
    c = codes.select(F.col(code_col).cast("string").alias("_code")).distinct()
    code = F.col(code_col).cast("string")
    if prefix:  # every prefix of a diagnosis meets the list in an equi-join
        cuts = F.transform(F.sequence(F.lit(0), F.length(code)), lambda n: F.substring(code, F.lit(1), n))
        listed = diagnoses.select(*admission_key, F.explode(cuts).alias("_code"))
    else:
        listed = diagnoses.select(*admission_key, code.alias("_code"))
    bad = listed.join(c, "_code", "left_semi").select(*admission_key).distinct()
    return orders.join(bad, list(admission_key), "left_anti")


def attrition_flow(
    df: DataFrame,
    steps: Sequence[tuple[str, Column]],
    distinct_keys: Sequence[str],
) -> DataFrame:
    """Rows and distinct keys left after each cumulative filter step.

    Each row gets the number of leading steps it passes; a key survives step i when
    its best row passed i steps. Counts per step are suffix sums of small grouped
    tables — no row is copied per step and no distinct-count expansion is needed.
    Output: step (0 = all rows), step_name, n_rows, n_<key> per distinct key.
    """
    passed = F.lit(0)
    alive = F.lit(True)
    for _, cond in steps:
        alive = alive & F.coalesce(cond, F.lit(False))
        passed = passed + alive.cast("int")
    # narrow (keys, steps passed) table, written once and read by every count below
    t = cut_lineage(df.select(*distinct_keys, passed.alias("_k")))
    names = ["all"] + [n for n, _ in steps]
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "step int, step_name string")

    # units reaching exactly k steps, per counted unit (rows and each key), stacked
    parts = [t.groupBy(F.col("_k").alias("_reach")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_what", F.lit("n_rows"))]
    for k in distinct_keys:
        per = t.where(F.col(k).isNotNull()).groupBy(k).agg(F.max("_k").alias("_reach"))
        parts.append(per.groupBy("_reach").agg(F.count(F.lit(1)).alias("_n")).withColumn("_what", F.lit(f"n_{k}")))
    reach = parts[0]
    for p in parts[1:]:
        reach = reach.unionByName(p)
    # survivors of step i = units whose reach >= i (tiny tables: ≤ steps+1 rows each)
    what = ["n_rows"] + [f"n_{k}" for k in distinct_keys]
    counted = (
        grid.join(F.broadcast(reach), F.col("_reach") >= F.col("step"), "left")
        .groupBy("step", "step_name")
        .pivot("_what", what)
        .agg(F.sum("_n"))
    )
    return counted.select("step", "step_name", *[F.coalesce(F.col(w), F.lit(0)).cast("long").alias(w) for w in what])
