"""Seeded, oracle-checkable splits: patient-grouped holdout, repeated stratified
group k-fold, row-level stratified split (leaky, for comparison), leave-one-
stratum-out gates and the leakage check.

Every random choice is an order by ``md5(seed ':' key)``: the same hex string in
Spark and in SQL engines, stable across runs and executors (no ``rand()``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import sequence_number
from .sizing import with_scalars


def seeded_hash(seed: int | str | Column, key: str) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), F.col(key).cast("string")))


def group_split(df: DataFrame, group: str, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """(group, is_test): the first ceil(frac · G) distinct groups in seeded-hash order
    are the test side. Numbering runs on the distinct-group table (skew-safe)."""
    g = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", seeded_hash(seed, group))
    ranked = sequence_number(g, [], ["_h", group], "_r")
    cnt = g.agg(F.count(F.lit(1)).alias("_G"))
    j = with_scalars(ranked, cnt)  # one-row global count
    return j.select(group, (F.col("_r") <= F.ceil(F.col("_G") * F.lit(test_frac))).cast("int").alias("is_test"))


def grouped_kfold(
    df: DataFrame, group: str, label: str, k: int = 5, reps: int = 1, first_rep: int = 0
) -> DataFrame:
    """(rep, group, fold) for ``reps`` repetitions of stratified group k-fold.

    Groups are collapsed to (n_pos, n); inside each (rep, n_pos, n) stratum they
    are ordered by md5(rep ':' group) and dealt round-robin with an offset
    ``fold = (rank − 1 + n_pos + n) % k`` that spreads small strata over folds.
    A group never spans folds (no leakage); fold sizes and prevalence balance.
    """
    gs = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.sum(F.col(label).cast("long")).alias("_npos"), F.count(F.lit(1)).alias("_n")
    )
    gr = gs.withColumn("rep", F.explode(F.sequence(F.lit(first_rep), F.lit(first_rep + reps - 1))))
    gr = gr.withColumn("_h", seeded_hash(F.col("rep"), group))
    ranked = sequence_number(gr, ["rep", "_npos", "_n"], ["_h", group], "_r")
    fold = F.pmod(F.col("_r") - 1 + F.col("_npos") + F.col("_n"), F.lit(k)).cast("int")
    return ranked.select("rep", group, fold.alias("fold"))


def assign_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows × reps with their fold (join on the group)."""
    return df.join(folds, group)


def stratified_row_split(df: DataFrame, key: str, label: str, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Row-level split per class (ignores patients — leaky; kept for comparison):
    the first ceil(frac · n_class) rows of each class in seeded-hash order."""
    h = df.select(key, label).withColumn("_h", seeded_hash(seed, key))
    ranked = sequence_number(h, [label], ["_h", key], "_r")
    n = h.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    j = ranked.join(n, label)
    return j.select(key, label, (F.col("_r") <= F.ceil(F.col("_nc") * F.lit(test_frac))).cast("int").alias("is_test"))


def stratum_gate(df: DataFrame, stratum: str, label: str, min_n: int = 40) -> DataFrame:
    """(stratum, n, n_pos, positive_rate, eligible): a stratum is scored on its own
    only with at least ``min_n`` rows and both classes."""
    return (
        df.where(F.col(stratum).isNotNull())
        .groupBy(stratum)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(label).cast("long")).alias("n_pos"),
            F.avg(F.col(label).cast("double")).alias("positive_rate"),
        )
        .withColumn("eligible", ((F.col("n") >= min_n) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))).cast("int"))
    )


def leakage(assigned: DataFrame, group: str, fold: str = "fold", rep: str = "rep") -> DataFrame:
    """n_groups (per rep, summed) and n_leaking: groups seen in more than one fold."""
    per = assigned.groupBy(rep, group).agg(F.countDistinct(fold).alias("_nf"))
    return per.agg(F.count(F.lit(1)).alias("n_group_reps"), F.count_if(F.col("_nf") > 1).alias("n_leaking"))


def fold_balance(assigned: DataFrame, label: str, fold: str = "fold", rep: str = "rep") -> DataFrame:
    """Rows and prevalence per (rep, fold)."""
    return assigned.groupBy(rep, fold).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )
