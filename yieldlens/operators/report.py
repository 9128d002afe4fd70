"""Descriptive cohort reporting and result gates: class counts, distinct counts,
grouped describe / demographics, median by group, percentile summaries over
repeats, seed robustness, published-number diff, rule benchmarks, flag
comparison (dirty vs clean labels), confident-learning joint, noise weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import confusion, exact_quantiles, join_groups, operating_point, rates
from .ordering import running_sums


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """value_counts: (value, n) by n desc, NULLs excluded."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def distinct_counts(df: DataFrame, keys: Sequence[str], approx: bool = False) -> DataFrame:
    """n_rows and exact distinct counts per key column. Each distinct count is its
    own two-phase aggregate (group by the key, then count), so no row expansion.
    ``approx`` uses one pass of HyperLogLog sketches instead."""
    if approx:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.approx_count_distinct(k).alias(f"n_{k}") for k in keys])
    out = df.agg(F.count(F.lit(1)).alias("n_rows"))
    for k in keys:
        d = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.lit(1).alias("_x")).agg(F.count(F.lit(1)).alias(f"n_{k}"))
        out = join_groups(out, d, [])
    return out


def describe_by(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """count (non-NULL), mean, std (sample), min, q25, q50, q75, max per group."""
    g = list(by)
    base = df.groupBy(*g).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"),
    )
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], g, names=["q25", "q50", "q75"])
    return join_groups(base, q, g, "left")


def median_by(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, col, [0.5], list(by), names=["median"])


def demographics_by(df: DataFrame, col: str, share: Column, by: Sequence[str], decimals: int = 1) -> DataFrame:
    """n, median, IQR bounds of ``col`` and percent of rows where ``share`` holds;
    rounded half-even (numpy style)."""
    g = list(by)
    base = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), (F.avg(share.cast("double")) * 100).alias("pct"))
    q = exact_quantiles(df, col, [0.5, 0.25, 0.75], g, names=["median", "iqr_low", "iqr_high"])
    j = join_groups(base, q, g, "left")
    return j.select(*g, "n", *[F.bround(c, decimals).alias(c) for c in ["median", "iqr_low", "iqr_high", "pct"]])


def seed_robustness(per_rep: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """mean, population std, min, max of a metric over repeats."""
    return per_rep.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def published_diff(computed: DataFrame, published: DataFrame, keys: Sequence[str], match: float = 0.005, close: float = 0.02) -> DataFrame:
    """Join computed and published values on ``keys``; delta and verdict per cell, and the overall
    verdict from the largest |delta| (MATCH < match ≤ CLOSE < close ≤ MISMATCH)."""
    j = computed.join(published, list(keys)).withColumn("delta", F.col("computed") - F.col("published"))
    worst = j.agg(F.max(F.abs("delta")).alias("max_abs_delta"))

    def verdict(size: Column) -> Column:
        return F.when(size < match, "MATCH").when(size < close, "CLOSE").otherwise("MISMATCH")

    j = j.withColumn("cell_verdict", verdict(F.abs("delta")))
    return join_groups(j, worst.withColumn("verdict", verdict(F.col("max_abs_delta"))), [])


def rank_sum_auroc(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """AUROC of each group by the rank sum of its positives (mid-ranks for ties), one grouped job: a
    way of its own beside the curve of ``ranking_metrics``."""
    g = list(by)
    base = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    per = base.groupBy(*g, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"))
    run = running_sums(per, g, [score], {"_upto": F.col("_n")})
    mid = F.col("_upto") - (F.col("_n") - 1) / 2
    s = run.groupBy(*g).agg(F.sum(F.col("_pos") * mid).alias("_rank"), F.sum("_pos").alias("_n1"), F.sum("_n").alias("_all"))
    n1, n0 = F.col("_n1"), F.col("_all") - F.col("_n1")
    return s.select(*g, F.try_divide(F.col("_rank") - n1 * (n1 + 1) / 2, (n1 * n0).cast("double")).alias("auroc"))


def rule_benchmark(df: DataFrame, rules: dict[str, Column], label: str) -> DataFrame:
    """Each 0/1 rule as a classifier of ``label``: counts, sens, spec, PPV, NPV, all rules in one pass.
    A NULL predicate is an explicit 'not flagged' (three-valued logic made two)."""
    return rates(confusion(_stacked_rules(df, rules), F.col(label) == 1, F.col("_pred"), ["rule"]))


def _stacked_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    each = [F.struct(F.lit(n).alias("rule"), F.coalesce(p, F.lit(False)).alias("_pred")) for n, p in rules.items()]
    return df.select("*", F.explode(F.array(*each)).alias("_rule")).select("*", "_rule.rule", "_rule._pred").drop("_rule")


def rule_net_benefit(df: DataFrame, rules: dict[str, Column], label: str, grid: Sequence[float]) -> DataFrame:
    """(rule, threshold, net_benefit, net_benefit_all): a rule flags the same rows at every threshold."""
    conf = confusion(_stacked_rules(df.where(F.col(label).isNotNull()), rules), F.col(label) == 1, F.col("_pred"), ["rule"])
    at = conf.select("*", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    odds, prev = F.col("threshold") / (1 - F.col("threshold")), (F.col("tp") + F.col("fn")) / n
    return at.select("rule", "threshold", (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"), (prev - (1 - prev) * odds).alias("net_benefit_all"))


def representable(rules: dict[str, Sequence[str]], columns: Sequence[str]) -> list[tuple[str, int, int, str]]:
    """(rule, variables, representable, missing): how many of a rule's variables the table has."""
    return [(n, len(v), sum(c in columns for c in v), ", ".join(c for c in v if c not in columns)) for n, v in rules.items()]


def flag_comparison(df: DataFrame, key: str, score: str, label_a: str, label_b: str, target: float = 0.95) -> DataFrame:
    """Operating point under two label versions and the orders flagged by one but
    not the other (flag = score below that version's threshold)."""
    op_a = operating_point(df, label_a, score, target).select(F.col("threshold").alias("thr_a"))
    op_b = operating_point(df, label_b, score, target).select(F.col("threshold").alias("thr_b"))
    j = join_groups(join_groups(df.select(key, score), op_a, []), op_b, [])
    fa, fb = F.col(score) < F.col("thr_a"), F.col(score) < F.col("thr_b")
    return j.agg(
        F.first("thr_a").alias("threshold_a"), F.first("thr_b").alias("threshold_b"),
        F.count_if(fa).alias("flagged_a"), F.count_if(fb).alias("flagged_b"),
        F.count_if(fa & ~fb).alias("only_a"), F.count_if(fb & ~fa).alias("only_b"), F.count_if(fa & fb).alias("both"),
    )


def flagged_by_one(a: DataFrame, b: DataFrame, key: str, label: str = "y", score: str = "p", target: float = 0.95) -> DataFrame:
    """(key, p_a, p_b, threshold_a, threshold_b, flagged_by): rows that only one of two models flags
    (score below its own operating point), the 'wrong patients' of the other."""
    sides = {}
    for name, df in (("a", a), ("b", b)):
        thr = operating_point(df, label, score, target).select(F.col("threshold").alias(f"threshold_{name}"))
        sides[name] = join_groups(df.select(key, F.col(score).alias(f"p_{name}")), thr, [])
    j = sides["a"].join(sides["b"], key)
    fa, fb = F.col("p_a") < F.col("threshold_a"), F.col("p_b") < F.col("threshold_b")
    return j.where(fa != fb).withColumn("flagged_by", F.when(fa, "a").otherwise("b"))


def confident_joint(df: DataFrame, label: str, score: str) -> DataFrame:
    """Binary confident learning: per-class threshold t_c = mean predicted prob of
    class c over rows labelled c; a row is confidently class c when prob_c >= t_c
    (the larger prob wins when both hold). Returns counts per (given, confident)
    and the likely-error flag (given != confident)."""
    p1 = F.col(score)
    p0 = 1 - F.col(score)
    t = df.agg(
        F.avg(F.when(F.col(label) == 1, p1)).alias("_t1"), F.avg(F.when(F.col(label) == 0, p0)).alias("_t0")
    )
    j = join_groups(df, t, [])
    c1, c0 = p1 >= F.col("_t1"), p0 >= F.col("_t0")
    conf = F.when(c1 & c0, F.when(p1 >= p0, 1).otherwise(0)).when(c1, 1).when(c0, 0)
    return (
        j.withColumn("confident", conf)
        .where(F.col("confident").isNotNull())
        .groupBy(F.col(label).alias("given"), "confident")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("likely_error", (F.col("given") != F.col("confident")).cast("int"))
    )


def noise_weights(df: DataFrame, a: str, b: str, disagree_weight: float = 0.5, gold: str | None = None) -> DataFrame:
    """Disagreement-weighted training labels: label = gold if present else ``a``;
    weight 1 when both labellers agree (or gold exists), else ``disagree_weight``."""
    lab = F.coalesce(F.col(gold), F.col(a)) if gold else F.col(a)
    agree = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    if gold:
        agree = agree | F.col(gold).isNotNull()
    return df.withColumn("train_label", lab).withColumn("weight", F.when(agree, 1.0).otherwise(disagree_weight))


def direction_table(df: DataFrame, features: Sequence[str], label: str, expected: DataFrame | None = None) -> DataFrame:
    """Per feature: mean and median by class and the sign of (positive − negative)
    means; with ``expected`` (feature, expected_sign) a ``agrees`` flag is added."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])
    long = df.select(F.col(label).alias("_y"), F.explode(arr).alias("s")).select("_y", "s.feature", "s.v")
    means = long.groupBy("feature").agg(
        F.avg(F.when(F.col("_y") == 0, F.col("v"))).alias("mean_neg"), F.avg(F.when(F.col("_y") == 1, F.col("v"))).alias("mean_pos")
    )
    med = exact_quantiles(long, "v", [0.5], ["feature", "_y"], names=["median"])
    meds = med.groupBy("feature").agg(
        F.first(F.when(F.col("_y") == 0, F.col("median")), ignorenulls=True).alias("median_neg"),
        F.first(F.when(F.col("_y") == 1, F.col("median")), ignorenulls=True).alias("median_pos"),
    )
    out = means.join(meds, "feature", "left").withColumn("direction", F.signum(F.col("mean_pos") - F.col("mean_neg")).cast("int"))
    if expected is not None:
        out = out.join(expected, "feature", "left").withColumn("agrees", (F.col("direction") == F.col("expected_sign")).cast("int"))
    return out


def flag_rates_by(df: DataFrame, label: str, score: str, threshold: Column, by: Sequence[str], target: float = 0.95) -> DataFrame:
    """At one (global) threshold: per group n, flag rate (score < threshold),
    missed-positive rate and whether the group violates the sensitivity target."""
    fl = F.col(score) < threshold
    pos = F.col(label) == 1
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(fl.cast("double")).alias("flag_rate"),
        F.try_divide(F.count_if(fl & pos).cast("double"), F.count_if(pos)).alias("missed_positive_rate"),
    )
    return g.withColumn("violates", F.coalesce((F.col("missed_positive_rate") > 1 - target).cast("int"), F.lit(0)))


def rates_rollup(df: DataFrame, truth: Column, pred: Column, levels: Sequence[str]) -> DataFrame:
    """Confusion counts and sens/spec overall and per rollup level of ``levels``
    (``level`` = grouping id: 0 finest … all bits set = overall)."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(pred, F.lit(False))
    r = df.rollup(*levels).agg(
        F.grouping_id().alias("level"),
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    return rates(r)


def likely_errors(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Rows whose given label disagrees with the confident class, ranked by margin
    (how far the other class's probability exceeds its threshold), largest first."""
    p1, p0 = F.col(score), 1 - F.col(score)
    t = df.agg(F.avg(F.when(F.col(label) == 1, p1)).alias("_t1"), F.avg(F.when(F.col(label) == 0, p0)).alias("_t0"))
    j = join_groups(df, t, [])
    margin = F.when(F.col(label) == 1, p0 - F.col("_t0")).otherwise(p1 - F.col("_t1"))
    flagged = F.when(F.col(label) == 1, p0 >= F.col("_t0")).otherwise(p1 >= F.col("_t1"))
    return j.where(flagged).select(key, F.col(label).alias("given"), margin.alias("margin")).orderBy(F.desc("margin"), key)
