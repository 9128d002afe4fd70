"""Grouped evaluation metrics. Every metric takes ``by`` and returns one row per
group, so pooled, per-fold, per-stratum and per-model scoring share one code path.

Ranking metrics collapse rows to distinct (group, score) first (map-side partial
aggregation) and then take skew-safe running sums over score, descending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import running_sums
from .sizing import with_scalars


def _grp(by: Sequence[str]) -> list[str]:
    return list(by or [])


def join_groups(df: DataFrame, per_group: DataFrame, g: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach per-group values. Without groups ``per_group`` is a global aggregate,
    i.e. exactly one row, so it is broadcast to every row."""
    if g:
        return df.join(per_group, list(g), how)
    return with_scalars(df, per_group)


def score_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, tp, fp, cum_tp, cum_fp): counts at each distinct score and
    inclusive cumulative counts from the highest score down. NULL scores/labels
    are dropped."""
    g = _grp(by)
    base = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    pts = base.groupBy(*g, score).agg(
        F.sum(F.col(label).cast("long")).alias("tp"),
        (F.count(F.lit(1)) - F.sum(F.col(label).cast("long"))).alias("fp"),
    )
    return running_sums(pts, g, [F.desc(score)], {"cum_tp": F.col("tp"), "cum_fp": F.col("fp")})


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """n, n_pos, auroc (ties count ½) and average precision (step-wise, as
    ``Σ ΔRecall · Precision``; not the trapezoid). NULL when a class is absent."""
    c = score_curve(df, label, score, by)
    npos, nneg = F.max("cum_tp"), F.max("cum_fp")
    return c.groupBy(*_grp(by)).agg(
        (npos + nneg).alias("n"),
        npos.alias("n_pos"),
        F.try_divide(F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0)), (npos * nneg).cast("double")).alias("auroc"),
        F.try_divide(
            F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))), npos.cast("double")
        ).alias("average_precision"),
    )


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One ROC point per distinct threshold: (by, threshold, tpr, fpr)."""
    c = score_curve(df, label, score, by)
    g = _grp(by)
    tot = c.groupBy(*g).agg(F.max("cum_tp").alias("_ptot"), F.max("cum_fp").alias("_ntot"))
    j = join_groups(c, tot, g)
    return j.select(
        *g,
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_tp").cast("double"), F.col("_ptot")).alias("tpr"),
        F.try_divide(F.col("cum_fp").cast("double"), F.col("_ntot")).alias("fpr"),
    )


def brier_accuracy(df: DataFrame, label: str, score: str, by: Sequence[str] = (), pred: str | None = None, cut: float = 0.5) -> DataFrame:
    """Brier score and accuracy of the class prediction (``pred`` or p > cut)."""
    p = F.col(score)
    yhat = F.col(pred) if pred else (p > cut).cast("int")
    return df.groupBy(*_grp(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - F.col(label)) ** 2).alias("brier"),
        F.avg((yhat == F.col(label)).cast("double")).alias("accuracy"),
    )


def confusion(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """2×2 counts (tp, fp, fn, tn) for boolean truth / prediction columns."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(pred, F.lit(False))
    return df.groupBy(*_grp(by)).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )


def rates(conf: DataFrame) -> DataFrame:
    """Sensitivity, specificity, PPV, NPV from confusion counts; NULL on 0/0."""
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return conf.withColumns(
        {"sensitivity": d("tp", "fn"), "specificity": d("tn", "fp"), "ppv": d("tp", "fp"), "npv": d("tn", "fn")}
    )


def class_report(df: DataFrame, label: str, pred: str, classes: Sequence[int] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """Per class: precision, recall, f1, support (zero division → 0), all classes in one scan."""
    g = _grp(by)
    stacked = df.select(*g, label, pred, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    conf = confusion(stacked, F.col(label) == F.col("class"), F.col(pred) == F.col("class"), [*g, "class"])
    pr = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rc = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return conf.select(
        *g, "class", pr.alias("precision"), rc.alias("recall"),
        F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"),
    )


def reliability_bins(df: DataFrame, label: str, score: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Uniform bins, right-closed (bin = ceil(p·k) − 1 clamped to [0, k−1]);
    empty bins are absent. (by, bin, n, mean_p, frac_pos)."""
    b = F.least(F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(*_grp(by), b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("frac_pos"))
    )


def _grid_index(p: Column, grid: Sequence[float]) -> Column:
    """Number of grid thresholds <= p (0..T), computed per row inside the JVM."""
    arr = F.array(*[F.lit(float(t)) for t in grid])
    return F.size(F.filter(arr, lambda t: t <= p))


def net_benefit(df: DataFrame, label: str, score: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Decision curve: for each threshold pt, treat p >= pt; net benefit
    ``tp/n − fp/n · pt/(1−pt)`` and treat-all ``prev − (1−prev) · pt/(1−pt)``
    (NULL at pt = 1). Rows are bucketed once by grid position and counted; no
    rows × thresholds product is formed."""
    g = _grp(by)
    grid = sorted(float(x) for x in grid)
    idx = _grid_index(F.col(score), grid)
    cnt = df.where(F.col(score).isNotNull()).groupBy(*g, idx.alias("_j")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos")
    )
    tot = cnt.groupBy(*g).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("n_pos"))
    # every (group, threshold j); rows at or above threshold j have grid index >= j
    thr = F.array(*[F.struct(F.lit(i + 1).alias("_j"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    keys = tot.select(*g, "n", "n_pos", F.explode(thr).alias("_t")).select(*g, "n", "n_pos", "_t._j", "_t.threshold")
    w = Window.partitionBy(*g).orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = (
        keys.join(cnt, [*g, "_j"], "left")
        .fillna(0, subset=["_n", "_pos"])
        .withColumn("tp", F.sum("_pos").over(w))
        .withColumn("fp", F.sum("_n").over(w) - F.col("tp"))
    )
    pt = F.col("threshold")
    odds = F.when(pt < 1, pt / (1 - pt))
    prev = F.col("n_pos") / F.col("n")
    return j.select(
        *g,
        "threshold",
        F.col("tp").cast("long").alias("tp"),
        F.col("fp").cast("long").alias("fp"),
        F.col("n").cast("long").alias("n"),
        (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"),
        (prev - (1 - prev) * odds).alias("net_benefit_all"),
    )


def best_threshold(nb: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of peak net benefit; the smallest one on ties; NULLs ignored."""
    return (
        nb.where(F.col("net_benefit").isNotNull() & ~F.isnan("net_benefit"))
        .groupBy(*_grp(by))
        .agg(
            F.max_by("threshold", F.struct(F.col("net_benefit"), -F.col("threshold"))).alias("best_threshold"),
            F.max("net_benefit").alias("best_net_benefit"),
        )
        .where(F.col("best_threshold").isNotNull())
    )


def operating_point(df: DataFrame, label: str, score: str, target: float = 0.95, decimals: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """High-sensitivity operating point.

    Candidates are the distinct half-even rounded scores (``decimals``); an order
    is flagged low-yield when its *unrounded* score is below the threshold;
    sensitivity = share of positives not flagged. Returns, per group, the largest
    candidate with sensitivity >= target and its sensitivity, flag rate and
    missed-positive rate; no row when no candidate qualifies. A group without
    positives has NULL sensitivity, which (like the published loop) never stops
    the scan, so its largest candidate is returned.

    Every row with rounded score c has p >= c' for every candidate c' < c and
    p < c' for every c' > c, so counts at each candidate are suffix sums of
    per-(c, p >= c) counts: at most 10^decimals + 1 rows per group.
    """
    g = _grp(by)
    c = F.bround(F.col(score), decimals)
    base = df.where(F.col(score).isNotNull()).withColumn("_c", c)
    y = F.col(label).cast("long")
    cnt = base.groupBy(*g, "_c").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(score) >= F.col("_c")).alias("_n_ge_own"),
        F.sum(y).alias("_pos"),
        F.sum(F.when(F.col(score) >= F.col("_c"), y).otherwise(0)).alias("_pos_ge_own"),
    )
    w_above = Window.partitionBy(*g).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g)
    k = cnt.select(
        *g,
        "_c",
        (F.coalesce(F.sum("_n").over(w_above), F.lit(0)) + F.col("_n_ge_own")).alias("_n_ge"),
        (F.coalesce(F.sum("_pos").over(w_above), F.lit(0)) + F.col("_pos_ge_own")).alias("_pos_ge"),
        F.sum("_n").over(w_all).alias("_ntot"),
        F.sum("_pos").over(w_all).alias("_ptot"),
    )
    sens = F.try_divide(F.col("_pos_ge").cast("double"), F.col("_ptot"))
    k = k.withColumn("sensitivity", sens).where(F.col("sensitivity").isNull() | (F.col("sensitivity") >= target))
    best = k.groupBy(*g).agg(F.max_by(F.struct("_c", "sensitivity", "_n_ge", "_pos_ge", "_ntot", "_ptot"), F.col("_c")).alias("b"))
    best = best.where(F.col("b").isNotNull())  # a global aggregate over no rows is one NULL row
    return best.select(
        *g,
        F.col("b._c").alias("threshold"),
        F.col("b.sensitivity").alias("sensitivity"),
        ((F.col("b._ntot") - F.col("b._n_ge")) / F.col("b._ntot")).alias("flag_rate"),
        F.try_divide((F.col("b._ptot") - F.col("b._pos_ge")).cast("double"), F.col("b._ptot")).alias("missed_positive_rate"),
    )


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's κ of two raters over any label set: (po − pe)/(1 − pe), NULL when pe = 1.
    Rows where either rating is NULL are ignored."""
    g = _grp(by)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    tot = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("n_agree"))
    ma = d.groupBy(*g, F.col(a).alias("_k")).agg(F.count(F.lit(1)).alias("_na"))
    mb = d.groupBy(*g, F.col(b).alias("_k")).agg(F.count(F.lit(1)).alias("_nb"))
    pe = ma.join(mb, [*g, "_k"]).groupBy(*g).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_s"))
    j = join_groups(tot, pe, g, "left")
    po = F.col("n_agree") / F.col("n")
    pe_ = F.coalesce(F.col("_s"), F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(*g, "n", "n_agree", po.alias("p_observed"), pe_.alias("p_expected"), F.try_divide(po - pe_, 1 - pe_).alias("kappa"))


def fleiss_kappa(long: DataFrame, item: str, rater: str, label: str, by: Sequence[str] = (), gate: float | None = None) -> DataFrame:
    """Fleiss' κ from long (item, rater, label) rows; items must share one rater
    count m (items with another count are excluded and reported as n_items_skipped).
    With ``gate`` a ``passes_gate`` flag (κ >= gate) is added (acceptance rule)."""
    g = _grp(by)
    # the counts below read the ratings several times; a rater may be costly to recompute
    d = cut_lineage(long.where(F.col(label).isNotNull()).select(*g, item, label))
    per_item = d.groupBy(*g, item).agg(F.count(F.lit(1)).alias("_m"))
    m_mode = per_item.groupBy(*g).agg(F.max("_m").alias("_mall"))
    ok = join_groups(per_item, m_mode, g)
    good = ok.where(F.col("_m") == F.col("_mall")).select(*g, item, "_mall")
    skipped = ok.where(F.col("_m") != F.col("_mall")).groupBy(*g).agg(F.count(F.lit(1)).alias("n_items_skipped"))
    nij = d.join(good, [*g, item]).groupBy(*g, item, label, "_mall").agg(F.count(F.lit(1)).alias("_nij"))
    m = F.first("_mall")
    pi = nij.groupBy(*g, item, "_mall").agg(F.try_divide(F.sum(F.col("_nij") ** 2) - m, m * (m - 1)).alias("_Pi"))
    pbar = pi.groupBy(*g).agg(F.avg("_Pi").alias("p_bar"), F.count(F.lit(1)).alias("n_items"), F.first("_mall").alias("raters"))
    pj = nij.groupBy(*g, label).agg(F.sum("_nij").alias("_cj"))
    tot = pj.groupBy(*g).agg(F.sum(F.col("_cj")).alias("_all"), F.collect_list("_cj").alias("_cs"))
    pe = tot.select(*g, F.aggregate("_cs", F.lit(0.0), lambda acc, x: acc + (x / F.col("_all")) ** 2).alias("p_e"))
    j = join_groups(pbar, pe, g)
    if g:
        j = j.join(skipped, g, "left")
    else:  # a global aggregate over possibly no rows still gives one row
        j = join_groups(j, skipped.agg(F.sum("n_items_skipped").alias("n_items_skipped")), g)
    res = j.select(
        *g,
        "n_items",
        "raters",
        F.coalesce(F.col("n_items_skipped"), F.lit(0)).cast("long").alias("n_items_skipped"),
        "p_bar",
        "p_e",
        F.try_divide(F.col("p_bar") - F.col("p_e"), 1 - F.col("p_e")).alias("kappa"),
    )
    if gate is None:
        return res
    return res.withColumn("passes_gate", F.coalesce((F.col("kappa") >= gate).cast("int"), F.lit(0)))


def exact_quantiles(
    df: DataFrame,
    col: str,
    qs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group (same as SQL
    ``quantile_cont``/``percentile``), NULLs ignored.

    Values are first collapsed to counts per (group, value), so neither a hot group nor
    a hot value is held in one task; skew-safe running sums of the counts give each value
    its ranks, and one partial aggregate picks the values at ranks floor/ceil(q·(n−1)).
    """
    g = _grp(by)
    names = list(names or [f"q{int(round(q * 1000)):04d}" for q in qs])
    v = df.where(F.col(col).isNotNull()).select(*g, F.col(col).cast("double").alias("_v"))
    counts = v.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_sums(counts, g, [F.col("_v")], {"_upto": F.col("_k")})
    total = ranked.groupBy(*g).agg(F.sum("_k").alias("_cnt"))
    if g:
        total = total.select("_cnt", *[F.col(c).alias(f"_t_{c}") for c in g])
        same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in g]
        ranked = ranked.join(total, same).drop(*[f"_t_{c}" for c in g])
    else:
        ranked = with_scalars(ranked, total)

    def at(rank: Column) -> Column:
        """The value whose ranks (from 1) hold ``rank``."""
        return F.max(F.when((F.col("_upto") - F.col("_k") < rank) & (rank <= F.col("_upto")), F.col("_v")))

    picks, out = [], []
    for i, (q, name) in enumerate(zip(qs, names, strict=True)):
        pos = F.lit(float(q)) * (F.col("_cnt") - 1)
        picks += [at(F.floor(pos) + 1).alias(f"_lo{i}"), at(F.ceil(pos) + 1).alias(f"_hi{i}")]
        picks.append(F.max(pos - F.floor(pos)).alias(f"_part{i}"))
        out.append((F.col(f"_lo{i}") + F.col(f"_part{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name))
    return ranked.groupBy(*g).agg(*picks).select(*g, *out)


def mean_ci(df: DataFrame, value: str, by: Sequence[str] = (), lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Mean and percentile interval (linear interpolation) of repeated-run values.
    This is a spread of correlated fold scores, not a sampling CI."""
    g = _grp(by)
    m = df.groupBy(*g).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    qs = exact_quantiles(df, value, [lo, hi], g, names=["lo", "hi"])
    return join_groups(m, qs, g, "left")
