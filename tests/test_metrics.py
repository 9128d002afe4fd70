"""Metrics against brute-force definitions and published arithmetic."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldlens.operators import metrics as M


def _auroc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def _ap(y, p):
    # step-wise: sum over distinct thresholds (desc) of (R_k - R_{k-1}) * P_k
    y, p = np.array(y), np.array(p)
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        tp = (y[sel] == 1).sum()
        r, prec = tp / P, tp / sel.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(y * 0.2 + rng.random(300) * 0.8, 0, 1), 2)  # rounded → ties
    g = rng.integers(0, 3, 300)
    rows = [(int(i), int(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, p, g))]
    return spark.createDataFrame(rows, "key long, y int, p double, g int"), y, p, g


def test_auroc_ap_pooled_and_grouped(scored):
    df, y, p, g = scored
    r = M.ranking_metrics(df, "y", "p").first()
    assert r.auroc == pytest.approx(_auroc(y, p), abs=1e-12)
    assert r.average_precision == pytest.approx(_ap(y, p), abs=1e-12)
    by = {row.g: row for row in M.ranking_metrics(df, "y", "p", ["g"]).collect()}
    for k in range(3):
        s = g == k
        assert by[k].auroc == pytest.approx(_auroc(y[s], p[s]), abs=1e-12)


def test_auroc_symmetry_and_single_class(scored, spark):
    df, y, p, _ = scored
    a = M.ranking_metrics(df, "y", "p").first().auroc
    b = M.ranking_metrics(df.withColumn("q", 1 - F.col("p")), "y", "q").first().auroc
    assert a + b == pytest.approx(1.0, abs=1e-12)
    one = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, p double")
    assert M.ranking_metrics(one, "y", "p").first().auroc is None


def _op_loop(y, p, target=0.95):
    best = None
    for thr in np.unique(np.round(p, 3)):
        flagged = p < thr
        sens = np.mean(~flagged[y == 1])
        if sens < target:
            break
        best = (thr, sens, np.mean(flagged), np.mean(flagged[y == 1]))
    return best


def test_operating_point_equals_loop(scored, spark):
    df, y, p, _ = scored
    r = M.operating_point(df, "y", "p", 0.95).first()
    thr, sens, flag, missed = _op_loop(y, p)
    assert (r.threshold, r.sensitivity, r.flag_rate, r.missed_positive_rate) == pytest.approx((thr, sens, flag, missed))
    never = spark.createDataFrame([(1, 0.1), (0, 0.9)], "y int, p double")
    assert M.operating_point(never, "y", "p", 1.01).count() == 0  # unattainable → no row


def test_net_benefit_equals_loop(scored):
    df, y, p, _ = scored
    grid = [0.05, 0.1, 0.15, 0.2, 0.3]
    got = {r.threshold: r for r in M.net_benefit(df, "y", "p", grid).collect()}
    n = len(y)
    for pt in grid:
        pred = p >= pt
        tp, fp = np.sum(pred & (y == 1)), np.sum(pred & (y == 0))
        assert got[pt].net_benefit == pytest.approx(tp / n - fp / n * pt / (1 - pt))
        assert got[pt].net_benefit_all == pytest.approx(y.mean() - (1 - y.mean()) * pt / (1 - pt))


def test_published_scan_all_net_benefit(spark):
    rows = [(1,)] * 1004 + [(0,)] * (4387 - 1004)
    df = spark.createDataFrame(rows, "y int").withColumn("p", F.lit(0.5))
    got = {r.threshold: round(r.net_benefit_all, 4) for r in M.net_benefit(df, "y", "p", [0.05, 0.1, 0.15, 0.2, 0.3]).collect()}
    assert got == {0.05: 0.1883, 0.1: 0.1432, 0.15: 0.0928, 0.2: 0.0361, 0.3: -0.1016}


def test_cohen_kappa_golden(spark):
    # published confusion (rule vs external): 4587, 654 / 965, 1465
    rows = ([("N", "N")] * 4587) + ([("N", "P")] * 654) + ([("P", "N")] * 965) + ([("P", "P")] * 1465)
    r = M.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert r.n == 7671 and r.n_agree == 6052
    assert round(r.p_observed, 4) == 0.7889 and round(r.kappa, 4) == 0.4951


def test_fleiss_matches_formula(spark):
    items = {1: ["a", "a", "b"], 2: ["b", "b", "b"], 3: ["a", "b", "a"], 4: ["a", "a", "a"]}
    rows = [(i, r, lab) for i, labs in items.items() for r, lab in enumerate(labs)]
    got = M.fleiss_kappa(spark.createDataFrame(rows, "item int, rater int, label string"), "item", "rater", "label").first()
    m, cats = 3, ["a", "b"]
    nij = np.array([[labs.count(c) for c in cats] for labs in items.values()])
    pi = ((nij ** 2).sum(1) - m) / (m * (m - 1))
    pj = nij.sum(0) / nij.sum()
    k = (pi.mean() - (pj ** 2).sum()) / (1 - (pj ** 2).sum())
    assert got.kappa == pytest.approx(k)


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, 5.0), (2, None)], "g int, v double")
    q = {r.g: r for r in M.exact_quantiles(df, "v", [0.5, 0.25], ["g"], names=["med", "q1"]).collect()}
    assert q[1].med == 2.5 and q[1].q1 == pytest.approx(np.percentile([1, 2, 3, 10], 25))
    assert q[2].med == 5.0


def test_exact_quantiles_of_a_hot_value_and_a_null_group(spark):
    rows = [(None if i % 7 == 0 else i % 2, 0.0 if i % 3 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.g: list(r)[1:] for r in M.exact_quantiles(df, "v", qs, ["g"]).collect()}
    want = {g: np.quantile([v for k, v in rows if k == g], qs).tolist() for g in (None, 0, 1)}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g])
    whole = M.exact_quantiles(df, "v", qs).first()
    assert list(whole) == pytest.approx(np.quantile([v for _, v in rows], qs).tolist())
    assert M.exact_quantiles(df.where("false"), "v", [0.5]).first()[0] is None


def test_reliability_bins_right_closed(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.0), (1, 1.0), (0, 0.55)], "y int, p double")
    b = {r.bin: r.n for r in M.reliability_bins(df, "y", "p").collect()}
    assert b == {0: 2, 5: 1, 9: 1}


def test_fleiss_reads_its_ratings_once(spark):
    """A costly rater runs once a row, however many counts read the ratings."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def rate(i):
        seen.add(1)
        return str(i % 2)

    long = spark.range(30).select(F.col("id").alias("item"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("rater")).withColumn("label", rate("item"))
    assert M.fleiss_kappa(long, "item", "rater", "label").first()["kappa"] == pytest.approx(1.0)
    assert seen.value <= 120  # filter and column may each call it; several times that before
