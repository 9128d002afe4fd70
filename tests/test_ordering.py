"""Skew-safe ordered operators equal plain windows, including a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from yieldlens.operators.ordering import first_n, running_sums, sequence_number


def _skewed(spark, n=3000):
    # key 0 holds a third of all rows; ties in `t` broken by id
    rows = [(i, 0 if i % 3 == 0 else i % 37, (i * 7919) % 101, float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long, t long, v double")


def test_sequence_number_matches_window(spark):
    df = _skewed(spark)
    got = sequence_number(df, ["k"], ["t", "id"], "rn").select("id", "rn")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_global_running_sum(spark):
    df = _skewed(spark)
    got = running_sums(df, [], [F.desc("t"), F.col("id")], {"cs": F.col("v")}).select("id", "cs")
    w = Window.orderBy(F.desc("t"), F.col("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("cs"))
    assert got.exceptAll(want).count() == 0


def test_first_n_with_per_row_quota(spark):
    df = _skewed(spark).withColumn("q", F.when(F.col("k") == 0, 7).otherwise(2))
    got = first_n(df, ["k"], ["t", "id"], "q").select("id")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("r", F.row_number().over(w)).where("r <= q").select("id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
