"""The ordered operators give the rows of plain windows and Spark's percentile on a given table."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables absent")
def test_ordered_operators_equal_plain_windows(spark):
    from yieldlens.operators import metrics, ordering
    from yieldlens.session import table

    lines = table(spark, SMOKE, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("qty"))
    order = ["qty", "l_orderkey", "l_linenumber"]
    for by in ([], ["l_returnflag"]):
        w = Window.partitionBy(*by).orderBy(*order)
        want = lines.withColumn("rn", F.row_number().over(w))
        got = ordering.sequence_number(lines, by, order, "rn")
        assert sorted(got.collect()) == sorted(want.collect())
        few = ordering.first_n(lines, by, order, 5, "rn")
        assert sorted(few.collect()) == sorted(want.where("rn <= 5").collect())
        plain = lines.groupBy(*by).agg(*[F.percentile("qty", q).alias(f"p{i}") for i, q in enumerate((0.025, 0.5, 0.975))])
        exact = metrics.exact_quantiles(lines, "qty", (0.025, 0.5, 0.975), by, ["p0", "p1", "p2"])
        flat = lambda df: [x if isinstance(x, str) else pytest.approx(x) for r in sorted(df.collect()) for x in r]
        assert [x for r in sorted(exact.collect()) for x in r] == flat(plain)
