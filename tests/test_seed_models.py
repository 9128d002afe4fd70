"""The seed check refits all five of the reference's models."""

from pyspark.sql import functions as F

from yieldlens.plans import q_models as Q


def test_seed_check_has_all_models(spark, monkeypatch):
    rows = [(i, i % 40, "unit0", int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "order_id long, subject_id long, unit string, y int")

    def scores(self, model, fs):
        p = F.pmod(F.xxhash64("order_id", "rep"), F.lit(1000)) / 1000
        held = self.f.join(self.folds.where("fold = 1"), self.group)
        return held.select("rep", "fold", "order_id", "unit", "y", p.alias("p"), F.lit(1).alias("class"))

    monkeypatch.setattr(Q, "_frame", lambda spark, sf: df)
    monkeypatch.setattr(Q.Protocol, "scores", scores)
    got = {r["model"]: r["n_splits"] for r in Q.model_seed_robustness(spark, "").collect()}
    assert got == dict.fromkeys(["logistic", "forest", "boosting", "rff_svm", "knn"], 25)
