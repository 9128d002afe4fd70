"""The bands of the signatures, 32 rows a set, are never broadcast, whatever size the planner gives them."""

from yieldlens.llm import minhash


def test_exploded_bands_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, minhash.written

    def spy(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(minhash, "written", spy)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 7 : i % 7 + 40])) for i in range(30)]
    out = minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 30 and len({r["component_id"] for r in out}) < 30
    assert "SortMergeJoin" in plans["minhash-buckets"] and "Broadcast" not in plans["minhash-buckets"]
