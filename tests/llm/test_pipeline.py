"""The stages on a small corpus, each against what its operator's plain version says of its own input."""

import corpus_pipeline
from tests.llm import fixtures as fx


def test_stages(spark, tmp_path):
    docs = fx.documents(spark)
    bench = spark.createDataFrame([(1, " ".join(fx.prose(11, 30).replace(".", "").split()[:20]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "pieces":
            assert now.columns == docs.columns
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {5, 6, 7, 9, 10, 14, None} <= set(seen["quality"]) and not {0, 1, 2, 3, 11, 12, 13, 16, 17} & set(seen["quality"])
    assert 5 in seen["near_duplicates"] and not {6, 7} & set(seen["near_duplicates"])
    assert "shared30" in seen["repeated_passages"][9]["text"] and "shared30" not in seen["repeated_passages"][10]["text"]
    for i, r in seen["repeated_passages"].items():
        n, hit, _ = fx.contamination(r["text"], [(1, bench.first()["text"])])
        assert (i in seen["decontamination"]) == (not (hit and 20 * hit >= n))
    assert all(r["lossless"] for r in seen["pieces"].values())
    assert seen["quality"][5]["text"] == given[5] and seen["quality"][5]["n_chars"] == len(given[5])


def test_run_returns_the_last_stage(spark, tmp_path):
    fx.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {"doc_id", "piece_ids", "lossless"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)
