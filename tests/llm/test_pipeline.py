"""The pipeline stage by stage on awkward rows, and whole on empty tables."""

import corpus_pipeline as pipeline
from fixtures import docs, edited, empty, sentences
from pyspark.sql import functions as F

from ledgerlens.llm import pii


def test_stages(spark, tmp_path):
    texts = sentences(21, 5, 120)
    bench = spark.createDataFrame([(1, texts[1])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(700 + i, t, "en") for i, t in enumerate([*texts, edited(texts[0], 1, 1), texts[2] + " write to me@example.org"])]
    df = docs(spark).unionByName(docs(spark, rows))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    before, now, seen = df, df, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, now.count()))
    counts = dict(seen)
    by = spark.read.parquet(f"{tmp_path}/personal_data").collect()
    ids = {r.doc_id for r in by}
    assert not ids & {2, 4, 5, 6, 9, 705, 701} and {1, 3, 7, 8, 11, 12, 14, 700, 702, None} <= ids and 706 not in ids  # 706 is 702 and five words
    assert counts["decontamination"] == counts["personal_data"] == len(by)
    assert all("@c.example" not in r.text and r.n_chars == len(r.text) for r in by)
    assert pii.spans(spark.read.parquet(f"{tmp_path}/personal_data")).where(F.exists("spans", lambda s: s["rank"] < 4)).count() == 0
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == ids


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
