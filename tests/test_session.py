"""Tables that lineage is cut by."""

from pyspark.sql import functions as F

from ledgerlens.session import materialize


def test_materialized_digests_take_little_more_than_their_bytes(spark):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    kept = materialize(rows)
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).isEmpty() and kept.count() == 20_000
    files = kept.inputFiles()
    read = spark.read.format("binaryFile").load(files)
    assert read.agg(F.sum("length")).first()[0] < 20_000 * 55  # 64 letters for 32 bytes, and the number
