"""Stored governance tables: consistent versions, refused schemas, plain scans."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources.stored import SchemaMismatch, Stored

SCHEMAS = {"a": "k string, n long", "b": "k string, tags array<string>"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_consistent(spark, tmp_path):
    root, start = str(tmp_path), Stored(spark, str(tmp_path), SCHEMAS)
    assert start.version == -1 and rows(start.table("a")) == []
    a = spark.createDataFrame([("x", 1)], SCHEMAS["a"])
    b = spark.createDataFrame([("x", ["t"])], SCHEMAS["b"])
    first = start.write({"a": a.withColumn("more", F.lit(1)), "b": b})
    second = first.write(appended={"a": a.withColumn("n", F.lit(2).cast("long"))})
    third = second.write({"a": a.limit(0)})
    assert [rows(v.table("a")) for v in (first, second, third)] == [[("x", 1)], [("x", 1), ("x", 2)], []]
    assert rows(third.table("b")) == [("x", ["t"])] and Stored(spark, root, SCHEMAS).version == 2
    assert rows(Stored(spark, root, SCHEMAS, version=1).table("a")) == [("x", 1), ("x", 2)]
    a.write.parquet(f"{root}/a/left-behind")
    assert rows(Stored(spark, root, SCHEMAS).table("a")) == []
    with pytest.raises(RuntimeError, match="somebody else"):
        second.write({"a": a})
    with pytest.raises(LookupError):
        Stored(spark, root, SCHEMAS, version=9)


def test_other_schemas_are_refused(spark, tmp_path):
    tables = Stored(spark, str(tmp_path), SCHEMAS)
    with pytest.raises(SchemaMismatch, match="given"):
        tables.write({"a": spark.createDataFrame([("x", "1")], "k string, n string")})
    tables.write({"a": spark.createDataFrame([("x", 1)], SCHEMAS["a"])})
    with pytest.raises(SchemaMismatch, match="stored"):
        Stored(spark, str(tmp_path), {"a": "k string, n int"})


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    tables = Stored(spark, str(tmp_path), SCHEMAS).write({"a": spark.range(10).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))})
    plan = tables.table("a").filter("n > 7").select("n")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(n), GreaterThan(n,7)]" in plan and "ReadSchema: struct<n:bigint>" in plan
