"""Sources, sinks, retention and compaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ordering import latest_per_key

RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("arrival_seq", T.LongType()),
])

# Days each stream is kept.
RETENTION_DAYS = {
    "transaction": 7, "assessment": 30, "alert": 30, "notification_request": 7,
    "notification_result": 30, "invalid": 7, "quarantine": 7,
}

def read_records(spark: SparkSession, path: str, *, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(RECORD_SCHEMA).load(path)


def stream_records(spark: SparkSession, path: str, *, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """File feed; the amount per micro-batch is bounded."""
    return spark.readStream.format(fmt).schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, *, offsets_per_batch: int = 10_000_000) -> DataFrame:
    """Committed records of a topic from its beginning (needs the Kafka connector jar)."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed")
        .option("maxOffsetsPerTrigger", offsets_per_batch).load()
    )
    return records.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "partition", "offset", "timestamp")


def read_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Governance or ledger tables kept as parquet folders below ``root``."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def as_records(df: DataFrame, key: str) -> DataFrame:
    """Outgoing (key, value) records with the row as JSON."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != "key"])).alias("value"))


def write_outputs(outputs: Mapping[str, DataFrame], root: str, batch_id: int) -> None:
    """Write every output under its batch number; a repeated batch replaces itself."""
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def within_retention(df: DataFrame, time_us: str, now_us: Column, days: int) -> DataFrame:
    """Rows still inside the retention period; a plain comparison, so it prunes files."""
    return df.filter(F.col(time_us) >= now_us - F.lit(days * 86_400_000_000))


def compact(df: DataFrame, key: Sequence[str], offset: str) -> DataFrame:
    """Latest record of every key."""
    return latest_per_key(df, key, [F.col(offset)])
