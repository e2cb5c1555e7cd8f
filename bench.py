"""Headline timings on local[$BENCH_CPUS]; prints one JSON line.

The published comparison figure is events per second through the whole chain (parse,
validate, identity, rules, all outputs), so the batch and online runs start from raw
JSON records, prepared once before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ledgerlens.operators.rules import compile_ruleset  # noqa: E402
from ledgerlens.plans import catalog, fixtures, risk  # noqa: E402
from ledgerlens.session import configure  # noqa: E402
from ledgerlens.sources import tables  # noqa: E402
from ledgerlens.streaming import online  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

AMOUNT_ONLY = {"version": 1, "rules": [{"ruleId": "amount", "ruleVersion": 1, "evaluationOrder": 0, "severity": "HIGH",
               "definition": {"type": "AMOUNT_THRESHOLD", "amountMinor": 10000, "currency": "BRL"}}]}

MICRO_BATCHES = 3

REGISTERED = ("ingest_valid_split", "identity_24h", "history_counts", "assessments_dense", "ruleset_asof",
              "governance_decisions", "ledger_attempts", "reconcile_counts", "latency_summary")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def batch(spark: SparkSession, path: str, document: dict) -> None:
    out = risk.run_records(tables.read_records(spark, path), {1: compile_ruleset(document)}, F.lit(1))
    for df in (out.assessments, out.alerts, out.requests, out.quarantined, out.invalid):
        drain(df)


def stream(spark: SparkSession, path: str, root: str) -> None:
    """All records in ``MICRO_BATCHES`` micro-batches of arrival order."""
    snapshots = fixtures.published_ruleset(spark, AMOUNT_ONLY)
    snapshots.write.mode("overwrite").parquet(f"{root}/rules")
    queries = online.start(
        tables.stream_records(spark, path, files_per_batch=int(CPUS)), spark.readStream.schema(snapshots.schema).parquet(f"{root}/rules"),
        None, f"{root}/out", f"{root}/state", buckets=64)
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    batches = online.read_output(spark, f"{root}/out", "disposition").select("batch_id").distinct().count()
    assert batches == MICRO_BATCHES, batches


def feed(raw: DataFrame, path: str) -> None:
    """The records in arrival order, one write for each micro-batch (a file feed orders files by time)."""
    low, high = raw.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    part = F.floor((F.col("arrival_seq") - low) * MICRO_BATCHES / (high + 1 - low))
    for i in range(MICRO_BATCHES):
        raw.where(part == i).repartition(int(CPUS)).write.mode("append").parquet(path)
        time.sleep(1.1)


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    root = tempfile.mkdtemp(prefix="ledgerlens-bench-")
    path = f"{root}/records"
    fixtures.raw_records(spark, SF_DIR, 60).repartition(int(CPUS), "partition").write.parquet(path)
    records = spark.read.parquet(path).count()

    batch(spark, path, AMOUNT_ONLY)  # JVM warm-up
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        started = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - started, 3)

    timed("batch_amount_rule", lambda: batch(spark, path, AMOUNT_ONLY))
    timed("batch_four_rules", lambda: batch(spark, path, fixtures.ruleset_document()))
    for name in REGISTERED:
        catalog.forget_shared()
        timed(name, lambda n=name: drain(catalog.QUERIES[n](spark, SF_DIR)))
    feed(spark.read.parquet(path), f"{root}/feed")
    timed("online_amount_rule", lambda: stream(spark, f"{root}/feed", root))

    print(json.dumps({
        "metric": "total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": SF_DIR.rsplit("sf", 1)[-1], "records": records,
        "events_per_second": {n: round(records / seconds[n], 1) for n in ("batch_amount_rule", "batch_four_rules", "online_amount_rule")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
