"""The online job on a file feed: equal to the batch job, across a restart and a rule change."""

import json
import time
import zlib

import pytest
from pyspark.sql import functions as F

from helpers import amount, count, event, record_rows, snapshot
from ledgerlens.operators.rules import compile_ruleset
from ledgerlens.operators.rulesets import accept_snapshots, validate_snapshots, with_active_version
from ledgerlens.plans.risk import run_batch
from ledgerlens.session import materialize
from ledgerlens.sources.ingest import parse_events
from ledgerlens.sources.tables import stream_records
from ledgerlens.streaming import online

DOCS = {1: snapshot(1, [amount(10_000), count(600, 3)], ["HIGH", "CRITICAL"]), 2: snapshot(2, [count(60, 2)])}
SCHEMA = "key string, value string, partition int, offset long, us long, arrival_seq long"


def feed():
    stream = []
    for i in range(120):
        seconds = 40 * i - (200 if i % 9 == 4 else 0) - (2000 if i % 31 == 7 else 0)
        stream.append(event(i, seconds, customerId=f"c{i % 5}", amountMinor=12_000 if i % 17 == 0 else 500))
        if i % 10 == 3:
            stream.append(event(i, seconds, customerId=f"c{i % 5}", amountMinor=12_000 if i % 17 == 0 else 500))
        if i % 23 == 5:
            stream.append({**stream[-1], "eventId": f"other-{i}"})
        if i % 29 == 6:
            stream.append({**stream[-1], "amountMinor": 1})
        if i % 13 == 2:
            stream.append(("bad", "{"))
    # records of one transaction share a partition, as the producer's key does it
    return [(*r[:2], zlib.crc32(r[0].encode()) % 3, r[3], r[4], r[5] * 10) for r in record_rows(stream)]


def write(spark, rows, path):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # file feeds order files by modification time


def test_stream_equals_batch_over_restart_and_rule_change(spark, tmp_path):
    rows = feed()
    third = len(rows) // 3
    published = [("ACTIVE", json.dumps(DOCS[1]), -1), ("ACTIVE", json.dumps({**DOCS[2], "version": 9}), 100),
                 ("ACTIVE", json.dumps(DOCS[2]), rows[2 * third][5] - 1)]
    rules_schema = "key string, payload string, arrival_seq long"
    sets = {v: compile_ruleset(d) for v, d in DOCS.items()}

    def run():
        queries = online.start(
            stream_records(spark, f"{tmp_path}/records", files_per_batch=1),
            spark.readStream.schema(rules_schema).parquet(f"{tmp_path}/rules"),
            lambda *_: sets, f"{tmp_path}/out", f"{tmp_path}/state", partitions=3, buckets=4)
        for q in queries:
            assert q.awaitTermination(300) and q.exception() is None

    spark.createDataFrame(published[:2], rules_schema).coalesce(1).write.parquet(f"{tmp_path}/rules")
    write(spark, rows[:third], f"{tmp_path}/records")
    write(spark, rows[third:2 * third], f"{tmp_path}/records")
    run()
    # stopped; a new rule set and the rest arrive; state comes from the checkpoint
    spark.createDataFrame(published[2:], rules_schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rules")
    write(spark, rows[2 * third:], f"{tmp_path}/records")
    run()

    accepted = accept_snapshots(validate_snapshots(spark.createDataFrame(published, rules_schema))).filter("disposition = 'accepted'")
    records = spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_micros("us"))
    events = with_active_version(parse_events(records), accepted).withColumn("bucket", F.pmod(F.xxhash64("customerId"), F.lit(4)))
    batch = run_batch(events, sets)

    def got(df):
        return sorted(tuple(r) for r in df.select(
            "arrival_seq", "assessmentId", "status", "finalSeverity", "late", "rulesetVersion",
            F.col("ruleResults").cast("string")).collect())

    streamed = got(online.read_output(spark, f"{tmp_path}/out", "assessment"))
    assert streamed == got(batch.assessments)
    assert {r[5] for r in streamed} == {1, 2} and {r[2] for r in streamed} == {"SUSPICIOUS", "INCONCLUSIVE", "NOT_SUSPICIOUS"}
    dispositions = {r.arrival_seq: r.outcome for r in batch.dispositions.filter("outcome <> 'invalid'").collect()}
    assert {r.arrival_seq: r.outcome for r in online.read_output(spark, f"{tmp_path}/out", "disposition").collect()} == dispositions
    assert set(dispositions.values()) == {"accepted", "duplicate", "TRANSACTION_IDENTITY_CONFLICT", "EVENT_IDENTITY_CONFLICT"}
    assert online.read_output(spark, f"{tmp_path}/out", "invalid").count() == batch.invalid.count() > 0
    assert online.read_output(spark, f"{tmp_path}/out", "alert").count() == batch.alerts.count()


def test_not_ready_without_a_rule_set(spark):
    empty = spark.createDataFrame([], "payload string")
    with pytest.raises(online.NotReady):
        online.require_ruleset(materialize(empty))


def test_windows_are_read_as_the_compiler_reads_them(spark):
    definition = {"type": "ANY", "children": [{"type": "COUNT_WINDOW", "windowSeconds": "600", "minimumCount": 1}, {
        "type": "ALL", "children": [{"type": "COUNT_WINDOW", "windowSeconds": 60, "minimumCount": 2}, amount(3)]}]}
    document = snapshot(1, [definition, amount(1)])
    text = json.dumps(document).replace('"windowSeconds": 60,', '"windowSeconds": 6e1,').replace('"rule-0"', '"\\"windowSeconds\\": 7"')
    got = spark.createDataFrame([(text,)], "t string").select(online.windows_of(F.col("t")).alias("w")).first().w
    assert sorted(got) == [60, 600] == sorted(compile_ruleset(json.loads(text)).windows())
