"""Ledger rows and result records against a plain walk of the log, whole and in batches; the form of outgoing records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, event, record_frame
from ledgerlens.operators import notifications
from ledgerlens.sources import ingest, records
from ledgerlens.sources.contracts import violations
from ledgerlens.streaming import delivery

RESULT = ("channel", "status", "attemptCount", "providerReference", "reasonCode", "updatedAt", "traceId")


def log_rows(seed, n=240, requests=9):
    rng, rows = random.Random(seed), []
    for i in range(n):
        rid = f"r{rng.randrange(requests)}"
        kind = rng.choice(["CLAIM", "CLAIM", "SENT", "FAILED", "FAILED"])
        us = (T0 + i) * 1_000_000 + (i % 3) * 1000
        if kind == "CLAIM":
            body = {"schemaVersion": 1, "notificationRequestId": rid, "alertId": f"a{i}", "customerId": f"c{i}", "transactionId": f"t{i}",
                    "category": "SUSPICIOUS_TRANSACTION", "templateId": "x", "locale": "en", "requestedAt": "2026-01-01T00:00:00Z", "traceId": f"trace{i}"}
            if i % 17 == 3:
                body["category"] = "OTHER"
            rows.append(("CLAIM", i, us, "else" if i % 19 == 5 else rid, json.dumps(body), None, None, None, None, None))
        else:
            rows.append((kind, i, us, None, None, rid, rng.randrange(1, 4), rng.choice([None, "EMAIL", "SMS"]),
                         f"p{i}" if kind == "SENT" else None, f"why{i}" if kind == "FAILED" else None))
    return rows


def walk(rows):
    ledger, results, refused, rejected = {}, [], [], []

    def told(row, rid):
        results.append((rid, row["channel"], row["status"], row["attempt_count"], row["providerReference"], row["lastErrorCode"], row["updated_us"], row["traceId"]))

    for kind, at, us, key, value, rid, attempt, channel, provider, why in rows:
        if kind == "CLAIM":
            body = json.loads(value)
            if body["category"] == "OTHER" or key != body["notificationRequestId"]:
                rejected.append((key, at))
                continue
            row = ledger.setdefault(key, {
                **{f: body[f] for f in notifications.REQUEST_FIELDS}, "requestedAt": T0 * 1_000_000, "status": "PENDING", "attempt_count": 0,
                "channel": None, "providerReference": None, "lastErrorCode": None, "created_us": us, "updated_us": us})
            if row["status"] in ("PENDING", "FAILED"):
                row.update(status="SENDING", attempt_count=row["attempt_count"] + 1, providerReference=None, lastErrorCode=None, updated_us=us)
            elif row["status"] == "SENT":
                told(row, key)
            else:
                refused.append((key, at, "DELIVERY_ALREADY_IN_PROGRESS"))
        else:
            row = ledger.get(rid)
            if row is None or row["status"] != "SENDING" or row["attempt_count"] != attempt:
                refused.append((rid, at, "DELIVERY_NOT_SENDING"))
                continue
            row.update(status=kind, channel=channel or "EMAIL", providerReference=provider, lastErrorCode=why, updated_us=us)
            told(row, rid)
    return ledger, results, refused, rejected


def ledger_dict(df):
    return {r.notificationRequestId: {k: v for k, v in r.asDict().items() if k != "notificationRequestId"} for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_log_equals_a_plain_walk(spark, seed):
    rows = log_rows(seed)
    ledger, results, refused, rejected = walk(rows)
    log, bad = delivery.delivery_log(spark.createDataFrame(rows, delivery.LOG))
    resolved = notifications.with_results(log)
    assert ledger_dict(notifications.ledger_rows(resolved)) == ledger
    found = notifications.results(resolved)
    by_text = lambda rows: sorted(rows, key=repr)
    assert by_text((r.notificationRequestId, *[r[c] for c in RESULT]) for r in found.collect()) == by_text(results)
    assert sorted((r.notificationRequestId, r.at, r.reasonCode) for r in notifications.refusals(resolved).collect()) == sorted(refused)
    assert sorted((r.key, r.at) for r in bad.collect()) == sorted(rejected)


def test_batches_continue_the_ledger_over_a_restart(spark, tmp_path):
    rows = log_rows(5, 200, 6)
    ledger, results, refused, rejected = walk(rows)
    out = f"{tmp_path}/out"
    for a, b in ((0, 70), (70, 71), (71, 200)):
        spark.createDataFrame(rows[a:b], delivery.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        q = delivery.start(spark.readStream.schema(delivery.LOG).parquet(f"{tmp_path}/log"), out, f"{tmp_path}/state")
        assert q.awaitTermination(300) and q.exception() is None
    assert ledger_dict(delivery.read_ledger(spark, out)) == ledger
    got = delivery.read_results(spark, out).collect()
    by_text = lambda rows: sorted(rows, key=repr)
    assert by_text((r.notificationRequestId, *[r[c] for c in RESULT]) for r in got) == by_text(results)
    sent = delivery.read_results(spark, out, records=True)
    assert sent.count() == len(results)
    # the contract knows one channel; all else conforms
    wrong = F.array_join(violations("notification_result", F.col("value")), ",")
    assert sent.where(wrong != F.when(F.col("value").contains('"SMS"'), "channel:enum").otherwise("")).isEmpty()
    delivery.process(spark.createDataFrame([], delivery.LOG), 1, out)  # committed, so skipped
    assert ledger_dict(delivery.read_ledger(spark, out)) == ledger


def test_absent_and_null_fields(spark):
    df = spark.createDataFrame([("k", 1, "topic", 0, 5, "h", None, "WHY", 1_500_000), (None, 1, "topic", 0, 6, "h", 1, "a \"quoted\" é", 0)],
                               "key string, schemaVersion int, sourceTopic string, sourcePartition int, sourceOffset long, payloadHash string, "
                               "sourceSchemaVersion int, reasonCode string, detected_us long")
    sent = records.to_records("invalid", df)
    assert [(r.key, r.value) for r in sent.orderBy(F.desc("key")).collect()] == [
        ("k", '{"schemaVersion":1,"sourceTopic":"topic","sourcePartition":0,"sourceOffset":5,"payloadHash":"h","sourceSchemaVersion":null,'
              '"reasonCode":"WHY","detectedAt":"1970-01-01T00:00:01.500Z"}'),
        (None, '{"schemaVersion":1,"sourceTopic":"topic","sourcePartition":0,"sourceOffset":6,"payloadHash":"h","sourceSchemaVersion":1,'
               '"reasonCode":"a \\"quoted\\" é","detectedAt":"1970-01-01T00:00:00Z"}')]
    back = {r.sourceOffset: (r.sourceSchemaVersion, r.reasonCode) for r in records.from_records("invalid", sent).collect()}
    assert back == {5: (None, "WHY"), 6: (1, 'a "quoted" é')}


def test_a_field_that_may_only_be_absent_is_left_out(spark):
    events = ingest.parse_events(record_frame(spark, [event(1), event(2, merchantCategory="5411")])).withColumn(
        "merchantCategory", F.when(F.col("eventId") == "event-2", "5411"))
    values = {r.eventId: r.value for r in events.withColumn("value", records.record_text("transaction_event", events)).collect()}
    assert "merchantCategory" not in values["event-1"] and '"merchantCategory":"5411"' in values["event-2"]
    texts = spark.createDataFrame([(v,) for v in values.values()], "value string")
    assert texts.where(F.size(violations("transaction_event", F.col("value"))) > 0).isEmpty()
    assert json.loads(values["event-1"])["occurredAt"] == event(1)["occurredAt"]
