"""Small builders, and a plain sequential reading of the semantics to compare with."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ledgerlens.operators.rules import compile_ruleset

BASE = {
    "schemaVersion": 1, "eventId": "evt-a0", "transactionId": "pay-a0", "customerId": "client-a", "amountMinor": 10000,
    "currency": "BRL", "occurredAt": "2025-06-02T09:31:07Z", "transactionType": "PURCHASE", "channel": "APP",
    "merchantCountry": "BR", "deviceIdHash": "dev-7f", "traceId": "tr-00",
}
MINUTE = 60
T0 = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp())


def amount(minor, currency="BRL"):
    return {"type": "AMOUNT_THRESHOLD", "amountMinor": minor, "currency": currency}


def count(seconds, minimum):
    return {"type": "COUNT_WINDOW", "windowSeconds": seconds, "minimumCount": minimum}


def snapshot(version, definitions, severities=None, **changes):
    """Hashed snapshot document; the hash covers the key-sorted text without contentHash."""
    severities = severities or ["HIGH"] * len(definitions)
    doc = {
        "schemaVersion": 1, "snapshotId": f"snapshot-{version}", "version": version, "approvedChangeRuleVersionId": "change",
        "rules": [{"ruleId": f"rule-{i}", "ruleVersion": 1, "evaluationOrder": i, "severity": s, "definition": d}
                  for i, (d, s) in enumerate(zip(definitions, severities))],
        "createdAt": "2026-01-01T00:00:00Z",
    }
    doc.update(changes)
    text = json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {**doc, "contentHash": "sha256:" + hashlib.sha256(text.encode()).hexdigest()}


def at(seconds):
    return datetime.fromtimestamp(T0 + seconds, tz=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def event(n=1, seconds=60, **changes):
    return {**BASE, "eventId": f"event-{n}", "transactionId": f"tx-{n}", "occurredAt": at(seconds), **changes}


def record_rows(events):
    """(key, value, partition, offset, received, arrival_seq) for events or raw (key, text) pairs."""
    rows = []
    for i, e in enumerate(events):
        key, value = (e["transactionId"], json.dumps(e)) if isinstance(e, dict) else e
        rows.append((key, value, 0, i, T0 * 1_000_000 + i, i))
    return rows


def record_frame(spark, events):
    return spark.createDataFrame(
        record_rows(events), "key string, value string, partition int, offset long, us long, arrival_seq long"
    ).withColumn("timestamp", F.timestamp_micros("us")).drop("us")


def ruleset(*definitions, severities=None, version=1):
    return compile_ruleset(snapshot(version, list(definitions), severities))


H24, KEEP = 86_400_000, 900_000


def simulate(rows, windows):
    """rows: dicts sorted by seq with part, bucket, txn, eid, cus, value, us.  One pass, plain state."""
    t1, t2, seen, events, facts, out = {}, {}, {}, {}, {}, []
    for r in rows:
        ms = r["us"] // 1000
        t1[r["part"]] = now = max(t1.get(r["part"], ms), ms)
        known = seen.get((r["part"], r["txn"]))
        if known is None or now - known[1] >= H24:
            seen[(r["part"], r["txn"])] = (r["eid"], now)
        elif known[0] != r["eid"]:
            out.append((r["seq"], "TRANSACTION_IDENTITY_CONFLICT", None, None, None))
            continue
        t2[r["bucket"]] = now = max(t2.get(r["bucket"], ms), ms)
        known = events.get((r["cus"], r["eid"]))
        if known is None or now - known[1] >= H24:
            events[(r["cus"], r["eid"])] = (r["value"], now)
        else:
            out.append((r["seq"], "duplicate" if known[0] == r["value"] else "EVENT_IDENTITY_CONFLICT", None, None, None))
            continue
        kept = [f for f in facts.get(r["cus"], []) if f // 1000 >= now - KEEP]
        available = ms >= now - KEEP
        counts = tuple(
            1 + sum(r["us"] - w * 1_000_000 <= f <= r["us"] for f in kept) if available else None for w in windows)
        if available:
            kept.append(r["us"])
        facts[r["cus"]] = kept
        out.append((r["seq"], "accepted", available, ms < now, counts))
    return out
