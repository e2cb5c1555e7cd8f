"""Transaction-shaped views over the given tables, for the registered queries.

``time_divisor`` compresses event time: 1 keeps the 30 real days (24-hour horizon),
60 packs them into half a day (history and counts).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.ids import FINGERPRINT_FIELDS, iso_instant


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The rows of a table dealt over all tasks by their key.

    A file may be one row group, so one task; making and parsing records from it is then not left to that task.  Only the columns
    that are asked for are shuffled.
    """
    return table(spark, sf_dir, name).repartition(key)


def transactions(spark: SparkSession, sf_dir: str, time_divisor: int = 1) -> DataFrame:
    """Parsed-event rows with replays and conflicts, in a fixed arrival order."""
    events = table(spark, sf_dir, "events")
    # A one-row aggregate over one column; joined on a constant, broadcast by its size.
    scale = events.agg(
        F.min(F.expr("unix_micros(cast(ts as timestamp))")).alias("t0"), F.count("*").alias("n")
    ).withColumn("one", F.lit(1))
    base = (
        spread(spark, sf_dir, "events", "event_id").select("event_id", "user_id", "value", F.expr("unix_micros(cast(ts as timestamp))").alias("us"),
                      F.lit(1).alias("one"))
        .join(F.broadcast(scale), "one")
        .withColumn("ms", F.expr("us div 1000"))
        .withColumn("t0", F.expr("t0 div 1000"))
        .select(
            "event_id", "user_id", "n",
            F.concat(F.lit("evt-"), "event_id").alias("eventId"),
            F.concat(F.lit("txn-"), "event_id").alias("transactionId"),
            F.concat(F.lit("cus-"), "user_id").alias("customerId"),
            F.round(F.col("value") * 100).cast("long").alias("amountMinor"),
            F.when(F.col("event_id") % 10 == 0, "USD").otherwise("BRL").alias("currency"),
            F.expr(f"t0 + (ms - t0) div {time_divisor}").alias("occurred_ms"),
            (F.col("event_id") % 12).cast("int").alias("partition"),
            (F.col("user_id") % 12).alias("bucket"),
            (F.col("event_id") * 10).alias("s0"),
        )
    )
    eid = F.col("event_id")
    copies = F.array_compact(F.array(
        _copy(F.lit(True), F.col("s0") + F.when(eid % 7 == 0, 255).otherwise(0)),
        _copy(eid % 50 == 0, F.col("s0") + 1003),
        _copy(eid % 97 == 0, F.col("s0") + 1006, suffix="-x"),
        _copy(eid % 89 == 0, F.col("s0") + 1007, extra=1),
        _copy(eid % 53 == 0, F.col("s0") + 10 * F.floor(F.col("n") * 5 / 100) + 1),
    ))
    return (
        base.withColumn("c", F.explode(copies))
        .select(
            F.col("c.seq").alias("arrival_seq"), "event_id", "user_id", "partition", "bucket",
            F.lit(1).alias("schemaVersion"),
            F.concat("eventId", "c.suffix").alias("eventId"), "transactionId", "customerId",
            (F.col("amountMinor") + F.col("c.extra")).alias("amountMinor"), "currency",
            "occurred_ms", (F.col("occurred_ms") * 1000).alias("occurred_us"),
            F.lit("PURCHASE").alias("transactionType"), F.lit("APP").alias("channel"),
            F.lit("BR").alias("merchantCountry"), F.lit("device").alias("deviceIdHash"),
            F.concat(F.lit("trace-"), "event_id").alias("traceId"),
            F.col("c.seq").alias("offset"), (F.col("c.seq") * 1000).alias("received_us"),
        )
        .withColumns({
            "key": F.col("transactionId"),
            "payload_hash": F.sha2(F.concat_ws("|", "eventId", "transactionId", "amountMinor"), 256),
            "schema_valid": F.lit(True), "valid": F.lit(True), "ruleset_version": F.lit(1).cast("long"),
        })
    )


def _copy(when, seq, suffix: str = "", extra: int = 0):
    return F.when(when, F.struct(seq.cast("long").alias("seq"), F.lit(suffix).alias("suffix"),
                                 F.lit(extra).alias("extra")))


# The rule set of the registered queries: every node type, a nested one included.
RULES = [
    ("amount", "HIGH", {"type": "AMOUNT_THRESHOLD", "amountMinor": 30000, "currency": "BRL"}),
    ("burst", "CRITICAL", {"type": "COUNT_WINDOW", "windowSeconds": 600, "minimumCount": 3}),
    ("both", "MEDIUM", {"type": "ALL", "children": [
        {"type": "AMOUNT_THRESHOLD", "amountMinor": 10000, "currency": "BRL"},
        {"type": "COUNT_WINDOW", "windowSeconds": 300, "minimumCount": 2}]}),
    ("either", "LOW", {"type": "ANY", "children": [
        {"type": "COUNT_WINDOW", "windowSeconds": 60, "minimumCount": 2},
        {"type": "AMOUNT_THRESHOLD", "amountMinor": 40000, "currency": "USD"}]}),
]


def ruleset_document(version: int = 1) -> dict:
    return {"version": version, "rules": [
        {"ruleId": rule_id, "ruleVersion": 1, "evaluationOrder": i, "severity": severity, "definition": definition}
        for i, (rule_id, severity, definition) in enumerate(RULES)]}


def published_ruleset(spark: SparkSession, document: dict, arrival_seq: int = -1) -> DataFrame:
    """``document`` completed to a hashed snapshot record."""
    full = {"schemaVersion": 1, "snapshotId": "snapshot", "approvedChangeRuleVersionId": "change",
            "createdAt": "2024-01-01T00:00:00Z", **document}
    text = json.dumps(full, sort_keys=True, separators=(",", ":"))
    full["contentHash"] = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    return spark.createDataFrame([("ACTIVE", json.dumps(full), arrival_seq)], "key string, payload string, arrival_seq long")


def raw_records(spark: SparkSession, sf_dir: str, time_divisor: int = 1) -> DataFrame:
    """The transaction view as raw JSON records."""
    tx = transactions(spark, sf_dir, time_divisor)
    fields = [iso_instant(F.col("occurred_us")).alias(f) if f == "occurredAt" else F.col(f) for f in FINGERPRINT_FIELDS]
    return tx.select("key", F.to_json(F.struct(*fields)).alias("value"), "partition", "offset",
                     F.timestamp_micros("received_us").alias("timestamp"), "arrival_seq")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON records, one per event; every thirteenth kind of event id is damaged."""
    kind = F.col("event_id") % 13
    body = F.format_string(
        '{"schemaVersion":%s,"eventId":"%s","transactionId":"txn-%s","customerId":"cus-%s","amountMinor":%s,'
        '"currency":"%s","occurredAt":"%s","transactionType":"PURCHASE","channel":"APP","merchantCountry":"BR",'
        '"deviceIdHash":"device","traceId":"trace-%s"%s}',
        F.when(kind == 1, "2").otherwise("1"),
        F.when(kind == 2, " ").otherwise(F.concat(F.lit("evt-"), F.col("event_id").cast("string"))),
        F.col("event_id").cast("string"), F.col("user_id").cast("string"),
        F.when(kind == 3, "-1").when(kind == 4, '"12"').otherwise(
            F.round(F.col("value") * 100).cast("long").cast("string")),
        F.when(kind == 5, "REAL").otherwise("BRL"),
        F.when(kind == 6, "2024-01-01").otherwise(
            F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z"))),
        F.col("event_id").cast("string"),
        F.when(kind == 7, ',"note":"x"').when(kind == 8, ',"merchantCategory":"5411"').otherwise(""),
    )
    return spread(spark, sf_dir, "events", "event_id").select(
        F.when(kind == 9, "other").when(kind == 10, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("txn-"), F.col("event_id").cast("string"))).alias("key"),
        F.when(kind == 11, "not json").when(kind == 12, F.lit(None).cast("string")).otherwise(body).alias("value"),
        (F.col("event_id") % 12).cast("int").alias("partition"),
        F.expr("event_id div 12").alias("offset"),
        F.expr("cast(ts as timestamp)").alias("timestamp"),
        F.col("event_id").alias("arrival_seq"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order proposes a change to one of three rules of one of 25 rule sets."""
    key = F.col("o_orderkey")
    head = (F.col("o_custkey") % 25).cast("string")
    definition = F.when(key % 17 == 5, '{"type":"SUM_WINDOW"}').otherwise(F.format_string(
        '{"amountMinor":%s,"currency":"BRL","type":"AMOUNT_THRESHOLD"}',
        F.round(F.col("o_totalprice") * 100).cast("long").cast("string")))
    return spread(spark, sf_dir, "orders", "o_orderkey").select(
        F.concat(F.lit("head-"), head).alias("head_key"),
        F.concat(F.lit("rule-"), head, F.lit("-"), (key % 3).cast("string")).alias("rule_id"),
        F.concat(F.lit("ver-"), key.cast("string")).alias("rule_version_id"),
        F.when(key % 29 == 7, "DELETE").when(F.col("o_orderstatus") == "F", "RETIRE").otherwise("UPSERT").alias("change_type"),
        definition.alias("definition"),
        F.concat(F.lit("user-"), (key % 5).cast("string")).alias("author"),
        key.alias("proposal_seq"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two decisions per order: one near its proposal, one much later."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    decision = F.when(F.col("o_orderpriority") == "5-LOW", "REJECT").otherwise("APPROVE")
    version = F.concat(F.lit("ver-"), key.cast("string"))

    def user(n):
        return F.concat(F.lit("user-"), (n % 5).cast("string"))

    return orders.select(
        (key * 2).alias("decision_seq"), version.alias("rule_version_id"), decision.alias("decision"),
        user(F.col("o_custkey")).alias("approver"),
    ).unionByName(orders.select(
        (key * 2 + 301).alias("decision_seq"), version.alias("rule_version_id"),
        F.lit("APPROVE").alias("decision"), user(key + 1).alias("approver")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier publishes one snapshot; some with a wrong hash, an unknown node or another key."""
    key = F.col("s_suppkey")
    node = F.when(key % 11 == 5, '{"type":"SUM_WINDOW"}').otherwise(F.format_string(
        '{"amountMinor":%s,"currency":"BRL","type":"AMOUNT_THRESHOLD"}', (key * 100).cast("string")))
    version = (key + (key * 13) % 5 + 1).cast("string")
    rules = F.format_string(
        '[{"definition":%s,"evaluationOrder":0,"ruleId":"rule-%s","ruleVersion":1,"severity":"HIGH"}]',
        node, key.cast("string"))
    head = F.concat(F.lit('"approvedChangeRuleVersionId":"ver-'), key.cast("string"), F.lit('"'))
    tail = F.format_string(
        '"createdAt":"2024-01-01T00:00:00Z","rules":%s,"schemaVersion":1,"snapshotId":"snap-%s","version":%s}',
        F.when(key % 19 == 3, "[]").otherwise(rules), key.cast("string"), version)
    digest = F.when(key % 9 == 4, F.lit("0")).otherwise(
        F.sha2(F.concat(F.lit("{"), head, F.lit(","), tail).cast("binary"), 256))
    return table(spark, sf_dir, "supplier").select(
        F.when(key % 23 == 9, "OTHER").otherwise("ACTIVE").alias("key"),
        F.concat(F.lit("{"), head, F.lit(',"contentHash":"sha256:'), digest, F.lit('",'), tail).alias("payload"),
        (key * 1000 + 5).alias("arrival_seq"), "s_suppkey",
    )


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive events are the delivery log of one request."""
    eid = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "signup"), "CLAIM").when(
        F.col("event_type") == "click", "SENT").otherwise("FAILED")
    return spread(spark, sf_dir, "events", "event_id").select(
        F.concat(F.lit("req-"), F.expr("event_id div 8").cast("string")).alias("notificationRequestId"),
        eid.alias("at"), kind.alias("kind"),
        F.when(kind != "CLAIM", F.expr("cast((event_id % 8) div 3 + 1 as int)")).alias("attempt"),
    )


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log with request records on its claims, and what was delivered how on its outcomes."""
    eid, us = F.col("event_id"), F.expr("unix_micros(cast(ts as timestamp))")
    row = attempt_log(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), "event_id", "user_id", us.alias("at_us")), "at")
    claim, sent = F.col("kind") == "CLAIM", F.col("kind") == "SENT"
    number = eid.cast("string")
    value = F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), "notificationRequestId", F.concat(F.lit("alr-"), number).alias("alertId"),
        F.concat(F.lit("cus-"), F.col("user_id").cast("string")).alias("customerId"), F.concat(F.lit("txn-"), number).alias("transactionId"),
        F.lit("SUSPICIOUS_TRANSACTION").alias("category"), F.lit("template").alias("templateId"), F.lit("en").alias("locale"),
        iso_instant(F.col("at_us")).alias("requestedAt"), F.concat(F.lit("trace-"), number).alias("traceId")))
    return row.select(
        "kind", "at", "at_us", F.when(claim, F.col("notificationRequestId")).alias("key"), F.when(claim, value).alias("value"),
        F.when(~claim, F.col("notificationRequestId")).alias("notificationRequestId"), F.col("attempt").cast("int").alias("attempt"),
        F.lit(None).cast("string").alias("channel"), F.when(sent, F.concat(F.lit("prov-"), number)).alias("providerReference"),
        F.when(~claim & ~sent, F.when(eid % 2 == 1, "CHANNEL_DELIVERY_FAILED").otherwise("CONTACT_RESOLUTION_FAILED")).alias("reasonCode"))
