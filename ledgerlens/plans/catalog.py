"""Registered queries: each operator over the given tables, with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import ids
from ledgerlens.operators import assessment, governance, history, identity, metrics, notifications, rulesets
from ledgerlens.operators.ordering import running_max, with_arrival
from ledgerlens.operators.rule_checks import definition_reason
from ledgerlens.operators.rules import compile_ruleset
from ledgerlens.plans import fixtures, oracle, risk
from ledgerlens.session import configure, ensure_checkpoint_dir, materialize
from ledgerlens.sources import ingest, records, stored, tables
from ledgerlens.sources.contracts import violations
from ledgerlens.streaming import delivery, online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SHARED: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shared(name: str, build: Callable[[], DataFrame], spark: SparkSession, *key: object) -> DataFrame:
    """Checkpoint of a stage that several registered queries start from, once per session."""
    slot = (spark.sparkContext.applicationId, name, *key)
    if slot not in _SHARED:
        _SHARED[slot] = materialize(build())
    return _SHARED[slot]


def forget_shared() -> None:
    """Make the next query compute its stages again (for timing)."""
    _SHARED.clear()


def resolved(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    events = fixtures.transactions(spark, sf_dir, k).withColumn("active", F.lit(True))
    return shared("resolved", lambda: risk.resolve_identity(events), spark, sf_dir, k)


def evaluated(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    ruleset = compile_ruleset(fixtures.ruleset_document())

    def build() -> DataFrame:
        accepted = risk.accepted_events(resolved(spark, sf_dir, k))
        return assessment.evaluate(history.with_history(accepted, ruleset.windows()), {1: ruleset})

    return shared("evaluated", build, spark, sf_dir, k)


def assessed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return assessment.assessments(evaluated(spark, sf_dir, k))


def sorted_map(values: Column) -> Column:
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


# ---------------------------------------------------------------- identifiers, ingest


@query("ids_uuid3", f"""
WITH i AS (SELECT event_id, 'evt-' || event_id AS eid FROM events),
a AS (SELECT *, {oracle.uuid3('ASSESSMENT', 'eid')} AS assessment_id FROM i),
b AS (SELECT *, {oracle.uuid3('ALERT', 'assessment_id')} AS alert_id FROM a)
SELECT event_id, assessment_id, alert_id, {oracle.uuid3('NOTIFICATION-REQUEST', 'alert_id')} AS request_id,
  CAST(NULL AS VARCHAR) AS blank_id FROM b""")
def _(spark, sf):
    chain = fixtures.table(spark, sf, "events").select(
        "event_id", ids.assessment_id(F.concat(F.lit("evt-"), "event_id")).alias("assessment_id"))
    chain = chain.withColumn("alert_id", ids.alert_id(F.col("assessment_id")))
    return chain.select("event_id", "assessment_id", "alert_id",
                        ids.notification_request_id(F.col("alert_id")).alias("request_id"),
                        ids.alert_id(F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int"))).alias("blank_id"))


_CANONICAL_EVENT = """'{"schemaVersion":1,"eventId":"evt-' || event_id || '","transactionId":"txn-' || event_id ||
  '","customerId":"cus-' || user_id || '","amountMinor":' || CAST(round(value * 100) AS BIGINT) ||
  ',"currency":"BRL","occurredAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0
       THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0')
       ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END ||
  'Z","transactionType":"PURCHASE","channel":"APP","merchantCountry":"BR","deviceIdHash":"device","traceId":"t"}'"""


@query("event_fingerprint",
       f"SELECT event_id, 'sha256:' || sha256({_CANONICAL_EVENT}) AS fingerprint FROM events")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events").select(
        "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"),
        F.lit(1).alias("schemaVersion"), F.concat(F.lit("evt-"), "event_id").alias("eventId"),
        F.concat(F.lit("txn-"), "event_id").alias("transactionId"), F.concat(F.lit("cus-"), "user_id").alias("customerId"),
        F.round(F.col("value") * 100).cast("long").alias("amountMinor"), F.lit("BRL").alias("currency"),
        F.lit("PURCHASE").alias("transactionType"), F.lit("APP").alias("channel"), F.lit("BR").alias("merchantCountry"),
        F.lit("device").alias("deviceIdHash"), F.lit("t").alias("traceId"))
    return rows.select("event_id", ids.event_fingerprint(F.col("us")).alias("fingerprint"))


def parsed(spark, sf):
    """The landed table of parsed records, which is what later stages read."""
    return shared("parsed", lambda: ingest.parse_events(fixtures.records(spark, sf)), spark, sf)


@query("ingest_valid_split", """
SELECT event_id AS arrival_seq, event_id % 13 IN (0, 8) AS valid, event_id % 13 IN (0, 8, 9, 10) AS schema_valid,
  CASE event_id % 13 WHEN 1 THEN 'schemaVersion:const' WHEN 3 THEN 'amountMinor:minimum' WHEN 4 THEN 'amountMinor:type'
    WHEN 5 THEN 'currency:pattern' WHEN 7 THEN 'additionalProperties' WHEN 11 THEN 'document' WHEN 12 THEN 'document'
    ELSE '' END AS reasons,
  CASE WHEN event_id % 13 IN (0, 8, 9, 10) THEN epoch_ms(date_trunc('second', ts)) END AS occurred_ms,
  CASE WHEN event_id % 13 NOT IN (4, 11, 12) THEN CASE WHEN event_id % 13 = 3 THEN -1 ELSE CAST(round(value * 100) AS BIGINT) END END AS amount
FROM events""")
def _(spark, sf):
    return parsed(spark, sf).select(
        "arrival_seq", "valid", "schema_valid", F.array_join("violations", ",").alias("reasons"),
        F.when(F.col("schema_valid"), F.col("occurred_ms")).alias("occurred_ms"),
        F.when(~F.col("violations").cast("string").contains("amountMinor:type"), F.col("amountMinor")).alias("amount"))


_RAW_VALUE = """CASE WHEN event_id % 13 = 11 THEN 'not json' WHEN event_id % 13 = 12 THEN '' ELSE
  '{"schemaVersion":' || CASE WHEN event_id % 13 = 1 THEN '2' ELSE '1' END || ',"eventId":"' ||
  CASE WHEN event_id % 13 = 2 THEN ' ' ELSE 'evt-' || event_id END || '","transactionId":"txn-' || event_id ||
  '","customerId":"cus-' || user_id || '","amountMinor":' || CASE event_id % 13 WHEN 3 THEN '-1' WHEN 4 THEN '"12"'
    ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END ||
  ',"currency":"' || CASE WHEN event_id % 13 = 5 THEN 'REAL' ELSE 'BRL' END || '","occurredAt":"' ||
  CASE WHEN event_id % 13 = 6 THEN '2024-01-01' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END ||
  '","transactionType":"PURCHASE","channel":"APP","merchantCountry":"BR","deviceIdHash":"device","traceId":"trace-' ||
  event_id || '"' || CASE event_id % 13 WHEN 7 THEN ',"note":"x"' WHEN 8 THEN ',"merchantCategory":"5411"' ELSE '' END || '}' END"""


@query("ingest_invalid_references", f"""
SELECT CASE WHEN event_id % 13 = 9 THEN 'other' WHEN event_id % 13 = 10 THEN NULL ELSE 'txn-' || event_id END AS key,
  CAST(1 AS INTEGER) AS "schemaVersion", 'fraud.transaction.received.v1' AS "sourceTopic", CAST(event_id % 12 AS INTEGER) AS "sourcePartition",
  event_id // 12 AS "sourceOffset", sha256({_RAW_VALUE}) AS "payloadHash",
  CAST(CASE WHEN event_id % 13 IN (9, 10) THEN 1 END AS INTEGER) AS "sourceSchemaVersion",
  'INVALID_TRANSACTION_EVENT' AS "reasonCode", epoch_us(ts) AS detected_us
FROM events WHERE event_id % 13 NOT IN (0, 8)""")
def _(spark, sf):
    return ingest.invalid_references(parsed(spark, sf))


@query("record_round_trip", """
SELECT 'txn-' || event_id AS key, 'evt-' || event_id AS event_id, user_id, value FROM events""")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events").select(
        F.concat(F.lit("txn-"), "event_id").alias("key"), F.concat(F.lit("evt-"), "event_id").alias("event_id"),
        "user_id", "value")
    sent = tables.as_records(rows, "key")
    return sent.select("key", F.from_json("value", "event_id string, user_id long, value double").alias("r")).select("key", "r.*")


@query("scalar_backoff", """
SELECT s_suppkey, CAST(least(60, 2 ** least(s_suppkey % 12, 6)) AS INTEGER) AS delay FROM supplier""")
def _(spark, sf):
    return fixtures.table(spark, sf, "supplier").select(
        "s_suppkey", ids.backoff_seconds((F.col("s_suppkey") % 12).cast("int")).alias("delay"))


@query("scalar_message_id", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '@mail' WHEN 1 THEN c_name WHEN 2 THEN '<>' END AS message_id
FROM customer""")
def _(spark, sf):
    kind = F.col("c_custkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit("  <"), "c_name", F.lit("@mail> "))).when(
        kind == 1, F.concat(F.col("c_name"), F.lit(" "))).when(kind == 2, "<>").otherwise("  ")
    return fixtures.table(spark, sf, "customer").select("c_custkey", ids.message_id(raw).alias("message_id"))


@query("scalar_instants", """
SELECT o_orderkey, epoch_us(o_orderdate) + o_orderkey * 1001 AS parsed_us,
  CAST(NULL AS BIGINT) AS date_only FROM orders""")
def _(spark, sf):
    us = F.expr("unix_micros(cast(o_orderdate as timestamp))") + F.col("o_orderkey") * 1001
    return fixtures.table(spark, sf, "orders").select(
        "o_orderkey", ingest.instant_micros(ids.iso_instant(us)).alias("parsed_us"),
        ingest.instant_micros(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_only"))


# ---------------------------------------------------------------- identity and stream time


@query("stream_time_late", oracle.with_(oracle.tx(1), """
SELECT seq AS arrival_seq, max(ms) OVER w AS stream_time, ms < max(ms) OVER w AS late
FROM tx WINDOW w AS (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING)"""))
def _(spark, sf):
    rows = fixtures.transactions(spark, sf, 1).select("partition", "arrival_seq", "occurred_ms")
    timed = running_max(rows, ["partition"], "arrival_seq", "occurred_ms", "stream_time")
    return timed.select("arrival_seq", "stream_time", history.late(stream_time="stream_time").alias("late"))


@query("stream_time_invalid", """
SELECT event_id AS arrival_seq, max(ms) OVER (PARTITION BY event_id % 12 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stream_time
FROM (SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms FROM events WHERE event_id % 13 IN (0, 8, 9, 10))""")
def _(spark, sf):
    """Stream time of well-formed records; the damaged ones between them never move it."""
    rows = parsed(spark, sf).filter("schema_valid").select("partition", "arrival_seq", "occurred_ms")
    return running_max(rows, ["partition"], "arrival_seq", "occurred_ms", "stream_time").select("arrival_seq", "stream_time")


@query("risk_skipped", """
SELECT CASE WHEN event_id % 13 NOT IN (0, 8) THEN 'invalid' WHEN event_id * 4 < n THEN 'no_ruleset' ELSE 'accepted' END AS outcome, count(*) AS n
FROM events, (SELECT count(*) AS n FROM events) GROUP BY 1""")
def _(spark, sf):
    """What became of raw records when the first rule set was loaded after a quarter of them."""
    events = parsed(spark, sf)
    n = events.count()
    versioned = events.withColumn("ruleset_version", F.when(F.col("arrival_seq") * 4 >= n, F.lit(1).cast("long")))
    out = risk.run_batch(versioned, {1: compile_ruleset(fixtures.ruleset_document())})
    return metrics.count_by(out.dispositions, "outcome")


def _dispositions(k: int) -> str:
    return oracle.with_(oracle.identity(k), "SELECT seq AS arrival_seq, outcome FROM outc")


@query("identity_24h", _dispositions(1))
def _(spark, sf):
    return resolved(spark, sf, 1).select("arrival_seq", "outcome")


@query("identity_dense", _dispositions(60))
def _(spark, sf):
    return resolved(spark, sf, 60).select("arrival_seq", "outcome")


@query("identity_24h_hopped", _dispositions(1))
def _(spark, sf):
    events = fixtures.transactions(spark, sf, 1).withColumn("active", F.lit(True))
    return risk.resolve_identity(events, fold_limit=0).select("arrival_seq", "outcome")


@query("identity_dense_hopped", _dispositions(60))
def _(spark, sf):
    events = fixtures.transactions(spark, sf, 60).withColumn("active", F.lit(True))
    return risk.resolve_identity(events, fold_limit=0).select("arrival_seq", "outcome")


@query("identity_outcomes", oracle.with_(oracle.identity(1), """
SELECT outcome, count(*) AS n FROM outc GROUP BY outcome"""))
def _(spark, sf):
    return metrics.count_by(resolved(spark, sf, 1), "outcome")


def _quarantine(outcome: str, hashes: str) -> str:
    return oracle.with_(oracle.identity(1), f"""
SELECT txn AS key, CAST(1 AS INTEGER) AS "schemaVersion", 'fraud.transaction.received.v1' AS "sourceTopic", CAST(part AS INTEGER) AS "sourcePartition",
  seq AS "sourceOffset", eid AS "eventId", txn AS "transactionId", {hashes}, outcome AS "reasonCode", seq * 1000 AS detected_us
FROM tx JOIN outc USING (seq) {'JOIN f1 USING (seq)' if outcome[0] == 'T' else ''} WHERE outcome = '{outcome}'""".replace(
        "txn AS key", "tx.txn AS key").replace(", txn AS", ", tx.txn AS").replace("CAST(part", "CAST(tx.part"))


@query("quarantine_transaction_conflicts", _quarantine("TRANSACTION_IDENTITY_CONFLICT", """
  'sha256:' || sha256(eid || '|' || tx.txn || '|' || amt) AS "payloadHash", 'sha256:' || sha256(first_eid) AS "conflictingIdentityHash" """))
def _(spark, sf):
    rows = resolved(spark, sf, 1).filter(F.col("outcome") == identity.TRANSACTION_CONFLICT)
    return identity.quarantine_references(rows, ingest.TRANSACTION_TOPIC)


def _fingerprint_sql(amount: str) -> str:
    return f"""'sha256:' || sha256('{{"schemaVersion":1,"eventId":"' || eid || '","transactionId":"' || txn || '","customerId":"' || cus ||
  '","amountMinor":' || {amount} || ',"currency":"' || cur || '","occurredAt":"' || strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') END ||
  'Z","transactionType":"PURCHASE","channel":"APP","merchantCountry":"BR","deviceIdHash":"device","traceId":"trace-' || event_id || '"}}')"""


@query("quarantine_event_conflicts", oracle.with_(oracle.identity(1), f"""
SELECT tx.txn AS key, CAST(1 AS INTEGER) AS "schemaVersion", 'fraud.transaction.received.v1' AS "sourceTopic",
  CAST(part AS INTEGER) AS "sourcePartition", seq AS "sourceOffset", eid AS "eventId", txn AS "transactionId",
  {_fingerprint_sql('amt')} AS "payloadHash", {_fingerprint_sql('first_amt')} AS "conflictingIdentityHash",
  outcome AS "reasonCode", seq * 1000 AS detected_us
FROM tx JOIN (SELECT seq, first_amt, outcome FROM f2) USING (seq) WHERE outcome = 'EVENT_IDENTITY_CONFLICT'"""))
def _(spark, sf):
    rows = resolved(spark, sf, 1).filter(F.col("outcome") == identity.EVENT_CONFLICT)
    return identity.quarantine_references(rows, ingest.TRANSACTION_TOPIC)


@query("stream_split", oracle.with_(oracle.identity(60), """
SELECT seq AS arrival_seq, CASE outcome WHEN 'accepted' THEN 'assess' WHEN 'duplicate' THEN 'drop' ELSE 'quarantine' END AS branch FROM outc"""))
def _(spark, sf):
    rows = resolved(spark, sf, 60)
    branches = {
        "assess": F.col("outcome") == "accepted",
        "drop": F.col("outcome") == "duplicate",
        "quarantine": ~F.col("outcome").isin("accepted", "duplicate"),
    }
    parts = [rows.filter(test).select("arrival_seq", F.lit(name).alias("branch")) for name, test in branches.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- history, rules, assessment


def _history_sql(k: int) -> str:
    return oracle.with_(oracle.history(k), """
SELECT seq AS arrival_seq, avail AS history_available, late, CASE WHEN avail THEN o60 END AS observed_60,
  CASE WHEN avail THEN o300 END AS observed_300, CASE WHEN avail THEN o600 END AS observed_600 FROM acc""")


def _history(spark, sf, k):
    return evaluated(spark, sf, k).select(
        "arrival_seq", "history_available", "late", "observed_60", "observed_300", "observed_600")


@query("history_counts", _history_sql(60))
def _(spark, sf):
    return _history(spark, sf, 60)


@query("history_availability", _history_sql(1))
def _(spark, sf):
    return _history(spark, sf, 1)


def _status(expr: str) -> str:
    return f"CASE WHEN {expr} THEN 'MATCHED' WHEN NOT ({expr}) THEN 'NO_MATCH' ELSE 'NOT_EVALUATED' END"


def _rule_result(spark, sf, k, rule_id):
    r = F.get(F.filter("ruleResults", lambda x: x["ruleId"] == rule_id), F.lit(0))
    return evaluated(spark, sf, k).withColumn("r", r).select(
        "arrival_seq", F.col("r.ruleVersion").alias("rule_version"), F.col("r.severity").alias("severity"),
        F.col("r.status").alias("status"), F.array_join("r.evidenceCodes", ",").alias("evidence"),
        sorted_map(F.col("r.evaluatedValues")).alias("values"))


@query("rule_amount", oracle.with_(oracle.results(60), f"""
SELECT seq AS arrival_seq, CAST(1 AS INTEGER) AS rule_version, 'HIGH' AS severity, {_status('r_amount')} AS status,
  CASE WHEN cur <> 'BRL' THEN 'CURRENCY_MISMATCH' WHEN amt >= 30000 THEN 'AMOUNT_AT_OR_ABOVE_THRESHOLD' ELSE 'AMOUNT_BELOW_THRESHOLD' END AS evidence,
  'amountMinor=' || amt || CASE WHEN cur <> 'BRL' THEN ',eventCurrency=' || cur || ',ruleCurrency=BRL' ELSE ',currency=BRL' END || ',thresholdMinor=30000' AS "values"
FROM ev"""))
def _(spark, sf):
    return _rule_result(spark, sf, 60, "amount")


@query("rule_count_window", oracle.with_(oracle.results(1), f"""
SELECT seq AS arrival_seq, CAST(1 AS INTEGER) AS rule_version, 'CRITICAL' AS severity, {_status('r_burst')} AS status,
  CASE WHEN NOT avail THEN 'HISTORY_UNAVAILABLE' WHEN o600 >= 3 THEN 'COUNT_AT_OR_ABOVE_MINIMUM' ELSE 'COUNT_BELOW_MINIMUM' END AS evidence,
  'minimumCount=3' || CASE WHEN avail THEN ',observedCount=' || o600 ELSE '' END || ',windowSeconds=600' AS "values" FROM ev"""))
def _(spark, sf):
    return _rule_result(spark, sf, 1, "burst")


def _composite_sql(k: int, name: str, kind: str, severity: str, settled: str) -> str:
    code = f"CASE WHEN r_{name} THEN '{kind}_MATCHED' WHEN NOT r_{name} THEN '{kind}_NO_MATCH' ELSE '{kind}_NOT_EVALUATED' END"
    return oracle.with_(oracle.results(k), f"""
SELECT seq AS arrival_seq, CAST(1 AS INTEGER) AS rule_version, '{severity}' AS severity, {_status('r_' + name)} AS status, {code} AS evidence,
  'evaluatedChildren=' || CASE WHEN {settled} THEN 1 ELSE 2 END || ',totalChildren=2' AS "values" FROM ev""")


@query("rule_all", _composite_sql(1, "both", "ALL", "MEDIUM", "NOT both_1"))
def _(spark, sf):
    return _rule_result(spark, sf, 1, "both")


@query("rule_any", _composite_sql(1, "either", "ANY", "LOW", "either_1"))
def _(spark, sf):
    return _rule_result(spark, sf, 1, "either")


def _assess_sql(k: int) -> str:
    return oracle.with_(oracle.results(k), """
SELECT seq AS arrival_seq, assessment_id, eid AS event_id, txn AS transaction_id, cus AS customer_id, status, severity,
  CAST(1 AS BIGINT) AS ruleset_version, late, 'trace-' || event_id AS trace_id, CAST(4 AS INTEGER) AS rules FROM assessed""")


def _assess_columns(df):
    return df.select(
        "arrival_seq", F.col("assessmentId").alias("assessment_id"), F.col("eventId").alias("event_id"),
        F.col("transactionId").alias("transaction_id"), F.col("customerId").alias("customer_id"), "status",
        F.col("finalSeverity").alias("severity"), F.col("rulesetVersion").alias("ruleset_version"), "late",
        F.col("traceId").alias("trace_id"), F.size("ruleResults").alias("rules"))


@query("assessments_24h", _assess_sql(1))
def _(spark, sf):
    return _assess_columns(assessed(spark, sf, 1))


@query("assessments_dense", _assess_sql(60))
def _(spark, sf):
    return _assess_columns(assessed(spark, sf, 60))


@query("risk_batch_outputs", oracle.with_(oracle.results(60), """
SELECT 'assessment' AS output, status AS label, count(*) AS n FROM assessed GROUP BY status
UNION ALL SELECT 'alert', severity, count(*) FROM assessed WHERE status = 'SUSPICIOUS' GROUP BY severity
UNION ALL SELECT 'request', 'pt-BR', count(*) FROM assessed WHERE status = 'SUSPICIOUS'
UNION ALL SELECT 'quarantine', outcome, count(*) FROM outc WHERE outcome LIKE '%CONFLICT' GROUP BY outcome"""))
def _(spark, sf):
    out = risk.run_batch(fixtures.transactions(spark, sf, 60), {1: compile_ruleset(fixtures.ruleset_document())})
    assessments = materialize(out.assessments)
    alerted = assessment.alerts(assessments)
    parts = [
        (assessments, "assessment", "status"), (alerted, "alert", "severity"),
        (assessment.notification_requests(alerted), "request", "locale"), (out.quarantined, "quarantine", "reasonCode"),
    ]
    counted = [df.groupBy(F.lit(o).alias("output"), F.col(c).alias("label")).agg(F.count("*").alias("n")) for df, o, c in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


_RULE_ROWS = """[CASE WHEN r_amount THEN 'amount:1:AMOUNT_AT_OR_ABOVE_THRESHOLD' END, CASE WHEN r_burst THEN 'burst:1:COUNT_AT_OR_ABOVE_MINIMUM' END,
  CASE WHEN r_both THEN 'both:1:ALL_MATCHED' END, CASE WHEN r_either THEN 'either:1:ANY_MATCHED' END]"""


@query("alerts", oracle.with_(oracle.results(60), f"""
SELECT {oracle.uuid3('ALERT', 'assessment_id')} AS alert_id, assessment_id, eid AS event_id, severity,
  array_to_string(list_filter({_RULE_ROWS}, lambda x: x IS NOT NULL), ',') AS matched, seq * 1000 AS created_at
FROM assessed WHERE status = 'SUSPICIOUS'"""))
def _(spark, sf):
    rules = F.transform("matchedRules", lambda r: F.concat_ws(":", r["ruleId"], r["ruleVersion"].cast("string"), r["evidenceCodes"]))
    return assessment.alerts(assessed(spark, sf, 60)).select(
        F.col("alertId").alias("alert_id"), F.col("assessmentId").alias("assessment_id"), F.col("eventId").alias("event_id"),
        "severity", F.array_join(rules, ",").alias("matched"), F.col("createdAt").alias("created_at"))


_REQUESTS = f"""rq AS (SELECT {oracle.uuid3('NOTIFICATION-REQUEST', oracle.uuid3('ALERT', 'assessment_id'))} AS request_id,
  {oracle.uuid3('ALERT', 'assessment_id')} AS alert_id, cus, txn, seq, event_id, severity FROM assessed WHERE status = 'SUSPICIOUS')"""


def requests(spark, sf):
    return assessment.notification_requests(assessment.alerts(assessed(spark, sf, 60)))


@query("notification_requests", oracle.with_(oracle.results(60) + "," + _REQUESTS, """
SELECT request_id, alert_id, cus AS customer_id, txn AS transaction_id, 'SUSPICIOUS_TRANSACTION' AS category,
  'suspicious-transaction-v1' AS template_id, 'pt-BR' AS locale, seq * 1000 AS requested_at FROM rq"""))
def _(spark, sf):
    return requests(spark, sf).select(
        F.col("notificationRequestId").alias("request_id"), F.col("alertId").alias("alert_id"), F.col("customerId").alias("customer_id"),
        F.col("transactionId").alias("transaction_id"), "category", F.col("templateId").alias("template_id"), "locale",
        F.col("requestedAt").alias("requested_at"))


# ---------------------------------------------------------------- rule sets


_DEFINITIONS = {
    0: ('{"type":"AMOUNT_THRESHOLD","amountMinor":%s,"currency":"BRL"}', None),
    1: ('{"type":"AMOUNT_THRESHOLD","amountMinor":-%s,"currency":"BRL"}', "INVALID_AMOUNT_THRESHOLD"),
    2: ('{"type":"COUNT_WINDOW","windowSeconds":601,"minimumCount":%s}', "WINDOW_EXCEEDS_LIMIT"),
    3: ('{"type":"COUNT_WINDOW","windowSeconds":0,"minimumCount":%s}', "INVALID_WINDOW"),
    4: ('{"type":"SUM_WINDOW","n":%s}', "UNSUPPORTED_RULE_NODE"),
    5: ('{"type":"ALL","children":[],"n":%s}', "INVALID_COMPOSITE_RULE"),
    6: ('{"type":"ANY","n":%s}', "INVALID_COMPOSITE_RULE"),
    7: ('{"type":"ANY","children":[{"type":"COUNT_WINDOW","windowSeconds":60,"minimumCount":%s}]}', None),
    8: ('{"type":"ALL","children":[{"type":"X","n":%s},{"children":[]}]}', "UNSUPPORTED_RULE_NODE"),
    9: ('[%s]', "INVALID_RULE_DEFINITION"),
    10: ('{"type":"ALL","children":[{"type":"ALL","children":[{"type":"ALL","children":[{"type":"ALL","children":'
         '[{"type":"ALL","children":[{"type":"AMOUNT_THRESHOLD","amountMinor":%s,"currency":"BRL"}]}]}]}]}]}',
         "RULE_DEPTH_EXCEEDS_LIMIT"),
    11: ('{"type":"ANY","children":[' + ",".join(['{"type":"COUNT_WINDOW","windowSeconds":1,"minimumCount":1}'] * 21)
         + '],"n":%s}', "COMPOSITE_WIDTH_EXCEEDS_LIMIT"),
    12: ('{"type":"COUNT_WINDOW","windowSeconds":600,"minimumCount":0,"n":%s}', "INVALID_COUNT_WINDOW"),
    13: ('{"script":"%s"}', "INVALID_RULE_DEFINITION"),
}


@query("rule_definition_checks", "SELECT p_partkey, CASE p_partkey % 14 " + " ".join(
    f"WHEN {i} THEN '{reason}'" for i, (_, reason) in _DEFINITIONS.items() if reason) + " END AS reason FROM part")
def _(spark, sf):
    kind = F.col("p_partkey") % 14
    text = F.lit(None).cast("string")
    for i, (form, _reason) in _DEFINITIONS.items():
        text = F.when(kind == i, F.format_string(form, (F.col("p_size") + 1).cast("string"))).otherwise(text)
    return fixtures.table(spark, sf, "part").select("p_partkey", definition_reason(F.try_parse_json(text)).alias("reason"))


def accepted_snapshots(spark, sf):
    return shared("snapshots", lambda: rulesets.accept_snapshots(
        rulesets.validate_snapshots(fixtures.snapshots(spark, sf))), spark, sf)


@query("ruleset_acceptance", oracle.with_(oracle.SNAPSHOTS, """
SELECT k AS s_suppkey, key, seq AS arrival_seq, version, reject_reason, disposition FROM n"""))
def _(spark, sf):
    return accepted_snapshots(spark, sf).select(
        "s_suppkey", "key", "arrival_seq", "version", "reject_reason", "disposition")


@query("ruleset_asof", oracle.with_(oracle.tx(60) + "," + oracle.SNAPSHOTS, """
SELECT tx.seq AS arrival_seq, n.version AS ruleset_version
FROM tx ASOF LEFT JOIN (SELECT seq, version FROM n WHERE disposition = 'accepted') n ON tx.seq > n.seq"""))
def _(spark, sf):
    events = fixtures.transactions(spark, sf, 60).select("arrival_seq")
    accepted = accepted_snapshots(spark, sf).filter("disposition = 'accepted'")
    return rulesets.with_active_version(events, accepted)


@query("ruleset_canonical_hash", """
SELECT p_partkey, 'sha256:' || sha256('{"a":{"b":[3,1,2],"z":"' || p_name || '"},"n":' || p_size || ',"type":"' || p_type || '"}') AS digest FROM part""")
def _(spark, sf):
    text = F.format_string('{"type": "%s", "n": %s, "a": {"z": "%s", "b": [3, 1, 2]}}', "p_type", "p_size", "p_name")
    return fixtures.table(spark, sf, "part").select("p_partkey", ids.content_hash(ids.canonical_json(text)).alias("digest"))


@query("ruleset_verification", oracle.with_(oracle.SNAPSHOTS, """
SELECT k AS s_suppkey, CASE WHEN k % 19 = 3 THEN 'OUTBOX_SNAPSHOT_SCHEMA_INVALID' WHEN k % 7 = 2 THEN 'OUTBOX_SNAPSHOT_VERSION_INVALID'
  WHEN k % 5 = 1 THEN 'OUTBOX_SNAPSHOT_NOT_CANONICAL' WHEN k % 9 = 4 THEN 'OUTBOX_SNAPSHOT_HASH_INVALID' ELSE 'OK' END AS verification FROM n"""))
def _(spark, sf):
    k = F.col("s_suppkey")
    outbox = fixtures.snapshots(spark, sf).select(
        "s_suppkey", F.when(k % 5 == 1, F.concat(F.lit(" "), "payload")).otherwise(F.col("payload")).alias("canonical_payload"),
        (k + (k * 13) % 5 + 1 + F.when(k % 7 == 2, 1).otherwise(0)).alias("aggregate_version"))
    return rulesets.verify_publication(outbox).select("s_suppkey", "verification")


@query("ruleset_versions_assessed", oracle.with_(oracle.tx(60) + """,
rv AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS version, n_nationkey * (SELECT count(*) FROM events) * 10 // 25 AS seq,
    n_nationkey * 2000 AS threshold FROM nation)""", """
SELECT tx.seq AS arrival_seq, rv.version AS ruleset_version,
  CASE WHEN cur = 'BRL' AND amt >= threshold THEN 'SUSPICIOUS' ELSE 'NOT_SUSPICIOUS' END AS status
FROM tx ASOF JOIN rv ON tx.seq > rv.seq"""))
def _(spark, sf):
    n = fixtures.table(spark, sf, "events").count()
    key = F.col("n_nationkey")
    published = fixtures.table(spark, sf, "nation").select(
        F.expr(f"n_nationkey * {n * 10}L div 25").alias("arrival_seq"), (key + 1).cast("long").alias("version"),
        F.format_string('{"version":%s,"rules":[{"ruleId":"r","ruleVersion":1,"evaluationOrder":0,"severity":"HIGH","definition":'
                        '{"type":"AMOUNT_THRESHOLD","amountMinor":%s,"currency":"BRL"}}]}',
                        (key + 1).cast("string"), (key * 2000).cast("string")).alias("payload"))
    events = fixtures.transactions(spark, sf, 60).drop("ruleset_version")
    versioned = rulesets.with_active_version(events, published).filter(F.col("ruleset_version").isNotNull())
    done = assessment.evaluate(versioned, rulesets.load_rulesets(published))
    return done.select("arrival_seq", "ruleset_version", assessment.overall_status(F.col("ruleResults")).alias("status"))


# Twelve versions with gaps between their numbers; one event in thirteen met none.
@query("ruleset_gapped_versions", oracle.with_(oracle.tx(60), """
SELECT seq AS arrival_seq, CASE WHEN seq // 10 % 13 < 12 THEN seq // 10 % 13 * 7 + 3 END AS ruleset_version,
  CASE WHEN seq // 10 % 13 = 12 THEN 'NOT_EVALUATED' WHEN cur = 'BRL' AND amt >= (seq // 10 % 13) * 4000 THEN 'SUSPICIOUS'
       ELSE 'NOT_SUSPICIOUS' END AS status FROM tx"""))
def _(spark, sf):
    slot = F.expr("(arrival_seq div 10) % 13")
    events = fixtures.transactions(spark, sf, 60).withColumn("ruleset_version", F.when(slot < 12, slot * 7 + 3))
    sets = {i * 7 + 3: compile_ruleset({"version": i * 7 + 3, "rules": [
        {"ruleId": "r", "ruleVersion": i + 1, "evaluationOrder": 0, "severity": "HIGH",
         "definition": {"type": "AMOUNT_THRESHOLD", "amountMinor": i * 4000, "currency": "BRL"}}]}) for i in range(12)}
    done = assessment.evaluate(events.filter(F.col("ruleset_version").isNotNull()), sets)
    met = done.select("arrival_seq", "ruleset_version", assessment.overall_status(F.col("ruleResults")).alias("status"))
    return met.unionByName(events.filter(F.col("ruleset_version").isNull()).select(
        "arrival_seq", "ruleset_version", F.lit("NOT_EVALUATED").alias("status")))


# ---------------------------------------------------------------- governance


def versions(spark, sf):
    return shared("versions", lambda: governance.propose(fixtures.proposals(spark, sf)), spark, sf)


def decided(spark, sf):
    return shared("decided", lambda: governance.decide(versions(spark, sf), fixtures.decisions(spark, sf)), spark, sf)


@query("governance_proposals", oracle.with_(oracle.GOVERNANCE, """
SELECT p.vid AS rule_version_id, p.rule_id, p.ct AS change_type, p.reject_reason, CAST(v.num AS INTEGER) AS version_number,
  p.ct = 'UPSERT' AS has_definition FROM p LEFT JOIN v USING (vid)"""))
def _(spark, sf):
    return versions(spark, sf).select("rule_version_id", "rule_id", "change_type", "reject_reason", "version_number",
                                      F.col("definition").isNotNull().alias("has_definition"))


@query("governance_next_version", oracle.with_(oracle.GOVERNANCE, """
SELECT rule_id, CAST(coalesce(max(num), 0) + 1 AS INTEGER) AS next_version FROM p0 LEFT JOIN v USING (vid, rule_id) GROUP BY rule_id"""))
def _(spark, sf):
    return governance.next_version_number(versions(spark, sf))


def _decisions_sql(max_rules: int) -> str:
    return oracle.with_(oracle.decided(max_rules), """
SELECT dseq AS decision_seq, vid AS rule_version_id, outcome, reason, ver AS ruleset_version,
  CASE WHEN ver IS NOT NULL THEN array_to_string(list_transform(active, lambda x: x.v), ',') END AS items FROM g
UNION ALL SELECT dseq, vid, 'REFUSED', 'RULE_VERSION_UNKNOWN', NULL, NULL FROM d0 WHERE vid NOT IN (SELECT vid FROM v)""")


def _decisions(df):
    return df.select("decision_seq", "rule_version_id", "outcome", "reason", "ruleset_version",
                     F.array_join("items", ",").alias("items"))


@query("governance_decisions", _decisions_sql(100))
def _(spark, sf):
    return _decisions(decided(spark, sf))


@query("governance_size_limit", _decisions_sql(2))
def _(spark, sf):
    return _decisions(governance.decide(versions(spark, sf), fixtures.decisions(spark, sf), max_rules=2))


@query("governance_decisions_in_blocks", _decisions_sql(100))
def _(spark, sf):
    """Every head's log in some thirty blocks that are folded side by side."""
    decisions = fixtures.decisions(spark, sf)
    last = decisions.agg(F.max("decision_seq")).first()[0] or 0
    return _decisions(governance.decide(versions(spark, sf), decisions, block=last // 30 + 1))


@query("governance_size_limit_in_blocks", _decisions_sql(2))
def _(spark, sf):
    """The same where most approvals are refused, so that blocks depend on where they start."""
    decisions = fixtures.decisions(spark, sf)
    last = decisions.agg(F.max("decision_seq")).first()[0] or 0
    return _decisions(governance.decide(versions(spark, sf), decisions, max_rules=2, block=last // 12 + 1))


@query("governance_active_set", oracle.with_(oracle.decided(), """
, z AS (SELECT head, max(ver) AS ver, max_by(active, ver) AS active FROM g WHERE ver IS NOT NULL GROUP BY head)
SELECT head AS head_key, ver AS ruleset_version, CAST(i - 1 AS INTEGER) AS evaluation_order, active[i].v AS rule_version_id
FROM (SELECT *, unnest(range(1, len(active) + 1)) AS i FROM z)""".lstrip()))
def _(spark, sf):
    return governance.active_set(decided(spark, sf))


_ITEMS = """it AS MATERIALIZED (SELECT head, ver, vid AS change, dseq, CAST(i - 1 AS INTEGER) AS ord, active[i].v AS vid
  FROM (SELECT *, unnest(range(1, len(active) + 1)) AS i FROM g WHERE ver IS NOT NULL))"""


@query("governance_snapshot_items", oracle.with_(oracle.decided() + "," + _ITEMS, """
SELECT it.head AS head_key, it.ver AS ruleset_version, it.ord AS evaluation_order, it.vid AS rule_version_id,
  v.rule_id, CAST(v.num AS INTEGER) AS version_number FROM it JOIN v USING (vid)"""))
def _(spark, sf):
    return governance.snapshot_items(decided(spark, sf)).join(
        versions(spark, sf).select("rule_version_id", "rule_id", "version_number"), "rule_version_id").select(
        "head_key", "ruleset_version", "evaluation_order", "rule_version_id", "rule_id", "version_number")


_DOCUMENTS = _ITEMS + f""",
tx_ AS (SELECT it.head, it.ver, it.change, it.dseq, string_agg('{{"definition":{{"amountMinor":' || v.amount ||
    ',"currency":"BRL","type":"AMOUNT_THRESHOLD"}},"evaluationOrder":' || ord || ',"ruleId":"' || v.rule_id || '","ruleVersion":' || v.num ||
    ',"severity":"HIGH"}}', ',' ORDER BY ord) AS rules FROM it JOIN v USING (vid) GROUP BY it.head, it.ver, it.change, it.dseq),
doc AS (SELECT *, '"approvedChangeRuleVersionId":"' || change || '",' AS a,
    '"createdAt":"' || strftime(make_timestamp(dseq * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","rules":[' || rules ||
    '],"schemaVersion":1,"snapshotId":"' || {oracle.uuid3('SNAPSHOT', "(head || ':' || ver)")} || '","version":' || ver || '}}' AS z FROM tx_),
signed AS (SELECT *, 'sha256:' || sha256('{{' || a || z) AS h, '{{' || a || '"contentHash":"sha256:' || sha256('{{' || a || z) || '",' || z AS payload FROM doc)"""


def built_snapshots(spark, sf):
    return shared("built", lambda: governance.build_snapshots(
        decided(spark, sf), versions(spark, sf), F.col("decision_seq") * 1_000_000), spark, sf)


@query("governance_snapshots", oracle.with_(oracle.decided() + "," + _DOCUMENTS, """
SELECT head AS head_key, ver AS ruleset_version, change AS approved_change, h AS content_hash, payload,
  CAST(octet_length(encode(payload)) AS INTEGER) AS payload_bytes FROM signed"""))
def _(spark, sf):
    return built_snapshots(spark, sf).select(
        "head_key", "ruleset_version", "approved_change", "content_hash", "payload", "payload_bytes")


@query("governance_snapshots_verified", oracle.with_(oracle.decided(), """
SELECT 'OK' AS verification, count(*) AS n FROM g WHERE ver IS NOT NULL"""))
def _(spark, sf):
    outbox = built_snapshots(spark, sf).select(
        F.col("payload").alias("canonical_payload"), F.col("ruleset_version").alias("aggregate_version"))
    return metrics.count_by(rulesets.verify_publication(outbox), "verification")


_STATUS = """st AS (SELECT v.*, e.decision, e.approver, CASE e.decision WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'PENDING_APPROVAL' END AS status
  FROM v LEFT JOIN (SELECT vid, decision, approver FROM g WHERE outcome = 'SUCCESS') e USING (vid))"""


def statuses(spark, sf):
    return governance.version_status(versions(spark, sf), decided(spark, sf))


@query("governance_version_status", oracle.with_(oracle.decided() + "," + _STATUS, """
SELECT vid AS rule_version_id, status, approver FROM st"""))
def _(spark, sf):
    return statuses(spark, sf).select("rule_version_id", "status", "approver")


@query("governance_constraints", oracle.with_(oracle.decided() + "," + _STATUS, """
SELECT 'rule_version_one_pending_per_rule' AS violation, rule_id AS entity, count(*) AS n FROM st
WHERE status = 'PENDING_APPROVAL' GROUP BY rule_id HAVING count(*) > 1
UNION ALL SELECT 'rule_version_unique_number', rule_id, count(*) FROM st GROUP BY rule_id, num HAVING count(*) > 1
UNION ALL SELECT 'rule_version_different_approver', vid, 1 FROM st WHERE approver = author"""))
def _(spark, sf):
    return governance.constraint_violations(statuses(spark, sf))


_AUDIT = """au AS (SELECT author AS actor, 'RULE_VERSION_CREATED' AS action, 'SUCCESS' AS outcome, vid AS entity_id, seq AS at_seq FROM v
  UNION ALL SELECT approver, CASE WHEN outcome = 'SUCCESS' THEN CASE decision WHEN 'APPROVE' THEN 'RULE_VERSION_APPROVED' ELSE 'RULE_VERSION_REJECTED' END
    ELSE CASE decision WHEN 'APPROVE' THEN 'RULE_APPROVAL_DENIED' ELSE 'RULE_REJECTION_DENIED' END END, outcome, vid, dseq
  FROM g WHERE coalesce(reason, '') NOT IN ('VERSION_ALREADY_DECIDED', 'RULESET_SIZE_EXCEEDS_LIMIT', 'RULESET_PAYLOAD_EXCEEDS_LIMIT'))"""


@query("governance_audit_trail", oracle.with_(oracle.decided() + "," + _AUDIT, f"""
SELECT actor, action, outcome, entity_id, at_seq, 'RULE_VERSION' AS entity_type,
  {oracle.uuid3('AUDIT', "(action || ':' || entity_id || ':' || at_seq)")} AS audit_event_id FROM au ORDER BY at_seq DESC, audit_event_id DESC"""))
def _(spark, sf):
    return governance.audit_trail(governance.audit_events(versions(spark, sf), decided(spark, sf)))


def governance_tables(spark, sf) -> stored.Stored:
    """The governance tables as stored versions: proposals in two parts, then what follows from them, then a write that never ended."""
    root = f"{ensure_checkpoint_dir(spark)}/governance-{uuid.uuid4()}"
    early = F.col("proposal_seq") % 2 == 0
    proposed = fixtures.proposals(spark, sf)
    tables = stored.Stored(spark, root).write({"proposals": proposed.filter(early)}).write(appended={"proposals": proposed.filter(~early)})
    tables = tables.write({"versions": governance.propose(tables.table("proposals")), "decision_log": fixtures.decisions(spark, sf)})
    tables = tables.write({"decided": governance.decide(tables.table("versions"), tables.table("decision_log"))})
    tables.table("decided").limit(5).write.parquet(f"{root}/decided/unfinished")
    return stored.Stored(spark, root)


@query("governance_stored_decisions", _decisions_sql(100))
def _(spark, sf):
    return _decisions(governance_tables(spark, sf).table("decided"))


@query("governance_stored_audit", oracle.with_(oracle.decided() + "," + _AUDIT, f"""
SELECT actor, action, outcome, entity_id, at_seq, 'RULE_VERSION' AS entity_type,
  {oracle.uuid3('AUDIT', "(action || ':' || entity_id || ':' || at_seq)")} AS audit_event_id FROM au"""))
def _(spark, sf):
    tables = governance_tables(spark, sf)
    return governance.audit_events(tables.table("versions"), tables.table("decided"))


@query("governance_rules_by_key", "SELECT p_partkey, p_name AS rule_key FROM part ORDER BY p_name, p_partkey")
def _(spark, sf):
    rules = fixtures.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("rule_key"))
    return governance.list_rules(rules)


@query("governance_versions_of_rule", oracle.with_(oracle.GOVERNANCE, """
SELECT vid AS rule_version_id, CAST(num AS INTEGER) AS version_number, ct AS change_type FROM v WHERE rule_id = 'rule-3-1' ORDER BY num"""))
def _(spark, sf):
    recorded = versions(spark, sf).filter(F.col("version_number").isNotNull())
    return governance.list_versions(recorded, "rule-3-1").select("rule_version_id", "version_number", "change_type")


@query("governance_version_membership", oracle.with_(oracle.GOVERNANCE, """
, pr AS (SELECT 'rule-' || (o_custkey % 25) || '-' || ((o_orderkey // 2) % 3) AS rule_id, 'ver-' || o_orderkey AS vid FROM orders)
SELECT rule_id, vid AS rule_version_id FROM pr WHERE EXISTS (SELECT 1 FROM v WHERE v.rule_id = pr.rule_id AND v.vid = pr.vid)""".lstrip()))
def _(spark, sf):
    pairs = fixtures.table(spark, sf, "orders").select(
        F.concat(F.lit("rule-"), (F.col("o_custkey") % 25).cast("string"), F.lit("-"), F.expr("(o_orderkey div 2) % 3").cast("string")).alias("rule_id"),
        F.concat(F.lit("ver-"), F.col("o_orderkey").cast("string")).alias("rule_version_id"))
    return governance.versions_of_rule(pairs, versions(spark, sf).filter(F.col("version_number").isNotNull()))


_OUTBOX = """ob AS (SELECT 'agg-' || (o_custkey % 100) AS aggregate_id, o_orderkey AS aggregate_version,
  CASE WHEN o_orderstatus = 'P' OR o_orderkey > 9 * o_custkey THEN 'PENDING' ELSE 'PUBLISHED' END AS status,
  CAST(o_orderkey % 8 AS INTEGER) AS attempt_count, epoch_us(o_orderdate) AS next_attempt_us FROM orders)"""


def outbox(spark, sf):
    key = F.col("o_orderkey")
    return fixtures.table(spark, sf, "orders").select(
        F.concat(F.lit("agg-"), (F.col("o_custkey") % 100).cast("string")).alias("aggregate_id"), key.alias("aggregate_version"),
        F.when((F.col("o_orderstatus") == "P") | (key > 9 * F.col("o_custkey")), "PENDING").otherwise("PUBLISHED").alias("status"),
        (key % 8).cast("int").alias("attempt_count"), F.expr("unix_micros(cast(o_orderdate as timestamp))").alias("next_attempt_us"))


@query("governance_publications", oracle.with_(_OUTBOX, "SELECT * FROM ob ORDER BY aggregate_version"))
def _(spark, sf):
    return governance.publications(outbox(spark, sf))


_NOW_US = 883_612_800_000_000  # 1998-01-01


@query("governance_next_publication", oracle.with_(_OUTBOX, f"""
SELECT * FROM ob o WHERE status = 'PENDING' AND next_attempt_us <= {_NOW_US} AND aggregate_version =
  (SELECT min(aggregate_version) FROM ob i WHERE i.aggregate_id = o.aggregate_id AND i.status = 'PENDING')"""))
def _(spark, sf):
    return governance.next_publication(outbox(spark, sf), F.lit(_NOW_US))


@query("governance_active_status", oracle.with_(_OUTBOX, """
SELECT aggregate_id AS head_key, max(aggregate_version) AS desired_version,
  coalesce(max(aggregate_version) FILTER (WHERE status = 'PUBLISHED'), 0) AS published_version,
  count(*) FILTER (WHERE status = 'PENDING') AS pending_outbox_events FROM ob GROUP BY aggregate_id"""))
def _(spark, sf):
    box = outbox(spark, sf)
    heads = box.groupBy(F.col("aggregate_id").alias("head_key")).agg(
        F.max("aggregate_version").alias("desired_version"),
        F.coalesce(F.max(F.when(F.col("status") == "PUBLISHED", F.col("aggregate_version"))), F.lit(0)).alias("published_version"))
    return governance.active_status(heads, box)


@query("rollout_status", oracle.with_(_OUTBOX, """
, r AS (SELECT aggregate_id AS head_key, max(aggregate_version) AS desired_version,
    coalesce(max(aggregate_version) FILTER (WHERE status = 'PUBLISHED'), 0) AS published_version,
    coalesce(max(aggregate_version) FILTER (WHERE status = 'PUBLISHED' AND attempt_count < 4), 0) AS loaded_version FROM ob GROUP BY aggregate_id)
SELECT *, desired_version - loaded_version AS lag FROM r""".lstrip()))
def _(spark, sf):
    box = outbox(spark, sf).select(F.col("aggregate_id").alias("head_key"), F.col("aggregate_version").alias("version"), "status", "attempt_count")
    published = box.filter("status = 'PUBLISHED'")
    return metrics.rollout(box, published, published.filter("attempt_count < 4"))


# ---------------------------------------------------------------- notifications


@query("notification_request_checks", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'INVALID_NOTIFICATION_REQUEST' WHEN 2 THEN 'KEY_MISMATCH' WHEN 3 THEN 'INVALID_NOTIFICATION_REQUEST'
  WHEN 4 THEN 'KEY_MISMATCH' WHEN 5 THEN 'INVALID_NOTIFICATION_REQUEST' END AS reject_reason FROM part""")
def _(spark, sf):
    kind, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    value = F.format_string(
        '{"schemaVersion":1,"notificationRequestId":"req-%s","alertId":"a","customerId":"c","transactionId":"t","category":"%s",'
        '"templateId":"x","locale":"pt-BR","requestedAt":"2026-01-01T00:00:00Z","traceId":"t"%s}',
        key, F.when(kind == 3, "OTHER").otherwise("SUSPICIOUS_TRANSACTION"), F.when(kind == 1, ',"channel":"EMAIL"').otherwise(""))
    rows = fixtures.table(spark, sf, "part").select(
        "p_partkey", F.when(kind == 2, "x").when(kind == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("req-"), key)).alias("key"),
        F.when(kind == 5, "{").otherwise(value).alias("value"))
    return notifications.check_requests(rows).select("p_partkey", "reject_reason")


def contacts(spark, sf):
    return fixtures.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("cus-"), F.col("c_custkey").cast("string")).alias("customerId"), F.concat("c_name", F.lit("@example.test")).alias("contact"))


@query("notification_contacts", oracle.with_(oracle.results(60) + "," + _REQUESTS, """
SELECT request_id, c_name || '@example.test' AS contact, CASE WHEN c_name IS NULL THEN 'CONTACT_RESOLUTION_FAILED' END AS contact_failure
FROM rq LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON rq.cus = 'cus-' || c.c_custkey"""))
def _(spark, sf):
    return notifications.with_contact(requests(spark, sf), contacts(spark, sf)).select(
        F.col("notificationRequestId").alias("request_id"), "contact", "contact_failure")


@query("notification_failure_reasons", oracle.with_(oracle.results(60) + "," + _REQUESTS, """
SELECT request_id, CASE WHEN c.c_custkey IS NULL THEN 'CONTACT_RESOLUTION_FAILED' WHEN ms // 3600000 % 24 = 4 THEN 'CHANNEL_DELIVERY_FAILED' END AS reason_code
FROM rq JOIN (SELECT seq, ms FROM assessed) USING (seq) LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON rq.cus = 'cus-' || c.c_custkey"""))
def _(spark, sf):
    # the channel was down for the fourth hour of event time
    hours = evaluated(spark, sf, 60).select(
        ids.alert_id(ids.assessment_id(F.col("eventId"))).alias("alertId"), F.expr("(occurred_ms div 3600000) % 24").alias("h"))
    rows = notifications.with_contact(requests(spark, sf).join(hours, "alertId"), contacts(spark, sf))
    reached = F.col("h") != 4
    return rows.select(F.col("notificationRequestId").alias("request_id"),
                       notifications.outcome_reason(F.col("contact").isNotNull(), reached).alias("reason_code"))


# Deliveries so far: by severity of the alert, nothing yet for the lowest.
_LEDGER = """ld AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 'SENT' WHEN 'HIGH' THEN 'SENDING' ELSE 'FAILED' END AS lstatus,
  CAST(CASE severity WHEN 'CRITICAL' THEN 1 ELSE 2 END AS INTEGER) AS attempts FROM rq WHERE severity <> 'LOW')"""


def stored_ledger(spark, sf):
    alerted = assessment.alerts(assessed(spark, sf, 60)).filter("severity <> 'LOW'")
    return alerted.select(
        ids.notification_request_id(F.col("alertId")).alias("notificationRequestId"),
        F.when(F.col("severity") == "CRITICAL", "SENT").when(F.col("severity") == "HIGH", "SENDING").otherwise("FAILED").alias("status"),
        F.when(F.col("severity") == "CRITICAL", 1).otherwise(2).alias("attempt_count"))


@query("ledger_insert_if_absent", oracle.with_(oracle.results(60) + "," + _REQUESTS + "," + _LEDGER, """
SELECT DISTINCT request_id, alert_id FROM rq WHERE request_id NOT IN (SELECT request_id FROM ld)"""))
def _(spark, sf):
    twice = requests(spark, sf).unionByName(requests(spark, sf))
    return notifications.new_requests(twice, stored_ledger(spark, sf)).select(
        F.col("notificationRequestId").alias("request_id"), F.col("alertId").alias("alert_id"))


@query("ledger_claims", oracle.with_(oracle.results(60) + "," + _REQUESTS + "," + _LEDGER, """
SELECT rq.request_id, CASE lstatus WHEN 'SENT' THEN 'ALREADY_SENT' WHEN 'SENDING' THEN 'IN_PROGRESS' ELSE 'ACQUIRE' END AS claim,
  CAST(coalesce(attempts, 0) + CASE WHEN lstatus IN ('SENT', 'SENDING') THEN 0 ELSE 1 END AS INTEGER) AS attempt_count
FROM rq LEFT JOIN ld USING (request_id)"""))
def _(spark, sf):
    return notifications.to_send(requests(spark, sf), stored_ledger(spark, sf)).select(
        F.col("notificationRequestId").alias("request_id"), "claim", "attempt_count")


@query("ledger_replayed_results", oracle.with_(oracle.results(60) + "," + _REQUESTS + "," + _LEDGER, """
SELECT request_id, lstatus AS status, attempts AS attempt_count FROM ld WHERE lstatus = 'SENT'"""))
def _(spark, sf):
    return notifications.replayed_results(requests(spark, sf), stored_ledger(spark, sf)).select(
        F.col("notificationRequestId").alias("request_id"), "status", "attempt_count")


def attempts(spark, sf):
    return shared("attempts", lambda: notifications.resolve_attempts(fixtures.attempt_log(spark, sf)), spark, sf)


@query("ledger_attempts", oracle.with_(oracle.ATTEMPTS, """
SELECT rid AS request_id, seq_at AS "at", kind, result FROM q WHERE pos >= 0"""))
def _(spark, sf):
    return attempts(spark, sf).select(F.col("notificationRequestId").alias("request_id"), "at", "kind", "result")


@query("ledger_state", oracle.with_(oracle.ATTEMPTS, """
SELECT rid AS request_id, status, attempt_count FROM lg"""))
def _(spark, sf):
    return notifications.ledger(attempts(spark, sf)).select(
        F.col("notificationRequestId").alias("request_id"), "status", "attempt_count")


@query("delivery_status_counts", oracle.with_(oracle.ATTEMPTS, "SELECT status, count(*) AS n FROM lg GROUP BY status"))
def _(spark, sf):
    return metrics.count_by(notifications.ledger(attempts(spark, sf)), "status")


_RESULT_RECORDS = oracle.with_(oracle.DELIVERY, f"""
SELECT told.rid AS key, {oracle.record({
    'schemaVersion': "'1'", 'notificationRequestId': oracle.quoted('told.rid'), 'channel': oracle.quoted("'EMAIL'"), 'status': oracle.quoted('kind'),
    'attemptCount': 'n', 'providerReference': f"coalesce({oracle.quoted('provider')}, 'null')", 'reasonCode': f"coalesce({oracle.quoted('why')}, 'null')",
    'updatedAt': oracle.quoted(oracle.iso('us')), 'traceId': oracle.quoted("'trace-' || first_claim")})} AS value, CAST(0 AS INTEGER) AS violations
FROM told JOIN ins USING (rid)""")


def _checked(contract: str, sent: DataFrame) -> DataFrame:
    return sent.select("key", "value", F.size(violations(contract, F.col("value"))).alias("violations"))


def delivered(spark, sf):
    """The delivery log with results; every claim is a sound request."""
    return shared("delivered", lambda: notifications.with_results(
        materialize(delivery.delivery_log(fixtures.delivery_log(spark, sf))[0])), spark, sf)


@query("notification_results", _RESULT_RECORDS)
def _(spark, sf):
    return _checked("notification_result", records.to_records("notification_result", notifications.results(delivered(spark, sf))))


_LEDGER_ROWS = oracle.with_(oracle.DELIVERY, """
SELECT rid AS "notificationRequestId", 'alr-' || first_claim AS "alertId", 'cus-' || user_id AS "customerId", 'txn-' || first_claim AS "transactionId",
  'SUSPICIOUS_TRANSACTION' AS category, 'template' AS "templateId", 'en' AS locale, created_us AS "requestedAt", 'trace-' || first_claim AS "traceId",
  status, CAST(attempt_count AS INTEGER) AS attempt_count, CASE WHEN last_applied IS NOT NULL THEN 'EMAIL' END AS channel,
  CASE WHEN status = 'SENT' THEN last_provider END AS "providerReference", CASE WHEN status = 'FAILED' THEN last_why END AS "lastErrorCode",
  created_us, coalesce(last_us, created_us) AS updated_us
FROM ins JOIN lg USING (rid) LEFT JOIN took USING (rid) JOIN ev_ ON ev_.event_id = first_claim""")


@query("ledger_full_state", _LEDGER_ROWS)
def _(spark, sf):
    return notifications.ledger_rows(delivered(spark, sf))


def _delivered_online(spark, sf) -> str:
    """The delivery log through the online ledger, in three pieces and three starts; the folder it wrote."""
    log = materialize(fixtures.delivery_log(spark, sf))
    low, high = log.agg(F.min("at"), F.max("at")).first()
    root = _online_root(spark)
    for i in range(3):
        log.where(F.floor((F.col("at") - low) * 3 / (high + 1 - low)) == i).write.mode("append").parquet(f"{root}/log")
        _finished([delivery.start(spark.readStream.schema(delivery.LOG).parquet(f"{root}/log"), f"{root}/out", f"{root}/state")])
    return f"{root}/out"


@query("online_notification_results", _RESULT_RECORDS)
def _(spark, sf):
    return _checked("notification_result", delivery.read_results(spark, _delivered_online(spark, sf), records=True))


@query("online_ledger", _LEDGER_ROWS)
def _(spark, sf):
    return delivery.read_ledger(spark, _delivered_online(spark, sf))


# ---------------------------------------------------------------- outgoing records


def _seq_iso() -> str:
    return oracle.quoted(oracle.iso("seq * 1000"))


_ALERT_RULES = """'[' || array_to_string(list_filter([
  CASE WHEN r_amount THEN '{"ruleId":"amount","ruleVersion":1,"evidenceCodes":["AMOUNT_AT_OR_ABOVE_THRESHOLD"]}' END,
  CASE WHEN r_burst THEN '{"ruleId":"burst","ruleVersion":1,"evidenceCodes":["COUNT_AT_OR_ABOVE_MINIMUM"]}' END,
  CASE WHEN r_both THEN '{"ruleId":"both","ruleVersion":1,"evidenceCodes":["ALL_MATCHED"]}' END,
  CASE WHEN r_either THEN '{"ruleId":"either","ruleVersion":1,"evidenceCodes":["ANY_MATCHED"]}' END], lambda x: x IS NOT NULL), ',') || ']'"""


@query("records_alert", oracle.with_(oracle.results(60), f"""
SELECT {oracle.uuid3('ALERT', 'assessment_id')} AS key, {oracle.record({
    'schemaVersion': "'1'", 'alertId': oracle.quoted(oracle.uuid3('ALERT', 'assessment_id')), 'assessmentId': oracle.quoted('assessment_id'),
    'eventId': oracle.quoted('eid'), 'transactionId': oracle.quoted('txn'), 'customerId': oracle.quoted('cus'), 'severity': oracle.quoted('severity'),
    'matchedRules': _ALERT_RULES, 'rulesetVersion': "'1'", 'createdAt': _seq_iso(), 'traceId': oracle.quoted("'trace-' || event_id")})} AS value,
  CAST(0 AS INTEGER) AS violations FROM assessed WHERE status = 'SUSPICIOUS'"""))
def _(spark, sf):
    return _checked("alert", records.to_records("alert", assessment.alerts(assessed(spark, sf, 60))))


@query("records_notification_request", oracle.with_(oracle.results(60) + "," + _REQUESTS, f"""
SELECT request_id AS key, {oracle.record({
    'schemaVersion': "'1'", 'notificationRequestId': oracle.quoted('request_id'), 'alertId': oracle.quoted('alert_id'), 'customerId': oracle.quoted('cus'),
    'transactionId': oracle.quoted('txn'), 'category': oracle.quoted("'SUSPICIOUS_TRANSACTION'"), 'templateId': oracle.quoted("'suspicious-transaction-v1'"),
    'locale': oracle.quoted("'pt-BR'"), 'requestedAt': _seq_iso(), 'traceId': oracle.quoted("'trace-' || event_id")})} AS value,
  CAST(0 AS INTEGER) AS violations FROM rq"""))
def _(spark, sf):
    return _checked("notification_request", records.to_records("notification_request", requests(spark, sf)))


_AMOUNT_RESULT = """'[{"ruleId":"amount","ruleVersion":1,"severity":"HIGH","status":"' || CASE WHEN r_amount THEN 'MATCHED' ELSE 'NO_MATCH' END ||
  '","evidenceCodes":["' || CASE WHEN cur <> 'BRL' THEN 'CURRENCY_MISMATCH' WHEN amt >= 30000 THEN 'AMOUNT_AT_OR_ABOVE_THRESHOLD' ELSE 'AMOUNT_BELOW_THRESHOLD' END ||
  '"],"evaluatedValues":{"amountMinor":"' || amt || '","thresholdMinor":"30000",' ||
  CASE WHEN cur <> 'BRL' THEN '"eventCurrency":"' || cur || '","ruleCurrency":"BRL"' ELSE '"currency":"BRL"' END || '}}]'"""


@query("records_assessment", oracle.with_(oracle.results(60), f"""
SELECT txn AS key, {oracle.record({
    'schemaVersion': "'1'", 'assessmentId': oracle.quoted('assessment_id'), 'eventId': oracle.quoted('eid'), 'transactionId': oracle.quoted('txn'),
    'customerId': oracle.quoted('cus'), 'status': "CASE WHEN r_amount THEN '\"SUSPICIOUS\"' ELSE '\"NOT_SUSPICIOUS\"' END",
    'finalSeverity': "CASE WHEN r_amount THEN '\"HIGH\"' ELSE '\"NONE\"' END", 'ruleResults': _AMOUNT_RESULT, 'rulesetVersion': "'1'",
    'receivedAt': _seq_iso(), 'evaluatedAt': _seq_iso(), 'late': "CASE WHEN late THEN 'true' ELSE 'false' END",
    'traceId': oracle.quoted("'trace-' || event_id")})} AS value, CAST(0 AS INTEGER) AS violations FROM assessed"""))
def _(spark, sf):
    """Assessments under the first rule alone, as records of the online job."""
    document = {**fixtures.ruleset_document(), "rules": fixtures.ruleset_document()["rules"][:1]}
    raw = materialize(fixtures.raw_records(spark, sf, 60))
    out = _feed(spark, _online_root(spark), [raw], {0: [fixtures.published_ruleset(spark, document)]}, as_records=True)
    return _checked("assessment", online.read_records(spark, out, "assessment"))


@query("records_invalid", f"""
SELECT CASE WHEN event_id % 13 = 9 THEN 'other' WHEN event_id % 13 = 10 THEN NULL ELSE 'txn-' || event_id END AS key, {oracle.record({
    'schemaVersion': "'1'", 'sourceTopic': oracle.quoted("'fraud.transaction.received.v1'"), 'sourcePartition': '(event_id % 12)', 'sourceOffset': '(event_id // 12)',
    'payloadHash': oracle.quoted(f'sha256({_RAW_VALUE})'), 'sourceSchemaVersion': "CASE WHEN event_id % 13 IN (9, 10) THEN '1' ELSE 'null' END",
    'reasonCode': oracle.quoted("'INVALID_TRANSACTION_EVENT'"), 'detectedAt': oracle.quoted(oracle.iso('epoch_us(ts)'))})} AS value,
  CAST(0 AS INTEGER) AS violations FROM events WHERE event_id % 13 NOT IN (0, 8)""")
def _(spark, sf):
    return _checked("invalid_ref", records.to_records("invalid", ingest.invalid_references(parsed(spark, sf))))


@query("records_quarantine", oracle.with_(oracle.identity(1), f"""
SELECT tx.txn AS key, {oracle.record({
    'schemaVersion': "'1'", 'sourceTopic': oracle.quoted("'fraud.transaction.received.v1'"), 'sourcePartition': 'part', 'sourceOffset': 'seq',
    'eventId': oracle.quoted('eid'), 'transactionId': oracle.quoted('txn'), 'payloadHash': oracle.quoted(_fingerprint_sql('amt')),
    'conflictingIdentityHash': oracle.quoted(_fingerprint_sql('first_amt')), 'reasonCode': oracle.quoted("'EVENT_IDENTITY_CONFLICT'"),
    'detectedAt': _seq_iso()})} AS value, CAST(0 AS INTEGER) AS violations
FROM tx JOIN (SELECT seq, first_amt, outcome FROM f2) USING (seq) WHERE outcome = 'EVENT_IDENTITY_CONFLICT'"""))
def _(spark, sf):
    rows = resolved(spark, sf, 1).filter(F.col("outcome") == identity.EVENT_CONFLICT)
    return _checked("quarantine_ref", records.to_records("quarantine", identity.quarantine_references(rows, ingest.TRANSACTION_TOPIC)))


# ---------------------------------------------------------------- metrics and maintenance


@query("assessment_counts", oracle.with_(oracle.results(1), "SELECT status, count(*) AS n FROM assessed GROUP BY status"))
def _(spark, sf):
    return metrics.count_by(assessed(spark, sf, 1), "status")


@query("latency_p95_by_window", """
SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS bucket_us, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events").withColumn("at", F.expr("cast(ts as timestamp)"))
    return metrics.latency_p95(rows, "at", "value").select(F.unix_micros("bucket").alias("bucket_us"), "p95")


@query("latency_summary", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
  round(quantile_cont(value, 0.999), 6) AS p999, max(value) AS maximum,
  round(100.0 * count(*) FILTER (WHERE value <= 500) / count(*), 6) AS within_objective_percent FROM events GROUP BY event_type""")
def _(spark, sf):
    out = metrics.latency_summary(fixtures.table(spark, sf, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99", "p999", "within_objective_percent")})


@query("latency_summary_scales", """
SELECT scale, event_type, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.999), 6) AS p999
FROM (SELECT event_type, s.scale, CASE s.scale WHEN 'unit' THEN event_id * 7919 % 10007 / 10007.0 WHEN 'huge' THEN event_id * 7919 % 10007 * 99991.0 ELSE event_id % 3 END AS v
  FROM events, (VALUES ('unit'), ('huge'), ('ties')) s(scale)) GROUP BY scale, event_type""")
def _(spark, sf):
    """Values below one, up to a thousand millions, and three values only, in brackets that are refined."""
    n = (F.col("event_id") * 7919 % 10007).cast("double")
    values = {"unit": n / 10007.0, "huge": n * 99991.0, "ties": (F.col("event_id") % 3).cast("double")}
    rows = fixtures.table(spark, sf, "events").select("event_type", F.inline(F.array(*[
        F.struct(F.lit(k).alias("scale"), v.alias("v")) for k, v in values.items()])))
    found = metrics.exact_quantiles(rows, ["scale", "event_type"], "v", {"p50": 0.5, "p95": 0.95, "p999": 0.999}, cells=20, limit=200)
    return found.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p999")})


@query("latency_target", """
SELECT event_type, least(count(*) FILTER (WHERE event_id % 4 > 0 AND value <= 500) / nullif(count(*) FILTER (WHERE event_id % 4 > 0), 0), 1) >= 0.999
    AND coalesce(count(*) FILTER (WHERE event_id % 9 = 0 AND value / 2 <= 500) / nullif(count(*) FILTER (WHERE event_id % 9 = 0), 0) >= 0.999, true) AS latency_target_met
FROM events GROUP BY event_type UNION ALL SELECT 'outage', false WHERE (SELECT count(*) FROM events) > 0""")
def _(spark, sf):
    """By kind of event; one more group has events and no output at all."""
    rows = fixtures.table(spark, sf, "events").select(
        "event_type", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("assessment"), F.when(F.col("event_id") % 9 == 0, F.col("value") / 2).alias("alert"))
    outage = rows.select(F.lit("outage").alias("event_type"), F.lit(None).cast("double").alias("assessment"), F.lit(None).cast("double").alias("alert"))
    return metrics.latency_target(rows.unionByName(outage), ["event_type"], "assessment", "alert")


@query("throughput", """
SELECT event_type, count(*) AS events, round(count(*) / ((max(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT)) - min(epoch_us(ts))) / 1000000.0), 9) AS per_second,
  count(*) / ((max(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT)) - min(epoch_us(ts))) / 1000000.0) >= 0.0008 AS target_met FROM events GROUP BY event_type""")
def _(spark, sf):
    us = F.expr("unix_micros(cast(ts as timestamp))")
    rows = fixtures.table(spark, sf, "events").select(
        "event_type", us.alias("sent_us"), (us + F.round(F.col("value") * 1000).cast("long")).alias("seen_us"))
    return metrics.throughput(rows, ["event_type"], "sent_us", "seen_us", 0.0008).withColumn("per_second", F.round("per_second", 9))


# Six kinds of damage, each in its own hour of event time: lost or repeated inputs and outputs.
@query("reconcile_counts", oracle.with_(oracle.results(60), """
, hr AS (SELECT *, ms // 3600000 % 24 AS h FROM assessed),
i AS (SELECT DISTINCT eid FROM tx WHERE ms // 3600000 % 24 <> 1),
s AS (SELECT eid, status FROM hr WHERE h <> 3 UNION ALL SELECT eid, status FROM hr WHERE h = 5),
a AS (SELECT eid FROM hr WHERE status = 'SUSPICIOUS' AND h <> 7 UNION ALL SELECT eid FROM hr WHERE h = 9),
sx AS (SELECT eid, count(*) AS n, bool_or(status = 'SUSPICIOUS') AS susp FROM s GROUP BY eid), ax AS (SELECT eid, count(*) AS n FROM a GROUP BY eid)
SELECT (SELECT count(*) FROM i) AS inputs, (SELECT count(*) FROM sx) AS assessments, (SELECT count(*) FROM ax) AS alerts,
  (SELECT count(*) FROM i WHERE eid NOT IN (SELECT eid FROM sx)) AS missing_assessments,
  (SELECT count(*) FROM sx WHERE eid NOT IN (SELECT eid FROM i)) AS unexpected_assessments,
  (SELECT count(*) FROM sx WHERE n > 1) AS duplicate_assessments,
  (SELECT count(*) FROM sx WHERE susp AND eid NOT IN (SELECT eid FROM ax)) AS missing_alerts,
  (SELECT count(*) FROM ax WHERE eid NOT IN (SELECT eid FROM sx WHERE susp)) AS unexpected_alerts,
  (SELECT count(*) FROM ax WHERE n > 1) AS duplicate_alerts""".lstrip()))
def _(spark, sf):
    hour = F.expr("(occurred_ms div 3600000) % 24")
    rows = evaluated(spark, sf, 60)
    done = rows.select("eventId", assessment.overall_status(F.col("ruleResults")).alias("status"), hour.alias("h"))
    sent = fixtures.transactions(spark, sf, 60).filter(hour != 1)
    seen = done.filter("h <> 3").unionByName(done.filter("h = 5"))
    alerted = done.filter("status = 'SUSPICIOUS' AND h <> 7").unionByName(done.filter("h = 9"))
    return metrics.reconcile(sent, seen, alerted)


@query("duplicate_outputs", oracle.with_(oracle.tx(1), "SELECT eid AS event_id, count(*) AS n FROM tx GROUP BY eid HAVING count(*) > 1"))
def _(spark, sf):
    return metrics.duplicate_keys(fixtures.transactions(spark, sf, 1), "eventId").withColumnRenamed("eventId", "event_id")


@query("missing_outputs", oracle.with_(oracle.identity(60), """
SELECT DISTINCT eid AS event_id FROM tx EXCEPT SELECT eid FROM tx JOIN outc USING (seq) WHERE outcome = 'accepted'"""))
def _(spark, sf):
    sent = fixtures.transactions(spark, sf, 60).select(F.col("eventId").alias("event_id")).distinct()
    accepted = resolved(spark, sf, 60).filter("outcome = 'accepted'").select(F.col("eventId").alias("event_id"))
    return sent.join(accepted, "event_id", "left_anti")


@query("feedback_false_positives", oracle.with_(oracle.results(60), f"""
, al AS (SELECT event_id, unnest(list_filter({_RULE_ROWS}, lambda x: x IS NOT NULL)) AS r FROM assessed WHERE status = 'SUSPICIOUS'),
fb AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'FRAUD' WHEN 'view' THEN 'UNKNOWN' ELSE 'LEGITIMATE' END AS label FROM events)
SELECT split_part(r, ':', 1) AS rule_id, count(*) AS judged, count(*) FILTER (WHERE label = 'LEGITIMATE') AS legitimate,
  round(count(*) FILTER (WHERE label = 'LEGITIMATE') / count(*), 9) AS false_positive_rate FROM al JOIN fb USING (event_id) GROUP BY 1""".lstrip()))
def _(spark, sf):
    alerted = assessment.alerts(assessed(spark, sf, 60))
    events = fixtures.table(spark, sf, "events").select(
        F.concat(F.lit("txn-"), "event_id").alias("transactionId"),
        F.when(F.col("event_type") == "error", "FRAUD").when(F.col("event_type") == "view", "UNKNOWN").otherwise("LEGITIMATE").alias("label"))
    feedback = alerted.select("alertId", "assessmentId", "transactionId").join(events, "transactionId").drop("transactionId")
    rates = metrics.false_positive_rate(alerted, feedback)
    return rates.withColumnRenamed("ruleId", "rule_id").withColumn("false_positive_rate", F.round("false_positive_rate", 9))


@query("retention_filter", """
SELECT event_id FROM events WHERE epoch_us(ts) >= 1706572800000000 - 7 * 86400000000""")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return tables.within_retention(rows, "us", F.lit(1_706_572_800_000_000), tables.RETENTION_DAYS["transaction"]).select("event_id")


@query("compact_latest", """
SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id""")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return tables.compact(rows, ["user_id"], "event_id")


@query("severity_default", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'CRITICAL' END AS severity FROM part""")
def _(spark, sf):
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, '{"type":"X"}').when(kind == 1, '{"severity":"LOW"}').otherwise('{"severity":"CRITICAL"}')
    return fixtures.table(spark, sf, "part").select("p_partkey", governance.severity_of(F.try_parse_json(text)).alias("severity"))


# ---------------------------------------------------------------- online


def _bucket() -> Column:
    return F.regexp_extract("customerId", r"(\d+)$", 1).cast("long") % 12


def _finished(queries) -> None:
    for part in queries:
        part.awaitTermination()
        if part.exception() is not None:
            raise part.exception()


def _feed(spark, root: str, pieces, documents, **options) -> str:
    """Run the online job over ``pieces`` of records, one start each; ``documents[i]`` are published before piece i.  Returns the output folder."""
    rules_schema = "key string, payload string, arrival_seq long"
    for i, piece in enumerate(pieces):
        for snapshot in documents.get(i, []):
            snapshot.write.mode("append").parquet(f"{root}/rules")
        piece.write.mode("append").parquet(f"{root}/records")
        feed = spark.readStream.schema(piece.schema).parquet(f"{root}/records")
        rules = spark.readStream.schema(rules_schema).parquet(f"{root}/rules")
        _finished(online.start(feed, rules, None, f"{root}/out", f"{root}/state", bucket=_bucket(), **options))
    return f"{root}/out"


def _online_root(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/online-{uuid.uuid4()}"


def _middle(raw: DataFrame) -> int:
    return raw.agg(((F.min("arrival_seq") + F.max("arrival_seq")) / 2).cast("long")).first()[0]


def _halves(raw: DataFrame) -> list[DataFrame]:
    middle = _middle(raw)
    return [raw.filter(F.col("arrival_seq") <= middle), raw.filter(F.col("arrival_seq") > middle)]


@query("online_assessments", _assess_sql(60))
def _(spark, sf):
    """The streaming job over the records of the transaction view, fed in two halves of arrival order."""
    raw = materialize(fixtures.raw_records(spark, sf, 60))
    out = _feed(spark, _online_root(spark), _halves(raw), {0: [fixtures.published_ruleset(spark, fixtures.ruleset_document())]})
    return _assess_columns(online.read_output(spark, out, "assessment"))


@query("online_24h", _assess_sql(1))
def _(spark, sf):
    """Thirty days online: identities expire, keys are accepted again, and state of days ago is dropped, over three starts."""
    raw = materialize(fixtures.raw_records(spark, sf, 1))
    first, second = _halves(raw)
    out = _feed(spark, _online_root(spark), [first, *_halves(second)], {0: [fixtures.published_ruleset(spark, fixtures.ruleset_document())]})
    return _assess_columns(online.read_output(spark, out, "assessment"))


@query("online_ruleset_change", oracle.with_(oracle.results(60), """
SELECT seq AS arrival_seq, assessment_id, CAST(CASE WHEN seq > middle THEN 2 ELSE 1 END AS BIGINT) AS ruleset_version,
  CASE WHEN seq <= middle THEN status WHEN r_amount THEN 'SUSPICIOUS' ELSE 'NOT_SUSPICIOUS' END AS status,
  CASE WHEN seq <= middle THEN severity WHEN r_amount THEN 'HIGH' ELSE 'NONE' END AS severity,
  CAST(CASE WHEN seq > middle THEN 1 ELSE 4 END AS INTEGER) AS rules
FROM assessed, (SELECT (min(seq) + max(seq)) // 2 AS middle FROM tx)"""))
def _(spark, sf):
    """A new rule set is published between two micro-batches, next to an older one and a damaged one that must not count."""
    raw = materialize(fixtures.raw_records(spark, sf, 60))
    whole = fixtures.ruleset_document()
    second = {**whole, "version": 2, "rules": whole["rules"][:1]}
    damaged = fixtures.published_ruleset(spark, {**whole, "version": 9}, 10).withColumn("payload", F.replace("payload", F.lit("HIGH"), F.lit("LOW")))
    out = _feed(spark, _online_root(spark), _halves(raw), {
        0: [fixtures.published_ruleset(spark, whole)],
        1: [damaged, fixtures.published_ruleset(spark, second, 20), fixtures.published_ruleset(spark, {**whole, "snapshotId": "again"}, 30)]})
    return _assess_columns(online.read_output(spark, out, "assessment")).select(
        "arrival_seq", "assessment_id", "ruleset_version", "status", "severity", "rules")


class _Stopped(RuntimeError):
    """Thrown into the online job by the query below."""


@query("online_references", oracle.with_(oracle.identity(60), f"""
SELECT 'quarantine' AS kind, tx.txn AS key, CAST(tx.part AS INTEGER) AS source_partition, tx.seq AS source_offset, {_fingerprint_sql('tx.amt').replace('eid', 'tx.eid').replace('|| txn', '|| tx.txn').replace('|| cus', '|| tx.cus')} AS payload_hash,
  'sha256:' || sha256(first_eid) AS conflicting_hash, 'TRANSACTION_IDENTITY_CONFLICT' AS reason, tx.seq * 1000 AS detected_us
FROM tx JOIN f1 USING (seq) WHERE conflict
UNION ALL
SELECT 'quarantine', txn, CAST(part AS INTEGER), seq, {_fingerprint_sql('amt')}, {_fingerprint_sql('first_amt')}, outcome, seq * 1000
FROM tx JOIN (SELECT seq, first_amt, outcome FROM f2) USING (seq) WHERE outcome = 'EVENT_IDENTITY_CONFLICT'
UNION ALL
SELECT 'invalid', 'bad-' || event_id, CAST(event_id % 12 AS INTEGER), event_id * 10 + 4, sha256('{{'), NULL, 'INVALID_TRANSACTION_EVENT', (event_id * 10 + 4) * 1000
FROM events WHERE event_id % 40 = 7"""))
def _(spark, sf):
    """Quarantine and invalid references after the job was stopped between the writes and the commit of its second batch."""
    damaged = fixtures.table(spark, sf, "events").filter("event_id % 40 = 7").select(
        F.concat(F.lit("bad-"), "event_id").alias("key"), F.lit("{").alias("value"), (F.col("event_id") % 12).cast("int").alias("partition"),
        (F.col("event_id") * 10 + 4).alias("offset"), F.timestamp_micros((F.col("event_id") * 10 + 4) * 1000).alias("timestamp"),
        (F.col("event_id") * 10 + 4).alias("arrival_seq"))
    raw = materialize(fixtures.raw_records(spark, sf, 60).unionByName(damaged))
    first, second = _halves(raw)
    root, rules = _online_root(spark), {0: [fixtures.published_ruleset(spark, fixtures.ruleset_document())]}
    out = _feed(spark, root, [first], rules)

    def stop(batch: int) -> None:
        raise _Stopped(f"between writes and commit of batch {batch}")

    try:
        _feed(spark, root, [second], {}, on_written=stop)
    except StreamingQueryException as stopped:
        if "between writes and commit" not in str(stopped):
            raise
    nothing_more = second.limit(0)
    _feed(spark, root, [nothing_more], {})
    quarantined, invalid = (online.read_output(spark, out, n) for n in ("quarantine", "invalid"))
    return quarantined.select(
        F.lit("quarantine").alias("kind"), "key", F.col("sourcePartition").alias("source_partition"), F.col("sourceOffset").alias("source_offset"),
        F.col("payloadHash").alias("payload_hash"), F.col("conflictingIdentityHash").alias("conflicting_hash"), F.col("reasonCode").alias("reason"), "detected_us",
    ).unionByName(invalid.select(
        F.lit("invalid").alias("kind"), "key", F.col("sourcePartition").alias("source_partition"), F.col("sourceOffset").alias("source_offset"),
        F.col("payloadHash").alias("payload_hash"), F.lit(None).cast("string").alias("conflicting_hash"), F.col("reasonCode").alias("reason"), "detected_us"))


# Offsets are the order inside a partition; across partitions stamps with many ties decide.
_TOPIC_STEP = 500


@query("online_topic_order", oracle.with_(oracle.identity(60).replace("tx AS (", "tx0 AS (", 1).replace("\nt1 AS (", f"""
tx AS (SELECT * REPLACE (row_number() OVER (ORDER BY seq // {_TOPIC_STEP}, part, seq) AS seq), seq AS pos FROM tx0),
t1 AS (""", 1), """
SELECT job, CAST(part AS INTEGER) AS source_partition, pos AS source_offset, outcome FROM outc JOIN tx USING (seq), (VALUES ('batch'), ('online')) j(job)"""))
def _(spark, sf):
    """Records as a topic gives them (no arrival number), through the batch job and the online job."""
    raw = materialize(fixtures.raw_records(spark, sf, 60).withColumn(
        "timestamp", F.timestamp_micros(F.floor(F.col("arrival_seq") / _TOPIC_STEP).cast("long") * _TOPIC_STEP * 1000)))
    cut = _middle(raw) // _TOPIC_STEP * _TOPIC_STEP
    halves = [raw.filter(F.col("arrival_seq") < cut).drop("arrival_seq"), raw.filter(F.col("arrival_seq") >= cut).drop("arrival_seq")]
    document = fixtures.ruleset_document()
    out = _feed(spark, _online_root(spark), halves, {0: [fixtures.published_ruleset(spark, document)]})
    topic = raw.drop("arrival_seq")
    numbered, _came = with_arrival(topic, start=0)
    places = materialize(numbered)
    parsed = materialize(ingest.parse_events(places).withColumns({"ruleset_version": F.lit(1).cast("long"), "bucket": _bucket(), "active": F.lit(True)}))
    batch = risk.resolve_identity(parsed).select("arrival_seq", "outcome")
    jobs = {"batch": batch, "online": online.read_output(spark, out, "disposition").select("arrival_seq", "outcome")}
    parts = [df.join(places.select("arrival_seq", "partition", "offset"), "arrival_seq").select(
        F.lit(name).alias("job"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), "outcome") for name, df in jobs.items()]
    return parts[0].unionByName(parts[1])
