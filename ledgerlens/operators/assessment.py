"""From rule results to assessments, alerts and notification requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ids import alert_id, assessment_id, notification_request_id
from ledgerlens.operators.rules import RuleSet
from ledgerlens.sources.contracts import RULE_RESULT_TYPE, SEVERITIES

# What every notification request says.
CATEGORY = "SUSPICIOUS_TRANSACTION"
TEMPLATE = "suspicious-transaction-v1"
LOCALE = "pt-BR"


def overall_status(results: Column) -> Column:
    """SUSPICIOUS if any rule matched, INCONCLUSIVE if any could not be evaluated; no results is an error, never a status."""
    def has(status: str) -> Column:
        return F.exists(results, lambda r: r["status"] == status)

    return (
        F.when(results.isNull() | (F.size(results) == 0), F.raise_error(F.lit("RULE_RESULTS_MUST_NOT_BE_EMPTY")).cast("string"))
        .when(has("MATCHED"), "SUSPICIOUS")
        .when(has("NOT_EVALUATED"), "INCONCLUSIVE")
        .otherwise("NOT_SUSPICIOUS")
    )


def final_severity(results: Column) -> Column:
    """Highest severity among matched rules, NONE without any."""
    ranks = F.array(*[F.lit(s) for s in SEVERITIES])
    matched = F.transform(
        F.filter(results, lambda r: r["status"] == "MATCHED"),
        lambda r: F.array_position(ranks, r["severity"]).cast("int"),
    )
    return F.coalesce(F.get(ranks, F.array_max(matched) - 1), F.lit("NONE"))


def evaluate(events: DataFrame, rulesets: Mapping[int, RuleSet]) -> DataFrame:
    """Add ``ruleResults`` under each event's own ``ruleset_version``.

    One projection for any number of versions: every distinct rule of all of them is one expression, evaluated for
    events of the versions that have it, and a version is the list of its rules' places.  An event whose version is
    NULL or not loaded stops the job; nobody evaluated it, so it has no status.
    """
    pool = {rule: i for i, rule in enumerate(dict.fromkeys(r for v in sorted(rulesets) for r in rulesets[v].rules))}
    version = F.col("ruleset_version").cast("long")
    missing = F.raise_error(F.concat(F.lit("RULE_SET_NOT_LOADED: "), F.coalesce(version.cast("string"), F.lit("none"))))
    if not pool:
        return events.withColumn("ruleResults", missing.cast(T.ArrayType(RULE_RESULT_TYPE)))
    users: dict = {rule: [v for v in sorted(rulesets) if rule in rulesets[v].rules] for rule in pool}
    results = F.array(*[F.when(version.isin(users[rule]), rule.result()) for rule in pool])
    places = F.create_map(*[x for v in sorted(rulesets) for x in (
        F.lit(v).cast("long"), F.array(*[F.lit(pool[r]) for r in rulesets[v].rules]))])
    chosen = F.transform(F.array(results), lambda found: F.transform(
        F.try_element_at(places, version), lambda place: F.get(found, place)))[0]
    return events.withColumn("ruleResults", F.coalesce(chosen, missing.cast(T.ArrayType(RULE_RESULT_TYPE))))


def assessments(evaluated: DataFrame) -> DataFrame:
    """One explainable assessment per accepted event (instants as epoch microseconds)."""
    return evaluated.select(
        F.lit(1).alias("schemaVersion"),
        assessment_id(F.col("eventId")).alias("assessmentId"),
        "eventId", "transactionId", "customerId",
        overall_status(F.col("ruleResults")).alias("status"),
        final_severity(F.col("ruleResults")).alias("finalSeverity"),
        "ruleResults",
        F.col("ruleset_version").alias("rulesetVersion"),
        F.col("received_us").alias("receivedAt"),
        F.col("received_us").alias("evaluatedAt"),
        "late",
        "traceId",
        "arrival_seq",
    )


def alerts(assessed: DataFrame) -> DataFrame:
    """One alert per suspicious assessment, with the matched rules only."""
    matched = F.transform(
        F.filter("ruleResults", lambda r: r["status"] == "MATCHED"),
        lambda r: F.struct(r["ruleId"].alias("ruleId"), r["ruleVersion"].alias("ruleVersion"),
                           r["evidenceCodes"].alias("evidenceCodes")),
    )
    return assessed.filter(F.col("status") == "SUSPICIOUS").select(
        F.lit(1).alias("schemaVersion"),
        alert_id(F.col("assessmentId")).alias("alertId"),
        "assessmentId", "eventId", "transactionId", "customerId",
        F.col("finalSeverity").alias("severity"),
        matched.alias("matchedRules"),
        "rulesetVersion",
        F.col("evaluatedAt").alias("createdAt"),
        "traceId",
    )


def notification_requests(alerted: DataFrame) -> DataFrame:
    """Sanitized request per alert: no channel, no contact data."""
    return alerted.select(
        F.lit(1).alias("schemaVersion"),
        notification_request_id(F.col("alertId")).alias("notificationRequestId"),
        "alertId", "customerId", "transactionId",
        F.lit(CATEGORY).alias("category"),
        F.lit(TEMPLATE).alias("templateId"),
        F.lit(LOCALE).alias("locale"),
        F.col("createdAt").alias("requestedAt"),
        "traceId",
    )
