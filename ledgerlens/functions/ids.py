"""Deterministic identifiers and content hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces every deployment must share for ids to agree.
ASSESSMENT_NAMESPACE = "ASSESSMENT"
ALERT_NAMESPACE = "ALERT"
NOTIFICATION_REQUEST_NAMESPACE = "NOTIFICATION-REQUEST"

# Fields of the event fingerprint, in the order they are hashed.
FINGERPRINT_FIELDS = (
    "schemaVersion",
    "eventId",
    "transactionId",
    "customerId",
    "amountMinor",
    "currency",
    "occurredAt",
    "transactionType",
    "channel",
    "merchantCountry",
    "deviceIdHash",
    "traceId",
)


def is_blank(value: Column) -> Column:
    return value.isNull() | ~value.rlike(r"[^\p{javaWhitespace}]")


def name_uuid(namespace: str, value: Column) -> Column:
    """RFC 4122 version-3 UUID of ``namespace:value``; NULL for a blank value."""
    digest = F.md5(F.concat(F.lit(namespace + ":"), value).cast("binary"))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    uuid = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return F.when(~is_blank(value), uuid)


def assessment_id(event_id: Column) -> Column:
    return name_uuid(ASSESSMENT_NAMESPACE, event_id)


def alert_id(assessment: Column) -> Column:
    return name_uuid(ALERT_NAMESPACE, assessment)


def notification_request_id(alert: Column) -> Column:
    return name_uuid(NOTIFICATION_REQUEST_NAMESPACE, alert)


def iso_instant(micros: Column) -> Column:
    """Epoch microseconds as ISO-8601 UTC text with 0, 3 or 6 fraction digits."""
    fraction = F.pmod(micros, F.lit(1_000_000))
    whole = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=((micros - fraction) / F.lit(1_000_000)).cast("decimal(18,6)")
    )
    head = F.concat(F.substring(whole.cast("string"), 1, 10), F.lit("T"), F.substring(whole.cast("string"), 12, 8))
    tail = (
        F.when(fraction == 0, F.lit(""))
        .when(fraction % 1000 == 0, F.concat(F.lit("."), F.lpad((fraction / 1000).cast("long").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))
    )
    return F.concat(head, tail, F.lit("Z"))


def event_fingerprint(occurred_micros: Column) -> Column:
    """``sha256:`` + digest of the event's JSON in declared field order."""
    fields = [
        iso_instant(occurred_micros).alias(f) if f == "occurredAt" else F.col(f)
        for f in FINGERPRINT_FIELDS
    ]
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*fields)), 256))


def canonical_json(text: Column) -> Column:
    """JSON with object keys sorted at every level; arrays keep their order."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def backoff_seconds(previous_attempts: Column) -> Column:
    """Publication retry delay: doubles per earlier attempt, one minute at most."""
    return F.least(F.lit(60), F.pow(F.lit(2), F.least(previous_attempts, F.lit(6))).cast("int"))


def message_id(raw: Column) -> Column:
    """Provider message id without surrounding angle brackets; NULL when blank."""
    # trim as Java does: every leading and trailing character up to the space
    trimmed = F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    inner = F.regexp_extract(trimmed, r"(?s)^<(.+)>$", 1)
    return F.when(~is_blank(raw), F.when(inner != "", inner).otherwise(trimmed))
