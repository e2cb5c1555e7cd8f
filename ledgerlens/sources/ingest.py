"""From raw records to typed events, and the split into valid and invalid ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ids import is_blank
from ledgerlens.sources.contracts import flat_struct, same_text, values_conform, violations

# Names other systems read in the reference rows.
TRANSACTION_TOPIC = "fraud.transaction.received.v1"
INVALID_EVENT = "INVALID_TRANSACTION_EVENT"

# An ISO instant with seconds; an offset other than Z is allowed.
INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})\z"

_TEXT_FIELDS = (
    "eventId", "transactionId", "customerId", "currency", "transactionType", "channel",
    "merchantCountry", "deviceIdHash", "traceId",
)


def instant_micros(text: Column) -> Column:
    """Epoch microseconds of an ISO instant, NULL for any other text."""
    return F.when(text.rlike(INSTANT_PATTERN), F.unix_micros(F.try_to_timestamp(F.upper(text))))


def parse_events(records: DataFrame) -> DataFrame:
    """Typed event columns for every record, with ``schema_valid`` and ``valid``.

    Input: key, value (text or bytes), partition, offset, timestamp, arrival_seq.
    ``schema_valid`` decides whether the row moves stream time, ``valid`` (which also
    asks for the right key) whether it is evaluated.  Narrow: no shuffle.
    """
    text = F.col("value").cast("string")
    contract = "transaction_event"
    parsed = records.select(
        "key", "value", "partition", "offset", "timestamp", "arrival_seq",
        F.from_json(text, flat_struct(contract)).alias("__t"))
    v, t = F.col("__v"), F.col("__t")
    # Most records are written in declared order and sound: they need no second parse.
    parsed = parsed.withColumn("__sound", same_text(contract, t, text) & values_conform(contract, t))
    parsed = parsed.withColumn("__v", F.when(~F.col("__sound"), F.try_parse_json(text)))
    reordered = same_text(contract, t, F.to_json(v), canonical=True) & values_conform(contract, t)
    none = F.array().cast("array<string>")
    typed = parsed.select(
        "key", "partition", "offset", "arrival_seq",
        F.unix_micros("timestamp").alias("received_us"),
        F.sha2(F.col("value").cast("binary"), 256).alias("payload_hash"),
        t["schemaVersion"].cast("int").alias("schemaVersion"),
        t["amountMinor"].alias("amountMinor"),
        *[t[n].alias(n) for n in _TEXT_FIELDS],
        instant_micros(t["occurredAt"]).alias("occurred_us"),
        # One row in, one row out: the generator keeps later filters on validity from being
        # rewritten in terms of the whole check, which would evaluate it once per filter.
        F.explode(F.array(
            F.when(F.col("__sound"), none).when(reordered, none).otherwise(violations(contract, text, v))
        )).alias("violations"),
    )
    ok = (
        (F.size("violations") == 0)
        & F.col("occurred_us").isNotNull()
        & ~is_blank(F.col("eventId"))
    )
    return (
        typed.withColumn("schema_valid", F.coalesce(ok, F.lit(False)))
        .withColumn("valid", F.col("schema_valid")
                    & F.coalesce(F.col("key") == F.col("transactionId"), F.lit(False)))
        .withColumn("occurred_ms", millis_of("occurred_us"))
    )


def millis_of(micros: str) -> Column:
    """Whole milliseconds, rounded down, without leaving integer arithmetic."""
    return F.expr(f"({micros} - pmod({micros}, 1000L)) div 1000L")


def invalid_references(events: DataFrame, detected_us: Column | None = None) -> DataFrame:
    """Where a rejected record came from and why; never its payload."""
    return events.filter(~F.col("valid")).select(
        "key",
        F.lit(1).alias("schemaVersion"),
        F.lit(TRANSACTION_TOPIC).alias("sourceTopic"),
        F.col("partition").alias("sourcePartition"),
        F.col("offset").alias("sourceOffset"),
        F.coalesce("payload_hash", F.sha2(F.lit("").cast("binary"), 256)).alias("payloadHash"),
        F.when(F.col("schema_valid"), F.col("schemaVersion")).alias("sourceSchemaVersion"),
        F.lit(INVALID_EVENT).alias("reasonCode"),
        (F.col("received_us") if detected_us is None else detected_us).alias("detected_us"),
    )
