"""The batch job: records and rule sets in, every output table out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ids import FINGERPRINT_FIELDS, event_fingerprint
from ledgerlens.operators import assessment, history, identity
from ledgerlens.operators.ordering import CHUNK_WIDTH, running_max
from ledgerlens.operators.rules import RuleSet
from ledgerlens.session import materialize
from ledgerlens.sources.ingest import TRANSACTION_TOPIC, invalid_references, parse_events

# Customer buckets stand for the partitions of a topic keyed by customer.
DEFAULT_BUCKETS = 4096


FINGERPRINT_FIELDS_HELD = [f for f in FINGERPRINT_FIELDS if f != "occurredAt"]


@dataclass(frozen=True)
class Outputs:
    dispositions: DataFrame
    assessments: DataFrame
    alerts: DataFrame
    requests: DataFrame
    quarantined: DataFrame
    invalid: DataFrame


# (table name, rows) -> the same rows, stored
Keep = Callable[[str, DataFrame], DataFrame]


def keep_in(root: str) -> Keep:
    """Store kept tables as parquet below ``root``, a folder every executor can reach."""
    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return df.sparkSession.read.parquet(f"{root}/{name}")

    return write


def with_bucket(events: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    if "bucket" in events.columns:
        return events
    return events.withColumn("bucket", F.pmod(F.xxhash64("customerId"), F.lit(buckets)))


def resolve_identity(
    events: DataFrame, *, width: int = CHUNK_WIDTH, fold_limit: int = identity.FOLD_LIMIT
) -> DataFrame:
    """Add outcome (accepted, duplicate or a conflict), first_seen and stream_time_2.

    ``events`` are parsed records with ``schema_valid``, ``valid`` and ``active`` (a
    rule set was loaded on arrival).  Only narrow columns are shuffled to find the
    outcomes; the wide rows meet them once, on the unique arrival number.
    """
    events = with_bucket(events)
    # Stage one, per source partition: every well-formed record moves stream time.
    timed = running_max(
        events.filter("schema_valid").select(
            "partition", "arrival_seq", "occurred_ms", "transactionId", "eventId", "valid", "active"),
        ["partition"], "arrival_seq", "occurred_ms", "stream_time_1", width=width,
    )
    conflicts = materialize(identity.transaction_conflicts(
        timed.filter(F.col("valid") & F.col("active")), fold_limit=fold_limit))

    usable = events.filter(F.col("valid") & F.col("active"))
    # Stage two, per customer bucket: survivors move it, later duplicates included.
    survivors = materialize(running_max(
        usable.select("bucket", "arrival_seq", "occurred_ms", "customerId", "eventId")
        .join(conflicts.select("arrival_seq"), "arrival_seq", "left_anti"),
        ["bucket"], "arrival_seq", "occurred_ms", "stream_time_2", width=width,
    ).select("arrival_seq", "customerId", "eventId", "stream_time_2"))
    fingerprint = event_fingerprint(F.col("occurred_us"))

    def with_fingerprint(repeated: DataFrame) -> DataFrame:
        # Serializing and hashing an event is only paid for events seen more than once.
        full = usable.select("arrival_seq", *FINGERPRINT_FIELDS_HELD, "occurred_us")
        return full.join(repeated.select("arrival_seq", "at", "n"), "arrival_seq").withColumn("val", fingerprint)

    decided = conflicts.unionByName(materialize(identity.event_repeats(survivors, with_fingerprint, fold_limit=fold_limit)))
    return (
        usable.join(survivors.select("arrival_seq", "stream_time_2"), "arrival_seq", "left")
        .join(decided, "arrival_seq", "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit("accepted")))
        .withColumn("fingerprint", F.when(F.col("outcome") == identity.EVENT_CONFLICT, fingerprint))
    )


def accepted_events(resolved: DataFrame) -> DataFrame:
    """What the evaluation reads of accepted events; the rest of a row is not carried through counting."""
    return resolved.filter(F.col("outcome") == "accepted").select(
        "arrival_seq", "eventId", "transactionId", "customerId", "amountMinor", "currency",
        "occurred_us", "occurred_ms", "stream_time_2", "ruleset_version", "received_us", "traceId")


def run_batch(
    events: DataFrame,
    rulesets: Mapping[int, RuleSet],
    *,
    width: int = CHUNK_WIDTH,
    fold_limit: int = identity.FOLD_LIMIT,
    keep: Keep = lambda _name, df: materialize(df),
    **history_options: int,
) -> Outputs:
    """Evaluate a table of parsed events; ``ruleset_version`` is the version active on arrival.

    ``events`` is read several times, so it should be a table (or checkpoint) of parsed
    events and not the parsing itself; ``run_records`` does that for raw records.

    Records that arrived before any rule set have a NULL version: they are counted
    in the dispositions and evaluated by nobody.  ``keep`` stores the resolved events
    and the assessments, which later outputs read, and returns them read back; pass
    ``keep_in`` to have them as final tables at once.
    """
    events = with_bucket(events).withColumn("active", F.col("ruleset_version").isNotNull())
    resolved = keep("resolved", resolve_identity(events, width=width, fold_limit=fold_limit))
    windows = set().union(*(r.windows() for r in rulesets.values()))
    accepted = accepted_events(resolved)
    evaluated = assessment.evaluate(history.with_history(accepted, windows, **history_options), rulesets)
    assessed = keep("assessment", assessment.assessments(evaluated))
    alerted = assessment.alerts(assessed)
    skipped = events.filter(~(F.col("valid") & F.col("active"))).select(
        "arrival_seq",
        F.when(F.col("valid"), F.lit("no_ruleset")).otherwise(F.lit("invalid")).alias("outcome"))
    return Outputs(
        dispositions=resolved.select("arrival_seq", "outcome").unionByName(skipped),
        assessments=assessed,
        alerts=alerted,
        requests=assessment.notification_requests(alerted),
        quarantined=identity.quarantine_references(resolved, TRANSACTION_TOPIC),
        invalid=invalid_references(events),
    )


def run_records(records: DataFrame, rulesets: Mapping[int, RuleSet], version: Column, **options) -> Outputs:
    """Evaluate raw records: parse once, keep the parsed table, then ``run_batch``.

    ``version`` is the rule set version of each record, as an expression over its columns.
    """
    parsed = materialize(parse_events(records).withColumn("ruleset_version", version.cast("long")))
    return run_batch(parsed, rulesets, **options)
