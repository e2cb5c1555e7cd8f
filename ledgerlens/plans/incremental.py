"""One micro-batch of events as a continuation: the batch operators over the new rows and the state they meet.

The entries that the new rows can meet join them as rows of their own that arrived earlier (the anchor of a known transaction or event,
the recent facts of a customer), so first-of-its-kind and history are the same operators as in the batch job, with the
same handling of hot keys.  Stream time is the running maximum inside the batch, raised to where the batches before left it.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import history, identity
from ledgerlens.operators.ordering import CHUNK_WIDTH, running_max
from ledgerlens.session import materialize, materialize_all
from ledgerlens.streaming.state import BUCKET, PARTITION


@dataclass(frozen=True)
class Step:
    """Resolved rows with history, and what the next batch has to know."""

    resolved: DataFrame
    evaluable: DataFrame
    entries: dict[str, DataFrame]
    clocks: DataFrame


def clocked(rows: DataFrame, clocks: DataFrame, stage: int, slot: str, out: str, width: int = CHUNK_WIDTH) -> DataFrame:
    """Add ``out``: the largest event time of the row's group so far, earlier batches included."""
    before = clocks.where(F.col("stage") == stage).select(F.col("slot").alias(slot), F.col("time").alias("__before"))
    timed = running_max(rows, [slot], "arrival_seq", "occurred_ms", out, width=width)
    return timed.join(before, slot, "left").withColumn(out, F.greatest(out, "__before")).drop("__before")


def advance(events: DataFrame, clocks: DataFrame, entries: Callable[[str, DataFrame], DataFrame], windows: Collection[int],
            *, width: int = CHUNK_WIDTH, fold_limit: int = identity.FOLD_LIMIT, **history_options: int) -> Step:
    """Outcomes and history of a table of parsed events with ``bucket``, ``fingerprint`` and ``ruleset_version``.

    ``entries`` gives what earlier batches left in a state table for some keys, ``clocks`` their stream times.
    """
    valid = events.where("valid")
    transaction, event = ["partition", "transactionId"], ["customerId", "eventId"]
    known_transactions, known_events = entries("transactions", valid.select(*transaction)), entries("events", valid.select(*event))
    # Every well-formed record moves its partition's clock, also one with a wrong key.
    timed = clocked(
        events.where("schema_valid").select("partition", "arrival_seq", "occurred_ms", "transactionId", "eventId", "valid"),
        clocks, PARTITION, "partition", "at", width).where("valid").drop("valid", "occurred_ms")
    # Keys are counted over all valid rows, those included that turn out to be conflicts: that costs a look, and no answer.
    repeated = [identity.repeated_keys(valid.select(*key).unionByName(known.select(*key)), key)
                for key, known in ((transaction, known_transactions), (event, known_events))]
    timed, *keys = materialize_all(timed, *[r.keys for r in repeated])
    repeated = [r.written(k) for r, k in zip(repeated, keys)]
    decided = materialize(identity.repeat_decisions(
        timed.unionByName(known_transactions), transaction, "at", lambda df: df.withColumn("val", F.col("eventId")),
        fold_limit=fold_limit, repeated=repeated[0]))
    transactions = timed.join(decided.select("arrival_seq"), "arrival_seq", "left_anti")
    conflicts = decided.where(~F.col("same")).select(
        "arrival_seq", F.lit(identity.TRANSACTION_CONFLICT).alias("outcome"), F.col("anchor_value").alias("first_seen"))

    survivors = materialize(clocked(
        valid.select("bucket", "arrival_seq", "occurred_ms", "customerId", "eventId", "fingerprint")
        .join(conflicts.select("arrival_seq"), "arrival_seq", "left_anti"),
        clocks, BUCKET, "bucket", "at", width))
    shape = survivors.drop("occurred_ms")
    repeats = materialize(identity.event_repeats(
        shape.unionByName(known_events), lambda df: df.withColumn("val", F.col("fingerprint")),
        time="at", fold_limit=fold_limit, repeated=repeated[1]))
    new_events = shape.join(repeats.select("arrival_seq"), "arrival_seq", "left_anti")

    resolved = materialize(
        valid.join(survivors.select("arrival_seq", F.col("at").alias("stream_time_2")), "arrival_seq", "left")
        .join(conflicts.unionByName(repeats), "arrival_seq", "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit("accepted"))))
    accepted = resolved.where("outcome = 'accepted'")
    old = entries("facts", accepted.select("customerId")).select(
        "customerId", "arrival_seq", "occurred_us", F.col("at").alias("occurred_ms"), F.col("at").alias("stream_time_2"), F.lit(True).alias("__old"))
    rows = accepted.withColumn("__old", F.lit(False)).unionByName(old, allowMissingColumns=True) if windows else accepted.withColumn("__old", F.lit(False))
    evaluable = history.with_history(rows, windows, **history_options).where("NOT __old").drop("__old")
    facts = accepted.where(history.available()).select(
        "bucket", "customerId", "occurred_us", F.col("occurred_ms").alias("at"), "arrival_seq")
    moved = events.where("schema_valid").groupBy(F.col("partition").cast("long").alias("slot")).agg(F.max("occurred_ms").alias("time")).withColumn(
        "stage", F.lit(PARTITION)).unionByName(
        survivors.groupBy(F.col("bucket").alias("slot")).agg(F.max("occurred_ms").alias("time")).withColumn("stage", F.lit(BUCKET)))
    return Step(resolved, evaluable, {"transactions": transactions, "events": new_events, "facts": facts}, moved)
