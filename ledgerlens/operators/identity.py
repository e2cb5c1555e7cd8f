"""Who is the first of its kind: anchored 24-hour identity and deduplication.

The first arrival of a key opens a period of ``HORIZON_MS`` of stream time; later
arrivals inside it are compared with the anchor, they do not refresh it; the first
arrival after it becomes the next anchor.

Only keys seen more than once need a decision, so the job counts first (map-side
combined longs) and carries on with the few repeated keys, as narrow rows keyed by
``arrival_seq``.  The rows of a key are walked as one sorted array; those of hot keys are
linked to the next possible anchor and the links followed in doubling hops.  No join ever
pairs the rows of a key with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import first_at_or_after, follow_chain
from ledgerlens.session import materialize

# Identity period and reason codes.
HORIZON_MS = 24 * 60 * 60 * 1000
TRANSACTION_CONFLICT = "TRANSACTION_IDENTITY_CONFLICT"
EVENT_CONFLICT = "EVENT_IDENTITY_CONFLICT"

# repeated rows -> the rows with ``val``
WithValue = Callable[[DataFrame], DataFrame]

# Largest number of candidates of one key that is walked inside a single row.
FOLD_LIMIT = 10_000


@dataclass(frozen=True)
class Repeated:
    """Keys that occur more than once, with their number of rows ``n``; ``most`` observes the largest of them."""

    keys: DataFrame
    most: Observation

    def written(self, keys: DataFrame) -> Repeated:
        return Repeated(keys, self.most)


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> Repeated:
    """To be written out before use: a later join then knows the size, and ``most`` its answer."""
    most = Observation()
    return Repeated(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").observe(most, F.max("n").alias("n")), most)


def repeat_decisions(
    rows: DataFrame,
    key: Sequence[str],
    time: str,
    with_value: WithValue,
    *,
    horizon: int = HORIZON_MS,
    fold_limit: int = FOLD_LIMIT,
    repeated: Repeated | None = None,
) -> DataFrame:
    """Decisions for arrivals that are not the anchor of their period.

    ``rows`` has ``arrival_seq``, the key columns and the stream time ``time``
    (non-decreasing along ``arrival_seq`` within a key); ``with_value`` adds ``val``,
    what is compared, to the repeated rows only.  Returns arrival_seq, same (val equals
    the anchor's), anchor_value.  Arrivals that are not returned are accepted.
    ``repeated`` are the repeated keys of ``rows``, or of more rows than these, if they are known already.
    """
    key = list(key)
    # Counted before stream time is looked at, and written out, so that the join below
    # knows its size; a large one is two shuffle stages that skew handling can split.
    if repeated is None:
        repeated = repeated_keys(rows, key)
        repeated = repeated.written(materialize(repeated.keys))
    again = rows.withColumn("at", F.col(time)).join(repeated.keys, key, "inner")
    repeats = with_value(again).select(*key, F.col("arrival_seq").alias("at_seq"), "at", "val", "n")
    if (repeated.most.get["n"] or 0) <= fold_limit:
        return _walked(repeats, key, horizon)
    repeats = materialize(repeats)
    return _walked(repeats.filter(F.col("n") <= fold_limit), key, horizon).unionByName(
        _hopped(repeats.filter(F.col("n") > fold_limit), key, horizon))


def _walked(repeats: DataFrame, key: list[str], horizon: int) -> DataFrame:
    """Decisions of keys short enough to be walked as one sorted array: first its anchors, then each entry's latest anchor."""
    arrays = repeats.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "at_seq", "val"))).alias("c"))
    start = F.struct(F.slice("c", 1, 1).alias("found"), F.col("c")[0]["at"].alias("last"))

    def step(state: Column, item: Column) -> Column:
        due = item["at"] - state["last"] >= horizon
        return F.struct(
            F.when(due, F.concat(state["found"], F.array(item))).otherwise(state["found"]).alias("found"),
            F.when(due, item["at"]).otherwise(state["last"]).alias("last"),
        )

    arrays = arrays.withColumn("anchors", F.aggregate("c", start, step)["found"])

    def decided(item: Column) -> Column:
        anchor = F.element_at(F.filter("anchors", lambda a: (a["at"] < item["at"]) | ((a["at"] == item["at"]) & (a["at_seq"] <= item["at_seq"]))), -1)
        return F.struct(item["at_seq"].alias("arrival_seq"), (item["val"] == anchor["val"]).alias("same"),
                        anchor["val"].alias("anchor_value"), anchor["at_seq"].alias("anchor_seq"))

    return arrays.select(F.inline(F.transform("c", decided))).filter("arrival_seq != anchor_seq").drop("anchor_seq")


def _hopped(repeats: DataFrame, key: list[str], horizon: int) -> DataFrame:
    """Decisions of hot keys: a key has one anchor at most per horizon-wide cell of stream time, which every row finds by equality."""
    # Arrivals of a key at one stream time collapse to the earliest: only it can be an anchor.
    candidates = materialize(repeats.groupBy(*key, "at").agg(F.min(F.struct("at_seq", "val")).alias("first")).select(
        *key, "at", "first.at_seq", "first.val"))
    anchors = _hop(candidates, key, horizon)

    cell = F.floor(F.col("at") / F.lit(horizon)).cast("long")
    shape = F.struct("at", "at_seq", "val")
    own = anchors.select(*key, cell.alias("cell"), shape.alias("own"))
    earlier = anchors.select(*key, (cell + 1).alias("cell"), shape.alias("earlier"))
    governing = F.when(F.col("own.at") <= F.col("at"), F.col("own")).otherwise(F.col("earlier"))
    return (
        repeats.withColumn("cell", cell)
        .join(own, [*key, "cell"], "left")
        .join(earlier, [*key, "cell"], "left")
        .withColumn("anchor", governing)
        .filter(F.col("at_seq") != F.col("anchor.at_seq"))
        .select(
            F.col("at_seq").alias("arrival_seq"),
            (F.col("val") == F.col("anchor.val")).alias("same"),
            F.col("anchor.val").alias("anchor_value"),
        )
    )


def _hop(candidates: DataFrame, key: list[str], horizon: int) -> DataFrame:
    """Anchors of hot keys: link each candidate to the next possible anchor, follow the links."""
    probes = candidates.select(*key, F.col("at").alias("src"), (F.col("at") + horizon).alias("at"))
    links = first_at_or_after(candidates.select(*key, "at"), probes, key, cell_width=horizon // 24)
    first = candidates.groupBy(*key).agg(F.min("at").alias("src"))
    reached = follow_chain(first, links, key).withColumnRenamed("src", "at")
    return candidates.join(reached, [*key, "at"], "inner")


def transaction_conflicts(events: DataFrame, *, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Arrivals whose transaction was first seen with another event id.

    Needs partition, transactionId, eventId, stream_time_1; identity state is kept
    per source partition, like its stream time.
    """
    decisions = repeat_decisions(
        events, ["partition", "transactionId"], "stream_time_1",
        lambda df: df.withColumn("val", F.col("eventId")), fold_limit=fold_limit)
    return decisions.filter(~F.col("same")).select(
        "arrival_seq", F.lit(TRANSACTION_CONFLICT).alias("outcome"), F.col("anchor_value").alias("first_seen")
    )


def event_repeats(
    survivors: DataFrame, with_value: WithValue, *, time: str = "stream_time_2", fold_limit: int = FOLD_LIMIT,
    repeated: Repeated | None = None,
) -> DataFrame:
    """Arrivals that repeat a (customer, event): silent duplicates and fingerprint conflicts.

    ``with_value`` adds the fingerprint as ``val``; it is asked for repeated events only.
    """
    decisions = repeat_decisions(
        survivors, ["customerId", "eventId"], time, with_value, fold_limit=fold_limit, repeated=repeated)
    return decisions.select(
        "arrival_seq",
        F.when(F.col("same"), F.lit("duplicate")).otherwise(F.lit(EVENT_CONFLICT)).alias("outcome"),
        F.col("anchor_value").alias("first_seen"),
    )


def quarantine_references(rejected: DataFrame, topic: str) -> DataFrame:
    """Sanitized references of the two kinds of conflicts; keyed by transaction."""
    return rejected.filter(F.col("outcome").isin(TRANSACTION_CONFLICT, EVENT_CONFLICT)).select(
        F.col("transactionId").alias("key"),
        F.lit(1).alias("schemaVersion"),
        F.lit(topic).alias("sourceTopic"),
        F.col("partition").alias("sourcePartition"),
        F.col("offset").alias("sourceOffset"),
        "eventId",
        "transactionId",
        F.when(F.col("outcome") == EVENT_CONFLICT, F.col("fingerprint"))
        .otherwise(F.concat(F.lit("sha256:"), F.col("payload_hash"))).alias("payloadHash"),
        F.when(F.col("outcome") == EVENT_CONFLICT, F.col("first_seen"))
        .otherwise(F.concat(F.lit("sha256:"), F.sha2("first_seen", 256))).alias("conflictingIdentityHash"),
        F.col("outcome").alias("reasonCode"),
        F.col("received_us").alias("detected_us"),
    )
